"""op11: block products against Python's integers, whole runs, and the defined cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from strandline.llm import clusters

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()), T.StructField("V", T.StringType())])


def brute(rows, k, dim, rounds):
    good = [(i, [int(x * 256 // 1) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in good]
        c = [[sum(col) // own.count(j) for col in zip(*(v for (_, v), o in zip(good, own, strict=True) if o == j), strict=True)] if j in own else c[j] for j in range(len(c))]
    got = [(i, *near(v)[::-1]) for i, v in good]
    fits = lambda x: x if x < 1 << 63 else None
    per = {j: fits(sum(d for _, q, d in got if q == j)) for j in range(len(c))}
    return sorted((str(i), q, fits(d), per[q], fits(sum(d for *_, d in got)), hashlib.sha256(",".join(map(str, c[q])).encode()).hexdigest()) for i, q, d in got)


def run(spark, rows, k=4, dim=3, rounds=3):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    out = clusters.clustered(df, k=k, dim=dim, rounds=rounds).drop("centroid")
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    assert run(spark, rows) == brute(rows, 4, 3, 3)


def test_nulls_lengths_ties_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None, 2.0]), (3, [1.0, nan, 2.0]), (4, [1.0, inf, 0.0]), (5, [1.0]), (6, []), (7, [-0.001, 0.0, 1.0]), (7, [-0.001, 0.0, 1.0]), (8, [-0.001, 0.0, 1.0]), (None, [2.0, 2.0, 2.0]), (9, [0.5, 0.5, 0.5]), (9, [4.0, 4.0, 4.0])]
    assert run(spark, rows) == brute(rows, 4, 3, 3)
    assert len(run(spark, rows)) == 6


@pytest.mark.parametrize("size", [1e6, 1e8, 1e17, 1e300])
def test_large_magnitudes_take_integers(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * (size if i % 3 else 1)).tolist()) for i in range(40)]
    assert run(spark, rows) == brute(rows, 4, 3, 3)


def test_few_and_none(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])]
    assert run(spark, rows) == brute(rows, 4, 3, 3)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_nearest_kinds_agree():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (40, 64))
    k, d = clusters.nearest(x, c)
    far = c.copy()
    far[-1] = 1 << 29  # no row is near it; its size forbids floats
    k2, d2 = clusters.nearest(x, far)
    brute_d = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (k == brute_d.argmin(1)).all() and (d == brute_d.min(1)).all()
    other = ((x[:, None] - c[None, :-1]) ** 2).sum(-1)
    assert (k2 == other.argmin(1)).all() and (d2 == other.min(1)).all()
