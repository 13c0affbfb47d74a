"""Tiles against pairs of frames, with tiles of several sizes; key points by order against the definition."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import geometry, pairwise

COLUMNS = ["seq_id", "t", "theta", "alpha", "radius", "cnt"]


@pytest.fixture(scope="module")
def paths(spark):
    rng = random.Random(4)
    rows = []
    for s, n in ((1, 37), (2, 5), (3, 1), (4, 12)):
        x = [0.0, 0.0, 0.0]
        for t in range(1, n + 1):
            x = [v + rng.choice([-1.0, 0.0, 1.0, 2.5]) for v in x]
            rows.append((s, t, None if s == 4 and t == 3 else x[0], x[1], x[2]))
    return spark.createDataFrame(rows, "seq_id long, t long, x double, y double, z double").repartition(4)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("size", [1, 5, 12, 256])
def test_tiles_equal_pairs(paths, monkeypatch, size):
    monkeypatch.setattr(pairwise, "TILE", size)
    mean = pairwise.mean_distance(paths)
    by_pairs = {r[0]: r[1] for r in pairwise.distances(paths).groupBy("seq_id").agg(F.avg(F.sqrt("d2"))).collect()}
    got = {r["seq_id"]: r["mean_dist"] for r in mean.collect()}
    assert got.keys() == by_pairs.keys() and all(abs(got[k] - by_pairs[k]) < 1e-9 for k in got)
    # one mean for both, off the places where a bin's edge meets a grid distance
    mean = paths.select("seq_id").distinct().withColumn("mean_dist", F.lit(3.3017) * F.col("seq_id") % 5)
    bins = pairwise.shape_bins(paths, mean)
    assert rows(pairwise.shape_histogram(paths, mean)) == rows(pairwise.shape_context(bins))
    some = paths.filter("t % 3 <> 0")
    assert rows(pairwise.shape_histogram(paths, mean, some)) == rows(pairwise.shape_context(bins, some))
    m = lambda df: sorted(map(str, df.collect()))
    assert m(pairwise.shape_context_marginals(pairwise.shape_histogram(paths, mean))) == m(pairwise.shape_context_marginals(bins))


def test_no_rows(paths):
    none = paths.limit(0)
    assert pairwise.shape_histogram(none, pairwise.mean_distance(none)).count() == 0


def test_key_points_by_order(spark):
    rng = random.Random(6)
    frames, segs = [], []
    for s in range(12):
        n = rng.randint(1, 30)
        frames += [(s, t) for t in range(1, n + 1)]
        b = 1
        while s % 4 and b < n:
            e = min(n, b + rng.randint(1, 6))
            segs.append((s, len(segs), b, e))
            b += rng.randint(1, 3)
    df, seg = spark.createDataFrame(frames, "seq_id long, t long"), spark.createDataFrame(segs, "seq_id long, seg_id long, b long, e long")
    got = sorted(map(tuple, geometry.key_points(df, seg).collect()), key=str)
    want = []
    for s, t in frames:
        own = [x for x in segs if x[0] == s]
        if own:
            want.append((s, t, min((x[2] for x in own if x[3] >= t), default=None), max((x[3] for x in own if x[2] <= t), default=None)))
    assert got == sorted(want, key=str)


def test_key_points_join_nothing(spark):
    df = spark.createDataFrame([(1, 1)], "seq_id long, t long")
    seg = spark.createDataFrame([(1, 1, 1, 1)], "seq_id long, seg_id long, b long, e long")
    assert "Join" not in geometry.key_points(df, seg)._jdf.queryExecution().optimizedPlan().toString()
