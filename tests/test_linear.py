"""Sparse systems against numpy."""

import re

import numpy as np
import pytest

from strandline.operators import ndsparse
from strandline.operators.linear import least_squares


def put(spark, m):
    at = np.argwhere(m)
    return spark.createDataFrame([(int(i) + 1, int(j) + 1, float(m[i, j])) for i, j in at], "i long, j long, val double")


def got(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r["j"] - 1] = r["val"]
    return out


def right(spark, v):
    return spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(v)], "i long, val double")


def test_square_not_symmetric(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 12)) * (rng.random((12, 12)) < 0.4) + 4 * np.eye(12)
    b = rng.normal(size=12)
    assert np.allclose(got(ndsparse.solve(put(spark, m), right(spark, b)), 12), np.linalg.solve(m, b), atol=1e-7)


@pytest.mark.parametrize("shape", [(15, 6), (4, 9)])
def test_rectangular_is_least_squares(spark, shape):
    rng = np.random.default_rng(2)
    m, b = rng.normal(size=shape), rng.normal(size=shape[0])
    x = got(ndsparse.solve(put(spark, m), right(spark, b)), shape[1])
    assert np.allclose(m.T @ (m @ x - b), 0, atol=1e-7)


def test_inverse(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(5, 5)) + 3 * np.eye(5)
    inv = np.zeros((5, 5))
    for r in ndsparse.inverse(put(spark, m)).collect():
        inv[r["i"] - 1, r["j"] - 1] = r["val"]
    assert np.allclose(inv, np.linalg.inv(m), atol=1e-8)


def test_unknowns_that_only_later_rounds_reach(spark):
    m = np.diag(np.full(6, 3.0)) + np.diag(np.ones(5), 1)
    inv = np.zeros((6, 6))
    for r in ndsparse.inverse(put(spark, m)).collect():
        inv[r["i"] - 1, r["j"] - 1] = r["val"]
    assert np.allclose(inv, np.linalg.inv(m), atol=1e-8)
    assert np.allclose(got(ndsparse.solve(put(spark, m), right(spark, [1.0])), 6), np.linalg.solve(m, np.eye(6)[0]), atol=1e-8)


def test_zero_right_side_repeats_and_missing_rows(spark):
    m = np.diag([2.0, 4.0, 5.0])
    assert (got(least_squares(put(spark, m), right(spark, [0.0, 0.0, 0.0])), 3) == 0).all()
    twice = put(spark, m).unionByName(put(spark, m))
    assert np.allclose(got(least_squares(twice, right(spark, [4.0, 8.0])), 3), [1.0, 1.0, 0.0])
    extra = right(spark, [2.0, 4.0, 5.0, 99.0])  # a row that the matrix lacks
    assert np.allclose(got(least_squares(put(spark, m), extra), 3), 1)


def test_many_unknowns_in_few_rounds(spark):
    """A chain of 3,000 unknowns, each tied to its neighbours."""
    from pyspark.sql import functions as F

    n = 3000
    i = spark.range(1, n + 1).withColumnRenamed("id", "i")
    a = i.select("i", F.explode(F.array(F.struct(F.col("i").alias("j"), F.lit(4.0).alias("val")), F.struct((F.col("i") + 1).alias("j"), F.lit(-1.0).alias("val")), F.struct((F.col("i") - 1).alias("j"), F.lit(-1.0).alias("val")))).alias("c")).select("i", "c.j", "c.val").filter(F.col("j").between(1, n))
    b = i.select("i", (F.col("i") % 7).cast("double").alias("val"))
    x = got(ndsparse.solve(a, b, tol=1e-8, rounds=40), n)
    m = 4 * x - np.append(x[1:], 0) - np.append(0, x[:-1])
    assert np.abs(m - np.arange(1, n + 1) % 7).max() < 1e-5


def test_no_table_of_the_system_is_broadcast(spark, monkeypatch):
    """A broadcast goes through the driver; only step sizes, a row a system, may."""
    from strandline.operators import linear

    plans, kept = [], linear._kept
    monkeypatch.setattr(linear, "_kept", lambda spark, df, *v: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(spark, df, *v))
    m = np.eye(4) + 0.1
    x = got(least_squares(put(spark, m), right(spark, [1.0, 2.0, 3.0, 4.0])), 4)
    assert np.allclose(m @ x.ravel(), [1, 2, 3, 4])
    keys = [k for p in plans for k in re.findall(r"BroadcastHashJoin \[(\w+)#", p)]
    assert plans and all("SortMergeJoin" in p for p in plans[1:2]) and set(keys) <= {"system"}
