"""Signs of nearly collinear triples against rational arithmetic."""

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import vector as V
from strandline.operators import geometry


def test_right_sign_on_nearly_collinear_points(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    a, step = rng.normal(size=(n, 2)) * 10.0 ** rng.integers(-3, 6, (n, 1)), rng.normal(size=(n, 2))
    b, c = a + rng.integers(-5, 6, (n, 1)) * step, a + rng.random((n, 1)) * step
    c = np.where(rng.random((n, 1)) < 0.5, np.nextafter(c, np.inf), c)
    rows = np.concatenate([a, b, c], axis=1)
    rows[:3] = [[0, 0, 1, 1, 2, 2], [0.1, 0.1, 0.2, 0.2, 0.3, 0.3], [5e-324, 0, 0, 5e-324, 0, 0]]
    rows[3:5] = [[1e200, 1e200, -1e200, 1e200, 0, 0], [1, 1, 1, 1, 1, 1]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows.tolist())], "k long, ax double, ay double, bx double, by double, cx double, cy double").repartition(4)
    sides = [V.cols(f"{p}x", f"{p}y") for p in "abc"]
    got = {r["k"]: r["turn"] for r in df.select("k", geometry.turn(*sides).alias("turn")).collect()}
    naive = 0
    for k, r in enumerate(rows.tolist()):
        x, y, p, q, u, v = map(Fraction, r)
        d = (x - u) * (q - v) - (y - v) * (p - u)
        assert got[k] == (d > 0) - (d < 0), r
        f = (r[0] - r[4]) * (r[3] - r[5]) - (r[1] - r[5]) * (r[2] - r[4])
        naive += ((f > 0) - (f < 0)) != got[k]
    assert naive > 100  # doubles alone are wrong here


def test_nulls_and_infinities(spark):
    df = spark.createDataFrame([(None, 0.0), (float("inf"), 0.0), (float("nan"), 0.0), (1.0, 0.0)], "x double, y double")
    p = V.cols("x", "y")
    zero, one = [F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0)]
    assert [r[0] for r in df.coalesce(1).select(geometry.turn(zero, p, one)).collect()] == [None, None, None, 1]
