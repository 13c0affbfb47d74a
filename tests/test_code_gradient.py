"""Gradients of code objectives against differences of the objective."""

import numpy as np
import pytest

from strandline.operators import encoding


def row(spark, x, code, **how):
    basis = np.random.default_rng(2).normal(size=(3, 4))
    df = spark.createDataFrame([(*map(float, x[k]), [float(v) for v in code[k]]) for k in range(len(x))], "x double, y double, z double, code array<double>").coalesce(1)
    return encoding.code_gradient(df, ["x", "y", "z"], basis, **how).collect()


@pytest.mark.parametrize("penalty", sorted(encoding.PENALTIES))
def test_gradient_is_the_slope_of_the_objective(spark, penalty):
    rng = np.random.default_rng(3)
    x, s, h = rng.normal(size=3), rng.normal(size=4) + 0.05, 1e-5
    s[1] = 0.03  # inside the bend of huber
    steps = [s] + [s + sign * h * np.eye(4)[k] for k in range(4) for sign in (1, -1)]
    got = row(spark, [x] * 9, steps, penalty=penalty, beta=0.4, noise=0.3, sigma=0.8, epsilon=0.2)
    total = [r["fit"] + r["cost"] for r in got]
    slopes = [(total[1 + 2 * k] - total[2 + 2 * k]) / (2 * h) for k in range(4)]
    assert np.allclose(got[0]["gradient"], slopes, atol=1e-6)


def test_zero_codes_and_nulls(spark):
    got = row(spark, np.zeros((1, 3)), np.zeros((1, 4)))
    assert got[0]["fit"] == got[0]["cost"] == 0 and got[0]["gradient"] == [0.0] * 4
    df = spark.createDataFrame([(None, 0.0, 0.0, [1.0] * 4), (0.0, 0.0, 0.0, None)], "x double, y double, z double, code array<double>")
    for r in encoding.code_gradient(df, ["x", "y", "z"], np.ones((3, 4))).collect():
        assert r["fit"] is None and set(r["gradient"]) == {None}
