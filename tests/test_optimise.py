"""The line search's conditions and budgets, and batch training against a local loop in the same order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import classify, encoding, optimise


def rosenbrock(x):
    return float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])


def test_polynomials_hit_their_minima():
    f = lambda z: ((z - 1.5) ** 2 * 3 + 2, 6 * (z - 1.5))
    p = lambda f, z: optimise.Probe(z, *f(z), None)
    assert np.isclose(optimise._parabola(p(f, 0.0), p(f, 4.0)), 1.5)
    c = lambda z: (z**3 - 3 * z, 3 * z * z - 3)
    for a, b in ((0.0, 3.0), (0.2, 0.7), (2.0, 0.5), (-0.5, 1.9)):
        assert np.isclose(optimise._cubic(p(c, a), p(c, b)), 1.0)
    assert np.isnan(optimise._cubic(p(lambda z: (z**3 + z, 3 * z * z + 1), 0.0), p(lambda z: (z**3 + z, 3 * z * z + 1), 1.0)))


@pytest.mark.parametrize("step", [1e-6, 1e-3, 0.1, 10.0, 1e4])
def test_accepted_steps_meet_both_conditions(step):
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=2)
        v, g = rosenbrock(x)
        start = optimise.Probe(0.0, v, float(-g @ g), g)
        got, used = optimise.line_search(rosenbrock, x, -g, start, step)
        assert used <= 1 + optimise.MOST
        if got is not None:
            assert got.value <= v + optimise.RHO * got.at * start.slope and abs(got.slope) <= -optimise.SIGMA * start.slope


def test_reaches_the_minimum_and_falls():
    x, values, used = optimise.minimise(rosenbrock, np.array([-1.2, 1.0]), 100)
    assert np.abs(x - 1).max() < 1e-6 and all(b < a for a, b in zip(values, values[1:], strict=False)) and used < 1000
    rng = np.random.default_rng(2)
    m = rng.normal(size=(30, 30))
    a, b = m @ m.T + np.eye(30), rng.normal(size=30)
    x, _, _ = optimise.minimise(lambda x: (float(x @ a @ x / 2 - b @ x), a @ x - b), np.zeros(30), 200)
    assert np.abs(a @ x - b).max() < 1e-5


@pytest.mark.parametrize("budget", [1, 2, 5, 17, 60])
def test_budget_of_evaluations(budget):
    calls = []

    def f(x):
        calls.append(1)
        return rosenbrock(x)

    _, _, used = optimise.minimise(f, np.array([-1.2, 1.0]), -budget)
    assert len(calls) == used <= budget


def test_walls_and_flat_places():
    wall = lambda x: (float(-np.log(x[0]) + x[0]) if x[0] > 0 else float("nan"), np.array([1 - 1 / x[0]]) if x[0] > 0 else np.array([np.nan]))
    with np.errstate(all="ignore"):
        assert abs(optimise.minimise(wall, np.array([0.01]), 50)[0][0] - 1) < 1e-4
    assert optimise.minimise(lambda x: (1.0, np.zeros(2)), np.ones(2), 10)[1] == [1.0]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(1, 4, 150)
    x = rng.normal(size=(150, 4)) + np.eye(4)[y]
    return spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y, strict=True)], "features array<double>, label int").repartition(5)


GROUPS = [np.arange(2), np.arange(2, 4)]


def test_batches_equal_a_local_loop(labelled, tmp_path):
    got = classify.fit_batches(labelled, 3, GROUPS, 0.1, 0.1, size=40, epochs=3)
    rows = sorted((r["o"], r["features"], r["label"]) for r in labelled.withColumn("o", F.xxhash64(F.lit(1), "features", "label")).collect())
    batches = [rows[k : k + 40] for k in range(0, 150, 40)]
    theta = np.full((4, 3), 1e-3)
    for epoch in range(3):
        for k in [*np.random.default_rng([1, epoch]).permutation(3).tolist(), 3]:
            x, y = np.array([r[1] for r in batches[k]]), np.array([r[2] for r in batches[k]])
            theta = classify.batch_search(x, y, theta, GROUPS, 0.1, 0.1)
    assert np.abs(got - theta).max() < 1e-8


def test_batches_go_on_from_a_checkpoint(labelled, tmp_path):
    path = str(tmp_path / "weights")
    whole = classify.fit_batches(labelled, 3, GROUPS, 0.1, 0.1, size=40, epochs=4)
    classify.fit_batches(labelled, 3, GROUPS, 0.1, 0.1, size=40, epochs=2, checkpoint=path)
    assert classify.load_weights(labelled.sparkSession, path)[0] == 2
    assert np.abs(classify.fit_batches(labelled, 3, GROUPS, 0.1, 0.1, size=40, epochs=4, checkpoint=path) - whole).max() < 1e-9
    assert classify.load_weights(labelled.sparkSession, str(tmp_path / "none")) is None


def test_batches_of_nothing(labelled):
    with pytest.raises(ValueError):
        classify.fit_batches(labelled.limit(0), 3, GROUPS, 0.1, 0.1)


def test_two_modalities_are_one_regression(labelled):
    two = labelled.select(F.slice("features", 1, 2).alias("a"), F.slice("features", 3, 2).alias("b"), "label")
    one = classify.fit_mixed(labelled, 3, GROUPS, 0.1, 0.1, rounds=6)[0]
    assert np.abs(classify.fit_two(two, "a", "b", 3, 0.1, 0.1, rounds=6)[0] - one).max() < 1e-9


def test_written_batches(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("seq_id"), F.array(F.col("id").cast("double")).alias("code"))
    got = encoding.write_batches(df, str(tmp_path / "b"), 32)
    rows = sorted((r["seq_id"], r["batch"]) for r in got.collect())
    assert [b for _, b in rows] == [k // 32 for k in range(100)]
    assert sorted(p.name for p in (tmp_path / "b").glob("batch=*")) == [f"batch={k}" for k in range(4)]


def test_equal_columns_predict_the_first():
    rng = np.random.default_rng(7)
    x, theta = rng.normal(size=(500, 64)), rng.integers(-2, 3, size=(64, 5)) / 10
    s = x @ np.concatenate([theta, theta], axis=1)
    assert (classify.first_largest(s + 1e-15 * rng.normal(size=s.shape)) == (x @ theta).argmax(1)).all()
    assert classify.first_largest(np.array([[0.0, 0.0], [1.0, 1.1], [2.0, 1.0]])).tolist() == [0, 1, 0]


def test_pca_of_many_columns(spark):
    """More columns than one aggregate a pair of them could hold in a plan."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 80)) @ np.diag(np.linspace(3, 0.1, 80))
    names = [f"c{k}" for k in range(80)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names)).repartition(3)
    got = encoding.pca(df, names, 0.9)
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    keep = (np.cumsum(w[::-1]) / w.sum() < 0.9).sum()
    assert got.shape == (80, keep) and np.allclose(np.abs((got * v[:, ::-1][:, :keep]).sum(0)), 1, atol=1e-6)
    p = encoding.project(df, names, got).select("c0", *(f"pc{k}" for k in range(keep))).collect()
    want = {round(r[0], 9): r @ got for r in x}
    assert all(np.allclose(r[1:], want[round(r[0], 9)]) for r in p)
    assert encoding.pca(df.limit(0), names).shape == (80, 0)


def test_batches_share_a_job(spark, labelled, monkeypatch):
    def fit(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            w = classify.fit_batches(labelled, 3, GROUPS, 0.1, 0.1, size=20, epochs=3)
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return w, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    w, few = fit("batches of a job")
    monkeypatch.setattr(classify, "STEPS", 1)
    one, many = fit("a batch a job")
    assert (w == one).all()
    # three epochs take a job each, not one a batch
    assert many - few == 3 * (-(-labelled.count() // 20) - 1)
