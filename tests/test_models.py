"""Stored mixtures and weights, folders of records, sigmoids and out-of-bag accuracy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import classify, encoding, resample
from strandline.sources import trajectories


def test_mixture_round_trip(spark, tmp_path):
    gmm = [(0.25, [1.0, -2.0], [0.5, 3.0]), (0.75, [1e-9, 4.0], [1e-6, 1.0])]
    path = str(tmp_path / "gmm")
    encoding.save_gmm(spark, gmm, path)
    encoding.save_gmm(spark, gmm, path)  # again, over itself
    assert encoding.load_gmm(spark, path) == gmm


def test_weights_keep_the_latest_finished(spark, tmp_path):
    path = str(tmp_path / "w")
    for n in (3, 10):
        classify.save_weights(spark, path, n, np.full((2, 3), float(n)))
    (tmp_path / "w" / "rounds=99").mkdir()  # begun, not finished
    done, w = classify.load_weights(spark, path)
    assert done == 10 and (w == 10.0).all() and w.shape == (2, 3)


def test_folder_of_records(spark, tmp_path):
    """Two kept records of persons 1 and 12, one of a gesture that is left out."""
    at = lambda t: [math.cos(t / 5), math.sin(t / 5), t / 10]
    points = {}
    for person, gesture in ((1, 4), (12, 4), (1, 17)):
        rows = [[0.0] * 3 + at(t) + [2 * v for v in at(t)] + [0.0] * 3 for t in range(20 + person)]
        text = f"{len(rows)} 12\n" + "\n".join(" ".join(f"{v:.6f}".replace(".", ",") for v in r) for r in rows)
        (tmp_path / f"rec_{person:02d}_{gesture:02d}_1_2.txt").write_text(text)
        points[person, gesture] = np.array([[float(f"{v:.6f}") for v in at(t)] for t in range(len(rows))])
    train = spark.createDataFrame([(k,) for k in range(1, 11)], "person_id int")
    got = trajectories.load_records(spark, str(tmp_path), train, length=16).cache()
    assert {(r["person_id"], r["gesture_id"], r["split"]) for r in got.collect()} == {(1, 4, "train"), (12, 4, "test")}
    assert got.groupBy("person_id", "hand").count().filter("count <> 16").isEmpty()
    for person in (1, 12):
        p = np.array([[r["x"], r["y"], r["z"]] for r in got.filter((F.col("person_id") == person) & (F.col("hand") == "left")).orderBy("t").collect()])
        assert np.allclose(p, resample.resample_points(points[person, 4], 16), atol=1e-9)
    strict = spark.createDataFrame([(11,)], "person_id int")
    assert {r["person_id"] for r in trajectories.load_records(spark, str(tmp_path), train, length=16, strict=strict).collect()} == {1}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(1, 4, 240)
    x = rng.normal(size=(240, 3)) * 0.8 + 1.5 * np.eye(3)[y - 1]
    return spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y, strict=True)], "features array<double>, label int").repartition(4)


def test_sigmoids_minimise_the_smoothed_loss(labelled):
    machines = classify.fit_pairwise_svm(labelled, rounds=20)
    got = classify.fit_sigmoids(labelled, machines)
    rows = labelled.collect()
    for (a, b), (w, w0) in machines.items():
        s = np.array([np.dot(r["features"], w) + w0 for r in rows if r["label"] in (a, b)])
        own = np.array([r["label"] == a for r in rows if r["label"] in (a, b)])
        t = np.where(own, (own.sum() + 1) / (own.sum() + 2), 1 / ((~own).sum() + 2))
        loss = lambda p: float((t * (p[0] * s + p[1]) + np.logaddexp(0, -(p[0] * s + p[1]))).sum())
        best = loss(got[a, b])
        assert got[a, b][0] < 0 and all(best <= loss((got[a, b][0] + d, got[a, b][1] + e)) + 1e-9 for d in (-0.02, 0, 0.02) for e in (-0.02, 0, 0.02))
    p = classify.predict_pairwise(labelled, machines, got).collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-6 for r in p) and np.mean([r["label"] == r["prediction"] for r in p]) > 0.8


def test_coupled_solves_its_quadratic_programme():
    """min over p of the sum of (r_ji p_i - r_ij p_j)^2 with sum p = 1, by its linear system."""
    rng = np.random.default_rng(3)
    r = np.zeros((5, 4, 4))
    for k in range(5):
        for i in range(4):
            for j in range(i):
                r[k, i, j] = rng.uniform(0.05, 0.95)
                r[k, j, i] = 1 - r[k, i, j]
    got = classify.coupled(r)
    for k in range(5):
        q = np.array([[-r[k, j, i] * r[k, i, j] if i != j else sum(r[k, s, i] ** 2 for s in range(4) if s != i) for j in range(4)] for i in range(4)])
        m = np.block([[q, np.ones((4, 1))], [np.ones((1, 4)), np.zeros((1, 1))]])
        want = np.linalg.solve(m, [0, 0, 0, 0, 1])[:4]
        assert np.allclose(got[k], want, atol=1e-4)


def test_out_of_bag_is_a_share(labelled):
    assert 0.6 < classify.out_of_bag(labelled.withColumn("vec_id", F.xxhash64("features")), trees=5) <= 1.0


def test_a_pair_is_fitted_in_few_tasks_on_its_own_rows(spark, labelled, monkeypatch):
    """A machine's jobs have tasks by the size of its pair, whatever the input's partitions, and the machines are those of the plain fit."""
    from pyspark.ml.classification import LinearSVC

    seen, fit = [], LinearSVC.fit
    monkeypatch.setattr(LinearSVC, "fit", lambda self, d: seen.append((d.rdd.getNumPartitions(), d.count())) or fit(self, d))
    got = classify.fit_pairwise_svm(labelled.repartition(13), rounds=10)
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    assert sorted(seen) == sorted((1, sizes[a] + sizes[b]) for a, b in got)
    two = classify._vectors(labelled.filter(F.col("label").isin(1, 2)).withColumn("label", (F.col("label") == 1).cast("int"))).coalesce(1)
    plain = fit(LinearSVC(featuresCol="vec", labelCol="y", maxIter=10, standardization=False, regParam=1.0 / (sizes[1] + sizes[2])), two)
    assert np.allclose(got[1, 2][0], plain.coefficients.toArray(), atol=1e-6)
