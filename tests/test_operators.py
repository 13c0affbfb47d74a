"""Trajectory operators against formulas, brute force and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import vector as V
from strandline.operators import classify, encoding, geometry, integral, ndsparse, pairwise, resample, segmentation, sequence
from strandline.sources import trajectories


def table(spark, curves):
    rows = [(k, t + 1, *map(float, p)) for k, c in curves.items() for t, p in enumerate(c)]
    return spark.createDataFrame(rows, "seq_id long, t long, x double, y double, z double")


@pytest.fixture(scope="module")
def helices(spark):
    out = {}
    for k in range(4):
        a = np.linspace(0, 4 + 0.7 * k, 40 + k)
        out[k] = np.column_stack([np.cos(a), np.sin(a), (0.15 + 0.12 * k) * a])
    return table(spark, out)


def test_resample_cubic():
    t = np.arange(1, 8.0)
    got = resample.resample_points(np.column_stack([t, t**2, t**3]), 64)
    n = 10 * (10 * 6) + 1
    at = 1 + 0.01 * (np.array([min(range(1, n + 1), key=lambda i, s=k * n / 64: (abs(i - s), i)) for k in range(1, 65)]) - 1)
    assert np.abs(got - np.column_stack([at, at**2, at**3])).max() < 1e-9


def test_resample_short_and_still(spark):
    got = resample.resample(table(spark, {1: [(1, 2, 3)], 2: [(0, 0, 0), (1, 1, 1)]}), 5).collect()
    assert len(got) == 10 and all((r.x, r.y, r.z) == (1, 2, 3) for r in got if r.seq_id == 1)


def test_circumcentre(spark):
    r = np.random.default_rng(0)
    tri = r.normal(size=(50, 9))
    names = [f"{a}{c}" for a in "abc" for c in "xyz"]
    d = spark.createDataFrame([tuple(map(float, t)) for t in tri] + [(3.0, 4.0, 5.0, 5.0, 4.0, 5.0, 3.0, 6.0, 5.0), (0.0,) * 3 + (1.0,) * 3 + (2.0,) * 3], ",".join(f"{n} double" for n in names))
    c = V.circumcentre(*(V.cols(*(f"{a}{x}" for x in "xyz")) for a in "abc"))
    got = d.select(*names, *(e.alias(f"o{i}") for i, e in enumerate(c))).collect()
    for g in got[:-1]:
        a, b, p = (np.array([g[f"{k}{x}"] for x in "xyz"]) for k in "abc")
        o = a + np.array([g.o0, g.o1, g.o2])
        assert max(abs(np.linalg.norm(o - q) - np.linalg.norm(o - a)) for q in (b, p)) < 1e-6 * max(1, np.linalg.norm(o))
    assert (got[50].o0, got[50].o1, got[50].o2) == pytest.approx((1, 1, 0)) and got[51].o0 is None


def rotation(r):
    q, m = np.linalg.qr(r.normal(size=(3, 3)))
    q = q * np.sign(np.diag(m))
    return q if np.linalg.det(q) > 0 else -q


def test_quaternion(spark):
    r = np.random.default_rng(1)
    ms = [np.eye(3), np.diag([1.0, -1, -1]), np.diag([-1.0, 1, -1]), np.diag([-1.0, -1, 1])] + [rotation(r) for _ in range(60)]
    d = spark.createDataFrame([(k, *map(float, m.ravel())) for k, m in enumerate(ms)], "k int," + ",".join(f"m{i} double" for i in range(9)))
    q = V.quaternion([[F.col(f"m{3 * i + j}") for j in range(3)] for i in range(3)])
    for g in d.select("k", *(e.alias(n) for e, n in zip(q, "wxyz", strict=True))).collect():
        w, x, y, z = g.w, g.x, g.y, g.z
        back = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        assert np.abs(back - ms[g.k]).max() < 1e-12 and w >= 0


def test_right_divide(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(2, 3, 3))
    d = spark.createDataFrame([(*map(float, a.ravel()), *map(float, b.ravel()))], ",".join(f"a{i} double" for i in range(9)) + "," + ",".join(f"b{i} double" for i in range(9)))
    m = V.right_divide(*([[F.col(f"{n}{3 * i + j}") for j in range(3)] for i in range(3)] for n in "ab"))
    got = d.select(*(m[i][j].alias(f"c{i}{j}") for i in range(3) for j in range(3))).first()
    assert np.abs(np.array(got).reshape(3, 3) - a @ np.linalg.inv(b)).max() < 1e-10


def brute_prefix(points, width):
    """Longest prefix by vertical distances of points from all chords that span them."""
    best = 0
    for view in segmentation.VIEWS:
        p = [view(*q) for q in points]
        for k in range(1, len(p) + 1):
            if k > 1 and p[k - 1][0] < p[k - 2][0]:
                break
            thick = 0
            for a in p[:k]:
                for b in p[:k]:
                    for c in p[:k]:
                        if a[0] < b[0] and a[0] <= c[0] <= b[0]:
                            y = a[1] + (b[1] - a[1]) * (c[0] - a[0]) / (b[0] - a[0])
                            thick = max(thick, abs(c[1] - y))
                        elif a[0] == b[0] == c[0]:
                            thick = max(thick, abs(a[1] - b[1]))
            if thick >= width - 1e-9:
                break
            wide = p[0][0] != p[k - 1][0]
            if best == 0 and wide:
                best = 1
            if best and k - 1 >= best:
                best = k
    return best


def test_blurred_segment_prefix():
    r = random.Random(4)
    for _ in range(40):
        x, p = (0, 0), []
        for _ in range(9):
            p.append(x)
            x = (x[0] + r.randint(-3, 6), x[1] + r.randint(-4, 4))
        assert segmentation.longest_prefix(p, 5) == brute_prefix(p, 5)
    assert segmentation.longest_prefix([(k, k) for k in range(5)], 5) == 5 and segmentation.longest_prefix([(1, 1)] * 4, 5) == 0


def test_segments_cover_and_overlap(spark, helices):
    g = sequence.grid_range(sequence.remove_repeats(helices))
    rows = segmentation.maximal_segments(g, 5).orderBy("seq_id", "seg_id").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        if a.seq_id == b.seq_id:
            assert a.b < b.b and a.e <= b.e and b.b <= a.e + 1
    assert segmentation.maximal_segments(g.filter("t = 1"), 5).filter("status = 'short'").count() == 4


def test_key_points_are_the_sequential_rule(spark):
    r = random.Random(6)
    segs, n = [], 40
    b, e = 1, 4
    while e < n:
        segs.append((b, e))
        b, e = b + r.randint(1, 3), e + r.randint(1, 4)
    segs.append((b, n))
    d = spark.createDataFrame([(1, k + 1, x, y) for k, (x, y) in enumerate(segs)], "seq_id long, seg_id long, b long, e long")
    t = spark.createDataFrame([(1, k) for k in range(1, n + 1)], "seq_id long, t long")
    for row in geometry.key_points(t, d).collect():
        assert row.l == next(x for x, y in segs if y >= row.t) and row.r == [y for x, y in segs if x <= row.t][-1]


def test_descriptor_is_rotation_equivariant(spark, helices):
    m = rotation(np.random.default_rng(3))
    turned = helices.select("seq_id", "t", *(sum((F.col(c) * float(m[i, j]) for j, c in enumerate("xyz")), F.lit(0.0)).alias(n) for i, n in enumerate("xyz")))
    k = geometry.key_points(helices, geometry.fixed_segments(helices))
    a = geometry.frames(helices, k).filter("status = 'ok'").orderBy("seq_id", "t").collect()
    b = geometry.frames(turned, k).filter("status = 'ok'").orderBy("seq_id", "t").collect()
    for x, y in zip(a, b, strict=True):
        for axis in "tnb":
            u, v = (np.array([r[f"{axis}{c}"] for c in "xyz"]) for r in (x, y))
            assert np.abs(m @ u - v).max() < 1e-6 and abs(np.linalg.norm(u) - 1) < 1e-9
    q = geometry.rotation_velocity(helices, geometry.frames(helices, k)).filter("qw is not null").collect()
    assert q and all(abs(r.qw**2 + r.qx**2 + r.qy**2 + r.qz**2 - 1) < 1e-9 and r.qw >= 0 for r in q)


def test_whole_descriptor(spark, helices):
    got = segmentation.local_descriptor(helices)
    assert got.count() == helices.count() - 4 * 4 and got.filter("qw is not null").count() > 100


def test_fill_inverts_remove(spark):
    d = table(spark, {1: [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0), (0, 0, 0)], 2: [(5, 5, 5)]})
    kept = sequence.remove_repeats(d)
    assert kept.count() == 4
    assert sorted(map(tuple, sequence.fill_repeats(d, kept, "x", "y", "z").collect())) == sorted(map(tuple, d.collect()))


def test_differential_invariants_of_a_circle(spark):
    a = np.arange(12) * 0.3
    got = sequence.differential_invariants(table(spark, {1: np.column_stack([2 * np.cos(a), 2 * np.sin(a), 0 * a]), 2: [(k, 0, 0) for k in range(6)]})).orderBy("seq_id", "t").collect()
    inner = [r for r in got if r.seq_id == 1][2:-2]
    assert all(abs(r.curvature - 0.5) < 1e-9 and abs(r.torsion) < 1e-9 for r in inner)
    assert got[0].curvature == 0 and all(r.curvature in (0, None) or abs(r.curvature) < 1e-9 for r in got if r.seq_id == 2)


def test_shape_context_counts(spark, helices):
    b = pairwise.shape_bins(helices, pairwise.mean_distance(helices), outer=100.0)
    n = {r.seq_id: r["count"] for r in helices.groupBy("seq_id").count().collect()}
    assert {r.seq_id: r.n for r in pairwise.shape_context(b).groupBy("seq_id").agg(F.sum("cnt").alias("n")).collect()} == {k: v * v for k, v in n.items()}
    m = pairwise.shape_context_marginals(b)
    assert m.filter("alpha is null").agg(F.sum("cnt")).first()[0] == m.filter("theta is null").agg(F.sum("cnt")).first()[0] == sum(v * v for v in n.values())


def test_fisher_formula(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(11, 3))
    gmm = [(0.3, [0.1, 0.0, -0.2], [0.5, 1.0, 2.0]), (0.3, [1.0, -1.0, 0.0], [1.5, 0.7, 0.4]), (0.4, [-0.5, 0.5, 0.5], [1.0, 1.0, 1.0])]
    logs = np.array([[math.log(p) - 0.5 * sum(math.log(2 * math.pi * v) + (a - m) ** 2 / v for a, m, v in zip(row, mu, var, strict=True)) for p, mu, var in gmm] for row in x])
    q = np.exp(logs - logs.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    u = np.array([(q[:, [k]] * (x - mu) / np.sqrt(var)).sum(0) / (11 * math.sqrt(p)) for k, (p, mu, var) in enumerate(gmm)])
    v = np.array([(q[:, [k]] * ((x - mu) ** 2 / np.array(var) - 1)).sum(0) / (11 * math.sqrt(2 * p)) for k, (p, mu, var) in enumerate(gmm)])
    want = np.concatenate([u.ravel(), v.ravel()])
    want = np.sign(want) * np.sqrt(np.abs(want))
    want /= np.linalg.norm(want)
    got = encoding.fisher(table(spark, {1: x}), ["x", "y", "z"], gmm, ["seq_id"]).collect()
    assert np.abs(np.array([r.val for r in sorted(got, key=lambda r: (r.part, r.k, r.d))]) - want).max() < 1e-9


def test_pyramid(spark):
    d = table(spark, {k: [(1, 1, 1)] * k for k in (1, 5, 31, 60)})
    c = encoding.pool(d, "count").collect()
    for k in (1, 5, 31, 60):
        for level in encoding.LEVELS:
            own = sorted((r.bin, r.cnt) for r in c if (r.seq_id, r.level) == (k, level))
            assert len(own) == level and [n for _, n in own] == [sum(math.ceil(i / (k / level)) == b for i in range(1, k + 1)) for b in range(1, level + 1)]


def test_sampler(spark):
    d = table(spark, {1: [(k, 0, 0) for k in range(6)], 2: [(k, 1, 1) for k in range(6)]})
    for total in (2, 12, 16, 24, 26, 100):
        got = encoding.stratified_sample(d, total).groupBy("seq_id", "t").count().collect()
        quota = math.floor(total / 2 + 0.5)
        assert sum(r["count"] for r in got) == 2 * quota and max(r["count"] for r in got) - min(r["count"] for r in got) <= (0 if quota < 6 else 1)
    for bad in (0, -1):
        with pytest.raises(ValueError, match="positive"):
            encoding.stratified_sample(d, bad)
    with pytest.raises(ValueError, match="zero"):
        encoding.fill_to_quota(d.filter("t = 1 and seq_id = 1"), 5, "x", "y", "z")


def test_mixture(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(60, 3)), r.normal(size=(60, 3)) * 0.5 + 5])
    gmm, history = encoding.fit_gmm(table(spark, {1: x}), ["x", "y", "z"], 2, iterations=15)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:], strict=False))
    assert sum(p for p, _, _ in gmm) == pytest.approx(1) and min(min(v) for _, _, v in gmm) >= 1e-6
    assert sorted(round(m[0]) for _, m, _ in gmm) == [0, 5]


def test_encode(spark, helices):
    got = encoding.encode(helices, ["x", "y", "z"], k=2, samples=100).collect()
    assert len(got) == 4 and {len(r.code) for r in got} == {2 * 15 * 2 * 2 * 3} and all(abs(np.linalg.norm(r.code) - math.sqrt(2)) < 1e-9 for r in got)


def test_pca(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(200, 3)) * [10, 2, 0.1]
    p = encoding.pca(table(spark, {1: x}), ["x", "y", "z"], 0.999)
    assert p.shape[1] == 1 and abs(p[0, 0]) > 0.99


def test_l1_quadratic_optimum():
    r = np.random.default_rng(10)
    b = r.normal(size=(4, 7))
    a, c, lam = b.T @ b + 0.01 * np.eye(7), r.normal(size=7), 0.3
    c = np.stack([c, r.normal(size=7), 0 * c])
    on = np.ones(c.shape, bool)
    on[1, ::2] = False
    for x, v, use in zip(encoding.l1_quadratic(a, c, lam, on), c, on, strict=True):
        g = a @ x + v
        assert all(abs(g[j] + lam * np.sign(x[j])) < 1e-6 if x[j] else not use[j] or abs(g[j]) <= lam + 1e-9 for j in range(7))


def test_basis_lowers_the_error(spark, helices):
    names = ["x", "y", "z"]
    x = np.array([[r[c] for c in names] for r in helices.collect()])

    def error(b):
        s = np.array([r.code for r in encoding.sparse_codes(helices, names, b, 0.05).collect()])
        return ((x - s @ b.T) ** 2).sum()

    first = np.random.default_rng(1).normal(size=(3, 4))
    learnt = encoding.learn_basis(helices, names, 4, 0.05, rounds=4)
    assert error(learnt) < error(first / np.linalg.norm(first, axis=0)) and np.linalg.norm(learnt, axis=0).max() <= 1 + 1e-9


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(11)
    rows = [(k, [float(v) for v in r.normal(size=4) + 3 * np.eye(4)[k % 3]], k % 3 + 1) for k in range(150)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


def test_gradients(labelled):
    r = np.random.default_rng(12)
    t = r.normal(size=(4, 3))
    _, g = classify.ridge_objective(labelled, t, 0.4)
    for i, j in ((0, 0), (2, 1), (3, 2)):
        e = np.zeros_like(t)
        e[i, j] = 1e-5
        assert (classify.ridge_objective(labelled, t + e, 0.4)[0] - classify.ridge_objective(labelled, t - e, 0.4)[0]) / 2e-5 == pytest.approx(g[i, j], rel=1e-5)
    for groups in ([np.arange(4)], [np.array([0, 1]), np.array([2, 3])]):
        _, g = classify.mixed_norm(t, groups, 0.4, 0.7)
        num = np.array([[(classify.mixed_norm(t + d, groups, 0.4, 0.7)[0] - classify.mixed_norm(t - d, groups, 0.4, 0.7)[0]) / 2e-6 for d in (1e-6 * np.eye(12)[3 * i + j].reshape(4, 3) for j in range(3))] for i in range(4)])
        assert np.abs(num - g).max() < 1e-6
    assert not classify.mixed_norm(np.zeros((4, 3)), [np.arange(4)], 1, 1)[1].any()


def test_classifiers(labelled):
    ridge = classify.fit_ridge(labelled, 3, 0.1)
    assert np.abs(classify.ridge_objective(labelled, ridge, 0.1)[1]).max() < 1e-6
    hinge = classify.fit_squared_hinge(labelled, 3)
    assert classify.accuracy(classify.predict(labelled, hinge[:-1], hinge[-1])).first()[0] > 0.9
    _, values = classify.fit_mixed(labelled, 3, [np.arange(2), np.arange(2, 4)], 0.1, 0.1, rounds=8)
    assert all(b < a for a, b in zip(values, values[1:], strict=False))
    assert classify.accuracy(classify.predict_pairwise(labelled, classify.fit_pairwise_svm(labelled, rounds=10))).first()[0] > 0.85
    assert classify.accuracy(classify.predict_forest(labelled, classify.fit_forest(labelled, trees=5, depth=4))).first()[0] > 0.85
    c = classify.confusion(labelled.withColumn("prediction", F.lit(1)), 4).orderBy("label").collect()
    assert [tuple(r) for r in c] == [(1, 50, 0, 0, 0), (2, 50, 0, 0, 0), (3, 50, 0, 0, 0), (4, 0, 0, 0, 0)]


def test_optimisers():
    f = lambda x: (float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    assert np.abs(classify.conjugate_gradient(f, np.array([-1.2, 1.0]), 500, 1e-14)[0] - 1).max() < 1e-2
    assert np.abs(classify.lbfgs(f, np.array([-1.2, 1.0]), 200, tol=1e-12)[0] - 1).max() < 1e-4


def test_sparse_arrays(spark):
    r = np.random.default_rng(13)
    a, b = ((r.integers(-2, 3, size=s)).astype(float) for s in ((4, 3), (3, 5)))
    put = lambda m, n: ndsparse.build(spark.createDataFrame([(*(k + 1 for k in i), float(v)) for i, v in np.ndenumerate(m)], ",".join(f"{x} int" for x in n) + ", val double"))
    back = lambda d, n, s: (lambda o: ([o.__setitem__(tuple(r[k] - 1 for k in n), r.val) for r in d.collect()], o)[1])(np.zeros(s))
    x, y = put(a, "ij"), put(b, "jk")
    assert (back(ndsparse.multiply(x, y, "j"), "ik", (4, 5)) == a @ b).all()
    for how, f in (("sum", np.sum), ("mean", np.mean), ("max", np.max), ("min", np.min)):
        assert np.allclose(back(ndsparse.reduce(x, "j", 3, how), "i", (4,)), f(a, axis=1))
    assert (back(ndsparse.reshape(x, {"i": 4, "j": 3}, {"p": 6, "q": 2}), "pq", (6, 2)) == a.reshape(6, 2, order="F")).all()
    assert (back(ndsparse.shift(x, "i", 4, 1), "ij", (4, 3)) == np.roll(a, 1, 0)).all() and (back(ndsparse.flip(x, "j", 3), "ij", (4, 3)) == a[:, ::-1]).all()
    assert (back(ndsparse.dense(x, {"i": 4, "j": 3}), "ij", (4, 3)) == a).all() and ndsparse.dense(x, {"i": 4, "j": 3}).count() == 12
    kernel = np.array([[1.0, 2.0], [0.0, -1.0]])
    full = np.zeros((5, 4))
    for (p, q), v in np.ndenumerate(kernel):
        full[p : p + 4, q : q + 3] += v * a
    assert (back(ndsparse.convolve(x, put(kernel, "ij")), "ij", (5, 4)) == full).all()
    assert [(r["j"], round(r["val"], 9)) for r in ndsparse.solve(put(np.array([[2.0, 0], [0, 4.0]]), "ij"), put(np.array([2.0, 8.0]), "i")).orderBy("j").collect()] == [(1, 1.0), (2, 2.0)]


def test_integral_invariants(spark, helices):
    got = integral.integral_invariants(helices).collect()
    assert all(0 <= r.osculating <= 0.6 for r in got) and {r.osculating for r in got if r.t == 1} == {0.5}


def test_gradient_histograms():
    # all cells are of unit length before the innermost are added up; test_gradients compares with a literal vote
    h = integral.polar_gradients(np.add.outer(np.arange(12.0), np.zeros(12)))
    assert h.shape == (12, 150) and (h >= 0).all() and (np.linalg.norm(h, axis=1) > 0.5).all()


def test_text_records(spark, tmp_path):
    (tmp_path / "rec_03_07_1_2.txt").write_text("2 12\n" + " ".join(f"{k},5" for k in range(12)) + "\n" + " ".join(f"{k},25" for k in range(12)))
    got = trajectories.read_text_records(spark, str(tmp_path)).orderBy("t").collect()
    assert len(got) == 2 and (got[0].person_id, got[0].gesture_id, got[0].session_id, got[0].record_id) == (3, 7, 1, 2) and got[0].left.x == 3.5 and got[1].wrist.z == 11.25


def test_skeletons_and_split(spark):
    cells = spark.createDataFrame([(1, 2, [(8, [[(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], [(7.0, 8.0, 9.0)]]), (9, [[(0.0, 0.0, 0.0)]])])], "class_id int, subject_id int, skeleton array<struct<joint_id: int, instances: array<array<struct<x: double, y: double, z: double>>>>>")
    rows = trajectories.from_skeletons(cells, [8, 12]).orderBy("instance", "t").collect()
    assert [(r.joint_id, r.instance, r.t, r.x) for r in rows] == [(8, 1, 1, 1.0), (8, 1, 2, 4.0), (8, 2, 1, 7.0)]
    people = spark.createDataFrame([(k,) for k in range(6)], "person long")
    listed, strict = people.filter("person < 3"), people.filter("person = 4")
    assert sorted((r.person, r.split) for r in trajectories.split_by_membership(people, listed, "person", strict).collect()) == [(0, "train"), (1, "train"), (2, "train"), (4, "test")]


def test_stages(spark, tmp_path, helices):
    assert trajectories.write_stage(helices, str(tmp_path / "s"), "seq_id").count() == helices.count()
    made = []
    make = lambda: (made.append(1), helices)[1]
    for _ in range(2):
        assert trajectories.cached_artifact(spark, str(tmp_path / "c"), make).count() == helices.count()
    assert made == [1]


def test_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    from strandline.streaming import sessions

    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=k), float(k), 0.0, 0.0) for k in range(10)] + [("a", t0 + timedelta(hours=1, seconds=k), 1.0, 1.0, 1.0) for k in range(3)] + [("z", t0 + timedelta(hours=9), 0.0, 0.0, 0.0)]
    schema = "key string, ts timestamp, x double, y double, z double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    sessions.describe_stream(points, sequence.square_root_velocity, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("seq_id").count().collect()) == [3, 10]


def test_describe(spark, helices):
    from strandline.operators import describe

    n = helices.count()
    for m, width in (("velocity", 3), ("differential", 4), ("integral", 2), ("local", 7), ("shape", 810), ("similarity_gradients", 150)):
        rows = describe.describe(helices, m).collect()
        assert len(rows) == n - 16 and {len(r.d) for r in rows} == {width}, m
    assert {len(r.d) for r in describe.two_hands(helices, helices, "velocity").collect()} == {6}
    got = describe.shape_pyramid(helices).groupBy("seq_id").agg(F.sum(F.col("val") * F.col("val")).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in got)
    with pytest.raises(ValueError, match="method"):
        describe.describe(helices, "other")
