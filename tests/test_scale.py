"""Steps that grow no faster than their input: what is not shuffled, and the same results as the plain form, whatever the batches."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import describe, encoding, geometry, integral, pairwise, segmentation, sequence


@pytest.fixture(scope="module")
def walks(spark):
    rng = random.Random(9)
    rows = []
    for s, n in ((1, 41), (2, 5), (3, 3), (4, 12), (7, 90), (8, 17)):
        x = [0.0, 0.0, 0.0]
        for t in range(1, n + 1):
            x = [v + rng.uniform(-1, 1) for v in x]
            rows.append((s, t, None if s == 4 and t == 3 else x[0], x[1], x[2]))
    return spark.createDataFrame(rows, "seq_id long, t long, x double, y double, z double").repartition(3)


@pytest.fixture(params=[3, 10_000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def after_python(df):
    """The plan's steps that follow its last Python step."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def plain(df, *floats):
    return sorted(tuple(map(str, r)) for r in df.withColumns({c: F.round(c, 9) for c in floats}).select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("size", [5, 256])
def test_histograms_leave_their_task_whole(walks, monkeypatch, batches, size):
    monkeypatch.setattr(pairwise, "TILE", size)
    mean = walks.select("seq_id").distinct().withColumn("mean_dist", F.lit(2.3017))
    got, want = pairwise.shape_histogram(walks, mean), pairwise.shape_context(pairwise.shape_bins(walks, mean))
    assert "Aggregate" not in after_python(got) and plain(got) == plain(want)
    code = ((F.col("radius") - 1) * 9 + F.col("alpha") - 1) * 18 + F.col("theta") - 1
    rows = pairwise.shape_rows(walks, mean).select("seq_id", "t", F.inline(F.arrays_zip("code", "cnt")))
    assert plain(rows.select("seq_id", "t", "code", "cnt")) == plain(want.select("seq_id", "t", code.alias("code"), "cnt"))


@pytest.mark.parametrize("size", [5, 256])
def test_marginals_are_counted_in_the_tasks(walks, monkeypatch, batches, size):
    monkeypatch.setattr(pairwise, "TILE", size)
    mean = walks.select("seq_id").distinct().withColumn("mean_dist", F.lit(2.3017))
    got = pairwise.shape_marginals(walks, mean)
    assert not {"Aggregate", "Expand"} & set(after_python(got).split())
    assert plain(got) == plain(pairwise.shape_context_marginals(pairwise.shape_bins(walks, mean)))


def _cells(walks):
    b = pairwise.shape_histogram(walks, pairwise.mean_distance(walks))
    i = ((F.col("radius") - 1) * 9 + F.col("alpha") - 1) * 18 + F.col("theta") - 1
    return b.select("seq_id", "t", i.cast("int").alias("i"), "cnt")


def test_dense_shapes_are_filled_by_place(walks, batches):
    got = describe.describe(walks, "shape")
    assert "Aggregate" not in after_python(got) and "element_at" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter(F.size("d") != 810).isEmpty()
    inner = sequence.trim(_cells(walks).select("seq_id", "t").distinct())
    want = _cells(walks).join(inner, ["seq_id", "t"]).select("seq_id", "t", "i", F.col("cnt").cast("double").alias("v"))
    assert plain(got.select("seq_id", "t", F.posexplode("d").alias("i", "v")).filter("v <> 0")) == plain(want)


def test_shape_pyramid_joins_no_bins(walks, batches):
    got = describe.shape_pyramid(walks)
    assert not {"Join", "Aggregate", "Window"} & set(after_python(got).split())
    bins = encoding.pyramid(sequence.trim(_cells(walks).select("seq_id", "t").distinct()))
    c = _cells(walks).join(bins, ["seq_id", "t"]).groupBy("seq_id", "level", "bin", "i").agg(F.sum("cnt").cast("double").alias("val"))
    want = c.withColumn("val", F.col("val") / F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy("seq_id"))))
    assert plain(got, "val") == plain(want, "val")


MIXTURE = [(0.4, [0.5, -0.5, 0.0], [1.0, 2.0, 0.5]), (0.6, [-1.0, 1.0, 0.3], [0.7, 1.5, 3.0])]


def test_codes_leave_their_task_whole(walks, batches):
    d = sequence.drop_missing(walks).filter("seq_id <> 4")
    got = encoding.encode(d, ["x", "y", "z"], gmm=MIXTURE)
    assert not {"Aggregate", "Window", "Generate", "Join"} & set(after_python(got).split())
    n = F.floor(F.count("*").over(W.partitionBy("seq_id")) / 2)
    for part in (1, 2):
        p = d.withColumn("_len", n).filter(F.ceil(F.col("t") / F.col("_len")) == part).withColumn("t", F.col("t") - (part - 1) * F.col("_len")).drop("_len")
        f = encoding.fisher_pyramid(p, ["x", "y", "z"], MIXTURE)
        at = (part - 1) * 180 + (F.col("level") - 1 + F.col("bin") - 1) * 12 + F.when(F.col("part") == "v", 6).otherwise(0) + F.col("k") * 3 + F.col("d")
        want = {(r["seq_id"], r["i"]): r["val"] for r in f.select("seq_id", at.cast("int").alias("i"), "val").collect()}
        rows = got.collect()
        assert {r["seq_id"] for r in rows} == {s for s, _ in want} == {1, 2, 3, 7, 8} and len(rows) == 5
        for r in rows:
            assert len(r["code"]) == 360
            assert all(abs(r["code"][i] - want.get((r["seq_id"], i), 0.0)) < 1e-9 for i in range((part - 1) * 180, part * 180))


def test_sample_is_worked_out_once(walks):
    d = sequence.drop_missing(walks)
    s = encoding.fill_to_quota(d, 30, "x", "y", "z")
    assert "Window" not in s._jdf.queryExecution().optimizedPlan().toString() and s.count() >= 30


def test_mixture_by_blocks_is_that_by_rows(walks, monkeypatch):
    monkeypatch.setattr(encoding, "BLOCK", 7)
    d, names = sequence.drop_missing(walks), ["x", "y", "z"]
    gmm, history = encoding.fit_gmm(d, names, 2, iterations=1)
    again, longer = encoding.fit_gmm(d, names, 2, iterations=2)
    step = encoding.em_step(d, names, gmm).orderBy("k").collect()
    assert len(history) == 1 and len(longer) == 2 and abs(step[0]["ll"] - longer[1]) < 1e-8
    for r, (prior, mean, var) in zip(step, again, strict=True):
        assert abs(r["prior"] - prior) < 1e-9
        assert all(abs(r[f"mean{j}"] - mean[j]) < 1e-9 and abs(r[f"var{j}"] - var[j]) < 1e-9 for j in range(3))


def test_codes_of_two_modalities_are_not_broadcast(walks):
    d = sequence.drop_missing(walks)
    two = encoding.encode_two(d, ["x", "y", "z"], d, ["x", "y", "z"], gmm=MIXTURE)
    assert "Broadcast" not in two._jdf.queryExecution().executedPlan().toString()


def test_gradients_hold_squares_along_the_diagonal(walks, batches):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(150, 15)).cumsum(0)
    a = integral._gaps(p, p)
    want = integral.polar_gradients(np.floor(a / a.max() * 65535))
    assert all(np.allclose(integral.patch_gradients(p, block=b), want, atol=1e-9) for b in (16, 64, 149, 256))
    patches = sequence.patches(sequence.drop_missing(walks), 2, "x", "y", "z")
    got = integral.path_gradients(patches)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    cells = lambda df: df.select("seq_id", "t", F.posexplode("hog").alias("i", "v"))
    assert plain(cells(got), "v") == plain(cells(integral.similarity_gradients(pairwise.self_similarity(patches))), "v")


def test_segments_of_many_sequences_come_in_batches(spark, batches):
    rng = random.Random(3)
    rows = [(s, t, None if s == 5 or (s + t) % 37 == 0 else rng.randrange(30), rng.randrange(30), rng.randrange(30)) for s in range(1, 301) for t in range(1, 2 + s % 13)]
    grid = spark.createDataFrame(rows, "seq_id long, t long, gx long, gy long, gz long")
    got = segmentation.maximal_segments(grid)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for s in range(1, 301):
        own = segmentation.segments(np.array([r[2:] for r in rows if r[0] == s and r[2] is not None], dtype=np.int64).reshape(-1, 3), 5)
        want += [(s, k, b, e, "ok") for k, (b, e) in enumerate(own, 1)] or [(s, 0, 0, 0, "short")]
    assert sorted(map(tuple, got.collect())) == want and {x[4] for x in want} == {"ok", "short"}


def test_frames_meet_their_key_points_without_a_join(spark, walks):
    """Same frames as by joins, of keys that lie anywhere; a frame with a key that is no row is left out."""
    rng = random.Random(3)
    last = {r["seq_id"]: r["n"] for r in walks.groupBy("seq_id").agg(F.max("t").alias("n")).collect()}
    keys = spark.createDataFrame([(s, t, rng.randint(1, n), rng.randint(1, n + 1)) for s, n in last.items() for t in range(1, n + 1)], "seq_id long, t long, l long, r long")
    side = lambda k: walks.select("seq_id", F.col("t").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz"))
    want = walks.withColumn("n", F.count("*").over(W.partitionBy("seq_id"))).join(keys, ["seq_id", "t"]).join(side("l"), ["seq_id", "l"]).join(side("r"), ["seq_id", "r"]).drop("l", "r")
    got = geometry._beside(walks, keys)
    assert plain(got) == plain(want) and got.count() < keys.count()
    dealt = sequence.spread(walks)
    fixed = geometry.key_points(dealt, geometry.fixed_segments(dealt))
    moved = geometry.rotation_velocity(dealt, geometry.frames(dealt, fixed, points=True))
    assert "Join" not in moved._jdf.queryExecution().optimizedPlan().toString()
    assert plain(moved, "qw", "qx", "ux") == plain(geometry.rotation_velocity(dealt, geometry.frames(dealt, fixed)), "qw", "qx", "ux")


@pytest.mark.parametrize("ends", [0, 2])
def test_velocity_pyramid_copies_no_row_and_joins_no_bin(walks, ends):
    """Same codes as by a copy of every row a level and a join with all bins."""
    s = ["sx", "sy", "sz"]
    got = describe.velocity_pyramid(walks, ends)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Aggregate")
    v = sequence.trim(sequence.square_root_velocity(sequence.unit_scale(walks)), ends).withColumn("t", F.col("t") - ends)
    c = encoding.all_bins(walks).join(encoding.pool(v, "sum", *s), ["seq_id", "level", "bin"], "left").fillna(0.0)
    c = c.withColumn("_size", F.sqrt(F.sum(sum(F.col(k) * F.col(k) for k in s)).over(W.partitionBy("seq_id"))))
    assert plain(got, *s) == plain(c.select("seq_id", "level", "bin", *(F.when(F.col("_size") > 0, F.col(k) / F.col("_size")).otherwise(0.0).alias(k) for k in s)), *s)


def grown(g, width, recheck):
    """The scan of one curve with every piece grown point by point."""
    rows, n = g.tolist(), len(g)
    views = [[[view(p[0], p[axis]) for p in rows] for view in segmentation.VIEWS] for axis in (1, 2)]
    accepted = lambda b, k: segmentation.Piece(views, b - 1, k, width, recheck).accepted()
    if n < 2:
        return []
    k = next((k for k in range(2, n + 1) if accepted(1, k) < k), n)
    out, b = [(1, min(accepted(1, k), n))], 1
    while k < n:
        b = next(c for c in range(b + 1, k + 1) if c == k or accepted(c, k) == k - c + 1)
        k = next((e for e in range(k + 1, n + 1) if accepted(b, e) < e - b + 1), n)
        out.append((b, k - 1))
    return out


def test_short_pieces_of_many_curves_are_worked_out_side_by_side(monkeypatch):
    rng = np.random.default_rng(8)
    curves = [np.zeros((0, 3), int), np.full((14, 3), 4), np.column_stack([np.arange(30), np.arange(30) // 3, np.zeros(30, int)])]
    for most in (1, 3, 12, 40):
        steps = [rng.integers(-most, most + 1, size=(n, 3)) for n in rng.integers(0, 35, 12)]
        curves += [*steps, *(s.cumsum(0) for s in steps), *(np.abs(s).cumsum(0) for s in steps)]
    curves.append(curves[-1] * 2**40)
    for some in (curves, curves[:-1]):
        for width, recheck in ((1, False), (5, True), (6, False)):
            want = [grown(g, width, recheck) for g in some]
            for block in (7, 8192):
                assert segmentation.segments_of(np.concatenate(some), np.cumsum([len(g) for g in some]), width, recheck, block) == want
    rough = rng.integers(0, 1000, size=(4000, 3))
    monkeypatch.setattr(segmentation, "Piece", None)  # none is grown where curves leave a strip at once
    assert all(len(s) > 20 for s in segmentation.segments_of(rough, np.arange(40, 4001, 40), 6))


def shares(p, width=6, radius=0.1):
    """Integral invariants sample by sample, along the definition."""
    q = p[[k for k in range(len(p)) if k == 0 or (p[k] != p[k - 1]).any()]]
    n, out, cell = len(q), np.full((len(q), 2), 0.5), 2 * radius / 500
    span = np.ptp(q, axis=0).max()
    if n > 3 and span > 0:
        q = (q - q.min(0)) / span
        seg = grown(np.floor(q * 1000 + 0.5).astype(int), width, False)
        unit = lambda v: v / np.linalg.norm(v)
        for i in range(1, n - 2):
            left = q[next((b for b, e in seg if e >= i + 1), seg[-1][0]) - 1]
            right = q[max(e for b, e in seg if b <= i + 1) - 1]
            w = np.cross(q[i] - left, right - left)
            if not w.any():
                continue
            u, v = q[i] - left, right - left
            normal = unit(np.cross(u @ u * v - v @ v * u, w) / (2 * w @ w) - u)
            binormal = unit(np.cross(unit(q[i] - left), unit(right - q[i])))
            tangent = np.cross(normal, binormal)
            for j, (off, up) in enumerate(((binormal, normal), (normal, binormal))):
                flat, area = (q - q[i]) - np.outer((q - q[i]) @ off, off), 0.0
                for step in (-1, 1):
                    k = i
                    while 0 <= k + step < n:
                        edge = (flat[k + step] - flat[k]) * step
                        stride = cell / (edge @ tangent / np.linalg.norm(edge))
                        for m in range(1, int(abs(np.trunc(np.linalg.norm(edge) / stride))) + 1):
                            at = flat[k] + step * m * abs(stride) * unit(edge)
                            if at @ at < radius**2:
                                area += cell * (np.sqrt(abs(radius**2 - (at @ tangent) ** 2)) - at @ up) * np.sign(stride)
                        k += step
                        if np.linalg.norm(flat[k]) > radius:
                            break
                area /= np.pi * radius**2
                out[i, j] = abs(area) if j else 1 - area if area > 0.5 else area
    places = np.cumsum([k == 0 or (p[k] != p[k - 1]).any() for k in range(len(p))]) - 1
    return out[places]


def test_integral_invariants_take_many_sequences_side_by_side(spark, walks, batches):
    still = spark.createDataFrame([(s, t, float(t // 2 * (s > 20)), 1.0, float((t // 2) ** 2 % 5)) for s in (20, 21) for t in range(1, 12)], walks.schema)
    d = walks.unionByName(still.filter("seq_id > 20 or t < 3"))
    got = integral.integral_invariants(d)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    have = {(r.seq_id, r.t): (r.osculating, r.rectifying) for r in got.collect()}
    rows = sorted((r.seq_id, r.t, *(np.nan if c is None else c for c in (r.x, r.y, r.z))) for r in d.collect())
    want = {}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        want |= {(s, r[1]): v for r, v in zip(own, shares(np.array([r[2:] for r in own])), strict=True)}
    assert have.keys() == want.keys() and len({v for v in have.values()}) > 100
    assert all(np.allclose(have[k], want[k], atol=1e-9, equal_nan=True) for k in want)
