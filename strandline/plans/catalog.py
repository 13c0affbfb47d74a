"""Named queries over the driver's tables, with the SQL that gives the same rows.

Events are read as trajectories, embeddings as feature vectors; values are rounded at the edge of a query so that two
engines' sums agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.functions import vector as V
from strandline.operators import classify, describe, encoding, geometry, integral, ndsparse, pairwise, resample, segmentation, sequence
from strandline.plans import sql
from strandline.sources import trajectories

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
ODD = [1, 3, 5, 7, 9, 11]
XYZ = ["x", "y", "z"]


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def traj(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.from_events(spark.read.parquet(f"{d}/events.parquet"))


def coarse(spark: SparkSession, d: str) -> DataFrame:
    return traj(spark, d).select("seq_id", "t", F.floor(F.col("x") / 50).cast("double").alias("x"), F.floor(F.col("y") / 50).cast("double").alias("y"), F.floor(F.col("z") / 30).cast("double").alias("z"))


def emb(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"), (F.col("label") + 1).alias("label"))


def rounded(df: DataFrame, k: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, k) + F.lit(0.0) for n in names})


def theta() -> np.ndarray:
    """Fixed weights (64, 10) that the SQL builds by the same rule."""
    d, c = np.meshgrid(np.arange(64), np.arange(10), indexing="ij")
    return ((d * 7 + c * 3) % 5 - 2) / 10.0


# sequences


@query
def srvf(s, d):
    return rounded(sequence.square_root_velocity(traj(s, d)), 6, "sx", "sy", "sz")


@query
def gradient(s, d):
    return rounded(sequence.gradient(traj(s, d), *XYZ).select("seq_id", "t", "vx", "vy", "vz"), 6, "vx", "vy", "vz")


@query
def drop_missing(s, d):
    return sequence.drop_missing(traj(s, d).withColumn("x", F.when(F.col("y") == 0, F.lit(float("nan"))).otherwise(F.col("x")))).select("seq_id", "t")


@query
def repeat_removal(s, d):
    return sequence.remove_repeats(coarse(s, d)).select("seq_id", "t", "orig_t", *XYZ)


@query
def fill_repeat(s, d):
    c = coarse(s, d)
    return sequence.fill_repeats(c, sequence.remove_repeats(c), *XYZ)


@query
def grid_range(s, d):
    return sequence.grid_range(traj(s, d))


@query
def grid_mean(s, d):
    t = traj(s, d)
    return sequence.grid_mean(t.join(pairwise.mean_distance(t), "seq_id"), F.col("mean_dist"), 100_000)


@query
def unit_scale(s, d):
    return rounded(sequence.unit_scale(traj(s, d)), 6, *XYZ, "scale")


@query
def next_frame(s, d):
    return sequence.next_frame(traj(s, d), "x").select("seq_id", "t", "next_x")


@query
def trim(s, d):
    return sequence.trim(traj(s, d)).select("seq_id", "t")


@query
def arc_length(s, d):
    return rounded(sequence.arc_length(traj(s, d)), 6, "arc", "radius")


@query
def absent_hand(s, d):
    return sequence.absent(traj(s, d))


@query
def two_hands(s, d):
    t = traj(s, d)
    return sequence.concat_hands(t, t.withColumns({"x": 2 * F.col("x"), "y": 2 * F.col("y")}), "x", "y")


def _members(s):
    return s.createDataFrame([(k,) for k in ODD], "label long")


@query
def split_semi(s, d):
    return traj(s, d).join(F.broadcast(_members(s)), "label", "left_semi").groupBy("seq_id").agg(F.count("*").alias("n"))


@query
def split_anti(s, d):
    return traj(s, d).join(F.broadcast(_members(s)), "label", "left_anti").groupBy("seq_id").agg(F.count("*").alias("n"))


@query
def split_train_test(s, d):
    t = trajectories.exclude(traj(s, d).drop("split"), F.col("label") == 12)
    return trajectories.split_by_membership(t, _members(s), "label").select("seq_id", "split").distinct()


@query
def labels(s, d):
    return trajectories.labels(traj(s, d))


@query
def distinct_labels(s, d):
    return traj(s, d).agg(F.count_distinct("label").alias("n"))


@query
def diff_invariants(s, d):
    return rounded(sequence.differential_invariants(traj(s, d)), 6, "curvature", "curvature_d", "torsion", "torsion_d")


# pairs


@query
def pair_distance(s, d):
    return rounded(pairwise.distances(traj(s, d)), 4, "d2")


@query
def mean_pair_dist(s, d):
    return rounded(pairwise.mean_distance(traj(s, d)), 6, "mean_dist")


@query
def ssm(s, d):
    return rounded(pairwise.self_similarity(sequence.patches(traj(s, d), 2, *XYZ)), 4, "s")


@query
def ssm_tanh(s, d):
    return rounded(pairwise.self_similarity(sequence.patches(traj(s, d), 2, *XYZ), 0.0005, 0.1), 6, "s")


@query
def shape_ctx_810(s, d):
    t = traj(s, d)
    return pairwise.shape_histogram(t, pairwise.mean_distance(t))


@query
def shape_ctx_inliers(s, d):
    t = traj(s, d)
    return pairwise.shape_histogram(t, pairwise.mean_distance(t), t.filter("t % 5 <> 0"))


@query
def shape_ctx_135(s, d):
    t = traj(s, d)
    return pairwise.shape_marginals(t, pairwise.mean_distance(t))


# geometry


def _keys(s, d):
    t = traj(s, d)
    return t, geometry.key_points(t, geometry.fixed_segments(t))


@query
def asof_keypoints(s, d):
    return _keys(s, d)[1]


@query
def orientation(s, d):
    """Turns of three points of large whole coordinates, nearly on a line: p, p + 3 q, and p + 7 q but for at most one unit in y."""
    t = traj(s, d).select("seq_id", "t", (F.floor(F.col("x") * 100) * 30_000_001).cast("double").alias("px"), (F.floor("y") * 70_000_003).cast("double").alias("py"), (F.floor("x") * 1_000_003 + F.col("t")).cast("double").alias("qx"), (F.floor("z") * 999_983 + 1).cast("double").alias("qy"))
    p, q = V.cols("px", "py"), V.cols("qx", "qy")
    at = lambda k, off: [p[0] + k * q[0], p[1] + k * q[1] + off]
    return t.select("seq_id", "t", geometry.turn(p, at(3, 0), at(7, F.col("t") % 3 - 1)).alias("turn"))


@query
def circumcentre(s, d):
    t, k = _keys(s, d)
    side = lambda n: t.select("seq_id", F.col("t").alias(n), *(F.col(c).alias(f"{n}{c}") for c in XYZ))
    j = t.join(k, ["seq_id", "t"]).join(side("l"), ["seq_id", "l"]).join(side("r"), ["seq_id", "r"])
    a, b, c = (V.cols(*(f"{n}{x}" for x in XYZ)) for n in ("l", "", "r"))
    w = V.cross(V.sub(b, a), V.sub(c, a))
    # a triangle that is nearly flat has a status and no centre: its place would be rounding error
    out = j.withColumn("flat", ~(2 * V.dot(w, w) > 1e3))
    out = out.select("seq_id", "t", "flat", *(F.when(~F.col("flat"), v).alias(f"c{x}") for v, x in zip(V.circumcentre(a, b, c), XYZ, strict=True)))
    return rounded(out, 3, "cx", "cy", "cz")


@query
def frames_fixed(s, d):
    return rounded(geometry.frames(*_keys(s, d)).drop("status"), 5, *geometry.AXES)


@query
def quat(s, d):
    t = traj(s, d).select("seq_id", "t", (F.col("x") % 7 - 3).alias("p"), (F.col("y") % 6 - 3).alias("w"))
    c, sn = F.cos, F.sin
    m = [[c("p") * c("w"), -sn("p"), c("p") * sn("w")], [sn("p") * c("w"), c("p"), sn("p") * sn("w")], [-sn("w"), F.lit(0.0), c("w")]]
    t = t.select("seq_id", "t", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)))
    q = V.quaternion([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return rounded(t.select("seq_id", "t", *(v.alias(n) for v, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True))), 6, "qw", "qx", "qy", "qz")


@query
def rrv_fixed(s, d):
    t, k = _keys(s, d)
    return rounded(geometry.rotation_velocity(t, geometry.frames(t, k, points=True)), 5, "qw", "qx", "qy", "qz", "ux", "uy", "uz")


@query
def mbs_segments(s, d):
    t = sequence.grid_range(traj(s, d))
    return segmentation.maximal_segments(t)


@query
def segment_strips(s, d):
    """The digital line of each segment, and how many points its strip regenerates."""
    t = sequence.grid_range(traj(s, d))
    lines = segmentation.strips(t, segmentation.maximal_segments(t))
    line = ["view", "a", "b", "low", "high"]
    return segmentation.strip_points(lines, *line).groupBy("seq_id", "seg_id", "plane", *line).agg(F.count("*").alias("points"))


@query
def lrf_descriptor(s, d):
    return rounded(segmentation.local_descriptor(traj(s, d)), 4, "qw", "qx", "qy", "qz", "ux", "uy", "uz")


@query
def resample64(s, d):
    return rounded(resample.resample(traj(s, d), 64), 4, *XYZ)


@query
def integral_inv(s, d):
    return integral.integral_invariants(traj(s, d))


@query
def ssm_hog(s, d):
    h = integral.path_gradients(sequence.patches(traj(s, d), 2, *XYZ))
    return rounded(h.select("seq_id", "t", F.posexplode("hog").alias("i", "v")), 4, "v").filter("v <> 0")


# encoding


@query
def pyramid_counts(s, d):
    return encoding.pool(traj(s, d), "count")


@query
def pyramid_sum(s, d):
    return rounded(encoding.pool(traj(s, d), "sum", "x", "y"), 6, "x", "y")


@query
def pyramid_max(s, d):
    return rounded(encoding.pool(traj(s, d), "max", "x", "y"), 6, "x", "y")


@query
def fisher_fixed_gmm(s, d):
    return rounded(encoding.fisher(traj(s, d), XYZ, sql.GMM, ["seq_id"]), 6, "val")


@query
def fisher_pyramid_fixed(s, d):
    return rounded(encoding.fisher_pyramid(traj(s, d), XYZ, sql.GMM), 6, "val")


@query
def em_one_step(s, d):
    e = encoding.em_step(traj(s, d), XYZ, sql.GMM).drop("ll")
    return rounded(rounded(rounded(e, 6, "prior"), 4, "mean0", "mean1", "mean2"), 3, "var0", "var1", "var2")


@query
def l2_normalise(s, d):
    v = V.l2(F.array(*XYZ))
    return rounded(traj(s, d).select("seq_id", "t", *(F.get(v, F.lit(i)).alias(f"n{c}") for i, c in enumerate(XYZ))), 6, "nx", "ny", "nz")


@query
def nonzero_rows(s, d):
    return encoding.drop_zero(coarse(s, d), *XYZ).select("seq_id", "t")


@query
def stratified_sample(s, d):
    t = traj(s, d)
    n = t.select("seq_id").distinct().count()
    return encoding.stratified_sample(t, 100 * n, n).select("seq_id", "t", F.col("copy").cast("long").alias("copy"))


@query
def batch_ids(s, d):
    return trajectories.batch_ids(traj(s, d).select("seq_id", "t"), 256, "seq_id", "t")


@query
def union_batches(s, d):
    t = traj(s, d)
    return t.filter("split = 0").select("seq_id", "t").unionByName(t.filter("label <= 6").select("seq_id", "t"))


@query
def out_of_bag(s, d):
    t = traj(s, d)
    return t.select("seq_id", "t").exceptAll(t.filter("(t * 7 + seq_id) % 3 = 0").select("seq_id", "t"))


@query
def row_membership(s, d):
    c = coarse(s, d)
    return c.filter("seq_id % 2 = 0").select("x", "y").intersect(c.filter("seq_id % 2 = 1").select("x", "y"))


@query
def gmm_fit(s, d):
    gmm, history = encoding.fit_gmm(traj(s, d), XYZ, 4)
    return s.createDataFrame([(k, float(p), [float(x) for x in m], [float(x) for x in v]) for k, (p, m, v) in enumerate(gmm)], "k int, prior double, mean array<double>, var array<double>")


@query
def pca_directions(s, d):
    p = encoding.pca(traj(s, d), XYZ)
    return s.createDataFrame([(i, k, float(p[i, k])) for i in range(p.shape[0]) for k in range(p.shape[1])], "i int, k int, v double")


@query
def encode_full(s, d):
    return encoding.encode(traj(s, d), XYZ, k=64, samples=50_000, iterations=100)


def _basis() -> np.ndarray:
    return sql.BASIS


@query
def sparse_codes(s, d):
    return encoding.sparse_codes(sequence.unit_scale(traj(s, d)).select("seq_id", "t", *XYZ), XYZ, _basis())


@query
def sparse_codes_nearest(s, d):
    return encoding.sparse_codes(sequence.unit_scale(traj(s, d)).select("seq_id", "t", *XYZ), XYZ, _basis(), nearest=3)


@query
def sparse_pyramid(s, d):
    return encoding.sparse_pyramid(sequence.unit_scale(traj(s, d)), XYZ, _basis())


@query
def dictionary(s, d):
    b = encoding.learn_basis(sequence.unit_scale(traj(s, d)).select(*XYZ), XYZ, 5)
    return s.createDataFrame([(i, k, float(b[i, k])) for i in range(b.shape[0]) for k in range(b.shape[1])], "i int, atom int, v double")


@query
def dictionary_optimal(s, d):
    """What proves a dictionary of all rows: no atom longer than one, no gap to the dual, no round whose objective rose."""
    seen: list[dict] = []
    b = encoding.learn_basis(sequence.unit_scale(traj(s, d)).select(*XYZ), XYZ, 8, 0.05, rounds=10, history=seen)
    rose = [max(0.0, y["objective"] - x["objective"]) for x, y in zip(seen, seen[1:], strict=False)]
    long = np.maximum(np.linalg.norm(b, axis=0) - 1, 0)
    return s.createDataFrame([(k, round(float(long[k]), 9) + 0.0, round(float(max(x["gap"] for x in seen)), 6) + 0.0, round(float(max(rose)), 9) + 0.0) for k in range(8)], "atom int, too_long double, gap double, rose double")


@query
def topk_atoms(s, d):
    a, k = np.meshgrid(np.arange(256), np.arange(64), indexing="ij")
    atoms = (((a * 13 + k * 7) % 11 - 5) * (1 + a)) / 997.0
    return encoding.top_atoms(emb(s, d).select(F.col("vec_id").alias("id"), F.col("features").alias("v")), atoms, 5).select("id", "atom", "rank")


@query
def concat_modalities(s, d):
    e = emb(s, d)
    two = e.join(e.select("vec_id", F.transform("features", lambda x: 2 * x).alias("b")), "vec_id").select("vec_id", F.concat("features", "b").alias("f"))
    return two.select("vec_id", F.size("f").alias("width"), (F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("total"))


# classifiers


@query
def predict_fixed_theta(s, d):
    return classify.predict(emb(s, d), theta()).select("vec_id", "prediction")


@query
def confusion(s, d):
    return classify.confusion(classify.predict(emb(s, d), theta()), 10)


@query
def accuracy(s, d):
    return rounded(classify.accuracy(classify.predict(emb(s, d), theta())), 6, "accuracy")


@query
def ridge_objective(s, d):
    return s.createDataFrame([(round(float(classify.ridge_objective(emb(s, d), theta(), 0.5)[0]), 3),)], "objective double")


@query
def ridge_gradient(s, d):
    g = classify.ridge_objective(emb(s, d), theta(), 0.5)[1]
    return s.createDataFrame([(i, k, round(float(g[i, k]), 3) + 0.0) for i in range(64) for k in range(10)], "d int, c int, g double")


@query
def mixed_norm_objective(s, d):
    loss, _ = classify.ridge_objective(emb(s, d), theta(), 0.0)
    v, _ = classify.mixed_norm(theta(), [np.arange(32), np.arange(32, 64)], 0.4, 0.7)
    return s.createDataFrame([(round(float(loss) + v, 3),)], "objective double")


@query
def onehot(s, d):
    return emb(s, d).select("vec_id", F.posexplode(V.one_hot(F.col("label"), 10)).alias("k", "v")).select("vec_id", (F.col("k") + 1).alias("class"), "v")


@query
def inverse_onehot(s, d):
    return emb(s, d).select("vec_id", V.arg_max(V.one_hot(F.col("label"), 10)).cast("int").alias("class"))


@query
def majority(s, d):
    return classify.majority(traj(s, d).select("seq_id", (F.col("y").cast("long") % 5).alias("label")), "seq_id")


@query
def weighted_votes(s, d):
    return rounded(classify.weighted_votes(traj(s, d).withColumnRenamed("y", "weight")), 6, "weight")


def _weights(s, w: np.ndarray) -> DataFrame:
    return s.createDataFrame([(i, k, float(w[i, k])) for i in range(w.shape[0]) for k in range(w.shape[1])], "d int, c int, w double")


@query
def ridge_fit(s, d):
    return _weights(s, classify.fit_ridge(emb(s, d), 10))


@query
def mixed_norm_fit(s, d):
    return _weights(s, classify.fit_mixed(emb(s, d), 10, [np.arange(32), np.arange(32, 64)], 0.1, 0.1)[0])


@query
def squared_hinge_fit(s, d):
    return _weights(s, classify.fit_squared_hinge(emb(s, d), 10))


@query
def svm_fit(s, d):
    e = emb(s, d)
    return classify.predict_pairwise(e, classify.fit_pairwise_svm(e)).select("vec_id", "label", "prediction")


@query
def forest_fit(s, d):
    e = emb(s, d)
    return classify.predict_forest(e, classify.fit_forest(e)).select("vec_id", "label", "prediction")


# N-dimensional sparse arrays


def nda(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return ndsparse.build(e.select((F.col("user_id") % 7 + 1).alias("i"), (k % 5 + 1).alias("j"), (F.floor(F.col("value") / 100) % 4 + 1).alias("k"), F.floor("value").cast("double").alias("val")))


def _even(s, d):
    return nda(s, d).filter("(i + j + k) % 2 = 0")


def nd(name: str, f: Callable) -> None:
    _QUERIES[f"ndsparse_{name}"] = f


nd("build", nda)
nd("sum", lambda s, d: ndsparse.reduce(nda(s, d), "k", 4, "sum"))
nd("mean", lambda s, d: rounded(ndsparse.reduce(nda(s, d), "k", 4, "mean"), 6, "val"))
nd("max", lambda s, d: ndsparse.reduce(nda(s, d), "j", 5, "max"))
nd("min", lambda s, d: ndsparse.reduce(nda(s, d), "j", 5, "min"))
nd("plus", lambda s, d: ndsparse.elementwise(nda(s, d), _even(s, d), lambda a, b: a + b))
nd("times", lambda s, d: ndsparse.elementwise(nda(s, d), _even(s, d), lambda a, b: a * b))
nd("mtimes", lambda s, d: ndsparse.multiply(ndsparse.reduce(nda(s, d), "k", 4, "sum"), ndsparse.reduce(nda(s, d), "i", 7, "sum"), "j"))
nd("bsxfun", lambda s, d: ndsparse.spread(nda(s, d), ndsparse.reduce(ndsparse.reduce(nda(s, d), "i", 7, "sum"), "k", 4, "sum"), lambda a, b: F.round(V.over(a, b), 9)))
nd("permute", lambda s, d: ndsparse.permute(nda(s, d), ["k", "i", "j"]))
nd("reshape", lambda s, d: ndsparse.reshape(nda(s, d), {"i": 7, "j": 5, "k": 4}, {"p": 35, "q": 4}))
nd("circshift", lambda s, d: ndsparse.shift(nda(s, d), "i", 7, 3))
nd("flip", lambda s, d: ndsparse.flip(nda(s, d), "j", 5))
nd("repmat", lambda s, d: ndsparse.repeat(nda(s, d), "k", 4, 3))
nd("cat", lambda s, d: ndsparse.concat(nda(s, d), nda(s, d), "i", 7))
nd("triu", lambda s, d: ndsparse.triangle(ndsparse.reduce(nda(s, d), "k", 4, "sum"), "i", "j"))
_QUERIES["occupancy"] = lambda s, d: rounded(ndsparse.occupancy(nda(s, d), 140), 6, "ratio")


nd("any", lambda s, d: ndsparse.reduce(nda(s, d), "k", 4, "any"))
nd("all", lambda s, d: ndsparse.reduce(nda(s, d), "k", 4, "all"))
nd("inspect", lambda s, d: ndsparse.inspect(nda(s, d)))
nd("find", lambda s, d: ndsparse.find(nda(s, d), SHAPE))
nd("sqrt", lambda s, d: rounded(ndsparse.apply(nda(s, d), lambda v: F.sqrt(F.abs(v))), 6, "val"))
nd("power", lambda s, d: ndsparse.apply(nda(s, d), lambda v: v * v))
nd("index", lambda s, d: ndsparse.index(nda(s, d), {"i": [3, 1, 3, 7], "k": [4, 2]}))
nd("assign", lambda s, d: ndsparse.assign(nda(s, d), {"i": [2, 5], "j": [1, 3]}, _even(s, d).filter("i <= 2 and j <= 2")))
nd("minus", lambda s, d: ndsparse.elementwise(nda(s, d), _even(s, d), lambda a, b: a - 2 * b))
nd("gt", lambda s, d: ndsparse.compare(nda(s, d), ndsparse.shift(nda(s, d), "i", 7, 1), lambda a, b: a > b))
nd("eq", lambda s, d: ndsparse.compare(nda(s, d), _even(s, d), lambda a, b: a == b, SHAPE))
nd("dense", lambda s, d: ndsparse.dense(_even(s, d), SHAPE))
nd("mpower", lambda s, d: ndsparse.matrix_power(ndsparse.apply(ndsparse.reduce(nda(s, d), "k", 4, "sum").filter("i <= 5"), lambda v: v % 7), 3))
nd("rot90", lambda s, d: ndsparse.rotate90(nda(s, d), "i", "j", 5))
nd("squeeze", lambda s, d: ndsparse.squeeze(nda(s, d).filter("j = 1"), {"i": 7, "j": 1, "k": 4}))
nd("convolve", lambda s, d: ndsparse.convolve(nda(s, d), nda(s, d).filter("i <= 2 and j <= 2 and k = 1").withColumn("val", F.col("i") * 1.0 - F.col("j") * 3)))
nd("random", lambda s, d: rounded(ndsparse.elementwise(nda(s, d), ndsparse.random(s, SHAPE, 0.3), lambda a, b: a * b), 6, "val"))
SHAPE = {"i": 7, "j": 5, "k": 4}


def _heavy(s, d) -> DataFrame:
    """The sums over i and j, square, with a heavy diagonal."""
    a = ndsparse.reduce(nda(s, d), "k", 4, "sum").filter("i <= 5")
    return a.withColumn("val", F.col("val") % 7 + F.when(F.col("i") == F.col("j"), 50.0).otherwise(0.0)).select("i", "j", "val")


@query
def ndsparse_solve(s, d):
    """A x = b, and the product A x, which is b."""
    b = s.range(1, 6).select(F.col("id").alias("i"), (F.col("id") * 2.0 - 1).alias("val"))
    return rounded(ndsparse.multiply(_heavy(s, d), ndsparse.solve(_heavy(s, d), b), "j"), 6, "val")


@query
def ndsparse_inverse(s, d):
    """The product of a matrix and its inverse: one on the diagonal, nothing else."""
    inv = ndsparse.inverse(_heavy(s, d)).select(F.col("i").alias("j"), F.col("j").alias("k"), "val")
    return rounded(ndsparse.multiply(_heavy(s, d), inv, "j"), 6, "val").filter("val <> 0")


@query
def user_network_solve(s, d):
    """A system that grows with the events: users who share a key k, each tied to all others of the key by the key's mean.

    (D + A'A) x = b for the incidence A of users and keys and b the users' mean values; the residual's largest size, which is nothing.
    """
    e = s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") + 1).alias("u"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("k"), "value")
    inc = e.groupBy("u", "k").agg(F.lit(0.1).alias("val"))
    rows = e.groupBy("u").agg(F.avg("value").alias("val"))
    # the square system written as least squares: users' own rows, then the keys' rows
    n = F.lit(1 << 40)
    own = rows.select(F.col("u").alias("i"), F.col("u").alias("j"), F.lit(1.0).alias("val"))
    a = own.unionByName(inc.select((F.col("k") + n).alias("i"), F.col("u").alias("j"), "val"))
    x = ndsparse.solve(a, rows.select(F.col("u").alias("i"), "val"))
    # normal equations: x + A'(A x) = b
    hit = inc.hint("merge").join(x.withColumnRenamed("val", "_x"), F.col("u") == F.col("j")).groupBy("k").agg(F.sum(F.col("val") * F.col("_x")).alias("y"))
    back = inc.join(hit, "k").groupBy(F.col("u").alias("j")).agg(F.sum(F.col("val") * F.col("y")).alias("z"))
    off = x.hint("merge").join(back, "j").hint("merge").join(rows.select(F.col("u").alias("j"), F.col("val").alias("b")), "j").select(F.abs(F.col("val") + F.col("z") - F.col("b")).alias("off"))
    return rounded(off.agg(F.max("off").alias("off"), F.count("*").alias("users")), 5, "off")


# functions and sources


@query
def rounding_functions(s, d):
    x, y = F.col("x") - 500, F.col("y") % 13 - 6
    return traj(s, d).select("seq_id", "t", scalar.fix(x / 7).cast("long").alias("fix"), F.round(scalar.rem(x, y), 6).alias("rem"), F.round(scalar.mod(x, y), 6).alias("mod"))


@query
def integer_functions(s, d):
    return traj(s, d).select("seq_id", "t", scalar.gcd(F.col("t") * 6, F.col("seq_id") * 4).alias("g"), scalar.factorial(F.col("t") % 15).alias("f"))


@query
def time_stamps(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", scalar.stamp(F.col("ts")).alias("stamp"))


@query
def inverse3(s, d):
    t = traj(s, d).select("seq_id", "t", (F.col("x") % 7 + 20).alias("a"), (F.col("y") % 5).alias("b"), (F.col("z") % 3).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    m = scalar.inverse3([[a, b, c], [c, a, b], [b, c, a]])
    return rounded(t.select("seq_id", "t", *(m[0][j].alias(f"m{j}") for j in range(3))), 9, "m0", "m1", "m2")


@query
def permuted_rows(s, d):
    return trajectories.permuted(traj(s, d)).select("seq_id", "t", "p")


@query
def excluded_records(s, d):
    return trajectories.exclude(traj(s, d), (F.col("label") == 12) | ((F.col("label") == 3) & (F.col("seq_id") % 5 == 0))).groupBy("label").agg(F.count_distinct("seq_id").alias("n"))


@query
def load_skeletons(s, d):
    """Events as nested skeletons of two joints, and read as a data set: one joint, one class left out, split by subject."""
    t = traj(s, d)
    p = t.groupBy("seq_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x", "y", "z"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"))).alias("p"))
    joint = lambda k, p: F.struct(F.lit(k).alias("joint_id"), F.array(p).alias("instances"))
    cells = p.select(F.col("label").alias("class_id"), F.col("seq_id").alias("subject_id"), F.array(joint(7, F.col("p")), joint(11, F.reverse("p"))).alias("skeleton"))
    train = s.range(0, 100_000, 3).withColumnRenamed("id", "subject_id")
    return trajectories.load_skeletons(cells, [7], train, F.col("class_id") == 12)


# encoders and learners, whole


@query
def sparse_objective(s, d):
    t = sequence.unit_scale(traj(s, d)).withColumn("code", F.array(F.col("x") - 0.5, F.col("y"), F.lit(0.0), -F.col("z"), F.lit(0.25), F.col("x") * F.col("y")))
    return rounded(encoding.sparse_objective(t, XYZ, sql.BASIS, 0.15, 1e-4), 3, "residual", "penalty", "ridge", "objective")


@query
def code_gradients(s, d):
    """Objectives and summed gradients of given codes under each penalty, the last that of codes on nearest atoms."""
    t = sequence.unit_scale(traj(s, d)).withColumn("code", F.array(F.col("x") - 0.5, F.col("y"), F.lit(0.0), -F.col("z"), F.lit(0.25), F.col("x") * F.col("y")))
    cols, sums = ["fit", "cost", "gradient"], {}
    for name in ("l1", "log", "eps", "huber", "square"):
        t = encoding.code_gradient(t, XYZ, sql.BASIS, name, 0.15, 0.5, 0.7, 0.2).withColumnsRenamed({c: f"{name}_{c}" for c in cols})
        sums[name] = F.struct(F.lit(name).alias("penalty"), F.sum(f"{name}_fit").alias("fit"), F.sum(f"{name}_cost").alias("cost"), *(F.sum(F.get(f"{name}_gradient", F.lit(k))).alias(f"g{k}") for k in range(6)))
    one = t.agg(F.array(*sums.values()).alias("x")).select(F.inline("x"))
    return rounded(one, 3, "fit", "cost", *(f"g{k}" for k in range(6)))


@query
def sparse_codes_stationary(s, d):
    """How far each row's code is from the conditions of a minimum: nowhere."""
    b, lam, beta = _basis(), 0.15, 1e-4
    c = encoding.sparse_codes(sequence.unit_scale(traj(s, d)).select("seq_id", "t", *XYZ), XYZ, b, lam, beta)
    gram = b.T @ b + 2 * beta * np.eye(b.shape[1])
    off = []
    for j in range(b.shape[1]):
        x = F.get("code", F.lit(j))
        g = sum((F.get("code", F.lit(k)) * float(gram[k, j]) for k in range(b.shape[1])), F.lit(0.0)) - sum((F.col(n) * float(b[i, j]) for i, n in enumerate(XYZ)), F.lit(0.0))
        off.append(F.when(x == 0, F.greatest(F.abs(g) - lam, F.lit(0.0))).otherwise(F.abs(g + lam * F.signum(x))))
    return rounded(c.select("seq_id", "t", F.greatest(*off).alias("off")), 6, "off")


@query
def encode_two_modalities(s, d):
    t = traj(s, d)
    return encoding.encode_two(t, XYZ, sequence.gradient(t, *XYZ), ["vx", "vy", "vz"], k=4, samples=20_000)


@query
def encode_with_pca(s, d):
    return encoding.encode(sequence.gradient(traj(s, d), *XYZ), [*XYZ, "vx", "vy", "vz"], k=4, samples=20_000, ratio=0.98)


@query
def encode_two_widths(s, d):
    """Codes of two fixed mixtures side by side: every sequence, its widths, and the codes' lengths, which are one each."""
    t, g = traj(s, d), [(p, m[:2], v[:2]) for p, m, v in sql.GMM]
    a = encoding.encode(t, XYZ, gmm=sql.GMM, parts=1)
    b = encoding.encode(t, ["x", "y"], gmm=g, parts=1).withColumnRenamed("code", "b")
    size = lambda c: F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)), 6)
    return a.join(b, "seq_id").select("seq_id", F.size("code").alias("width_a"), F.size("b").alias("width_b"), size("code").alias("size_a"), size("b").alias("size_b"))


@query
def encode_whole_fixed(s, d):
    """The assembled code of one stretch and one level, for a fixed mixture: place and value of every number."""
    c = encoding.encode(traj(s, d), XYZ, gmm=sql.GMM, parts=1, levels=(1,))
    return rounded(c.select("seq_id", F.posexplode("code").alias("i", "val")), 6, "val")


@query
def encode_parts_fixed(s, d):
    """The assembled code of the default two stretches and four levels, for a fixed mixture: every place whose number is not zero."""
    c = rounded(encoding.encode(traj(s, d), XYZ, gmm=sql.GMM).select("seq_id", F.posexplode("code").alias("i", "val")), 5, "val")
    return c.filter("val <> 0")


@query
def mean_posteriors(s, d):
    q = encoding.posteriors(traj(s, d).select("seq_id", *XYZ), XYZ, sql.GMM)
    return rounded(q.groupBy("seq_id", "k").agg(F.avg("q").alias("q")), 6, "q")


@query
def ridge_stationary(s, d):
    """The objective's gradient at the fitted weights: zero."""
    g = classify.ridge_objective(emb(s, d), classify.fit_ridge(emb(s, d), 10), 1.0)[1]
    return s.createDataFrame([(i, k, round(float(g[i, k]), 3) + 0.0) for i in range(64) for k in range(10)], "d int, c int, g double")


@query
def two_modality_fit(s, d):
    e = emb(s, d).withColumn("second", F.transform("features", lambda x: x * x))
    return _weights(s, classify.fit_two(e, "features", "second", 10, 0.1, 0.1)[0])


@query
def batched_fit(s, d):
    return _weights(s, classify.fit_batches(emb(s, d), 10, [np.arange(32), np.arange(32, 64)], 0.1, 0.1))


@query
def svm_probabilities(s, d):
    e = emb(s, d)
    m = classify.fit_pairwise_svm(e)
    return classify.predict_pairwise(e, m, classify.fit_sigmoids(e, m)).select("vec_id", "label", "probabilities", "prediction")


@query
def forest_out_of_bag(s, d):
    return s.createDataFrame([(classify.out_of_bag(emb(s, d), trees=40),)], "accuracy double")


def _describe(name: str) -> None:
    def run(s, d):
        x = describe.describe(traj(s, d), name)
        if name == "shape":
            x = x.select("seq_id", "t", F.posexplode("d").alias("i", "v")).filter("v <> 0")
        elif name == "local":  # outer: no filter on the array is inferred and pushed into its algebra
            x = x.select("seq_id", "t", F.posexplode_outer("d").alias("i", "v"))
        elif name in ("differential", "velocity", "similarity", "similarity_gradients"):
            x = x.select("seq_id", "t", F.posexplode("d").alias("i", "v"))
        x = rounded(x, 4, "v") if "v" in x.columns else x
        return x.filter("v <> 0") if name == "similarity_gradients" else x

    _QUERIES[f"describe_{name}"] = run


for _m in describe.METHODS:
    _describe(_m)


@query
def describe_two_hands(s, d):
    t = traj(s, d)
    x = describe.two_hands(t, t.withColumn("x", 2 * F.col("x")), "velocity")
    return rounded(x.select("seq_id", "t", F.posexplode("d").alias("i", "v")), 4, "v")


@query
def shape_pyramid(s, d):
    return rounded(describe.shape_pyramid(traj(s, d)), 6, "val")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
