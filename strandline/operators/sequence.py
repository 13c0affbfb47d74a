"""Ordered-window operators on trajectories; all share one partitioning by sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import vector as V

XYZ = ("x", "y", "z")


def order():
    """The one window specification that the ordered operators share."""
    return W.partitionBy("seq_id").orderBy("t")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by its key (seq_id) over all cores: work that is heavy for its bytes is not drawn together into a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *(key or ("seq_id",)))


def whole():
    return W.partitionBy("seq_id")


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows whose first coordinate is a number."""
    return df.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def mark_repeats(df: DataFrame) -> DataFrame:
    """repeated: the point equals the row before it."""
    same = F.lit(True)
    for c in XYZ:
        same = same & (F.col(c) == F.lag(c).over(order()))
    return df.withColumn("repeated", F.coalesce(same, F.lit(False)))


def remove_repeats(df: DataFrame) -> DataFrame:
    """Points that differ from the row before, numbered anew in t; orig_t keeps the old number."""
    kept = mark_repeats(df).filter("not repeated").drop("repeated").withColumnRenamed("t", "orig_t")
    return kept.withColumn("t", F.row_number().over(W.partitionBy("seq_id").orderBy("orig_t")).cast("long"))


def fill_repeats(all_rows: DataFrame, kept: DataFrame, *values: str) -> DataFrame:
    """Values of the kept rows on all rows; a removed row copies the one before it."""
    v = kept.select("seq_id", F.col("orig_t").alias("t"), *values)
    d = all_rows.select("seq_id", "t").join(v, ["seq_id", "t"], "left")
    return d.select("seq_id", "t", *(F.last(c, ignorenulls=True).over(order()).alias(c) for c in values))


def _ranges() -> tuple[list[Column], Column]:
    low = [F.min(c).over(whole()) for c in XYZ]
    return low, F.greatest(*(F.max(c).over(whole()) - m for c, m in zip(XYZ, low, strict=True)))


def grid_range(df: DataFrame, cells: int = 1000) -> DataFrame:
    """Integer grid over the largest coordinate range; a still sequence has no grid."""
    low, span = _ranges()
    return df.select("seq_id", "t", *(F.round(V.over(F.col(c) - m, span / cells)).cast("long").alias(f"g{c}") for c, m in zip(XYZ, low, strict=True)))


def grid_mean(df: DataFrame, mean: Column, cells: int = 1000) -> DataFrame:
    """Integer grid by a mean distance, which scales twice."""
    return df.select("seq_id", "t", *(F.round(V.over(V.over(F.col(c), mean), mean / cells)).cast("long").alias(f"g{c}") for c in XYZ))


def unit_scale(df: DataFrame) -> DataFrame:
    """Shifted to zero and divided by the largest range; with the scale."""
    low, span = _ranges()
    return df.select("seq_id", "t", *(V.over(F.col(c) - m, span).alias(c) for c, m in zip(XYZ, low, strict=True)), span.alias("scale"))


def gradient(df: DataFrame, *names: str) -> DataFrame:
    """Central differences, one-sided at the ends; v<name> columns. A single point has 0."""
    def g(c: str) -> Column:
        before, after = F.lag(c).over(order()), F.lead(c).over(order())
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    return df.withColumns({f"v{c}": g(c) for c in names or XYZ})


def square_root_velocity(df: DataFrame) -> DataFrame:
    d = gradient(df, *XYZ)
    s = V.square_root_velocity(V.cols("vx", "vy", "vz"))
    return d.select("seq_id", "t", *(c.alias(f"s{n}") for c, n in zip(s, XYZ, strict=True)))


def next_frame(df: DataFrame, *names: str) -> DataFrame:
    """Each column's next row, the last its own."""
    return df.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(order()), F.col(c)) for c in names})


def trim(df: DataFrame, k: int = 2) -> DataFrame:
    """Without k rows at either end."""
    return df.withColumn("_n", F.count("*").over(whole())).filter((F.col("t") > k) & (F.col("t") <= F.col("_n") - k)).drop("_n")


def arc_length(df: DataFrame) -> DataFrame:
    """Arc length so far as a share of all, and distance from the centre over its mean."""
    step = V.norm([F.col(c) - F.lag(c).over(order()) for c in XYZ])
    away = V.norm([F.col(c) - F.avg(c).over(whole()) for c in XYZ])
    d = df.select("seq_id", "t", F.coalesce(step, F.lit(0.0)).alias("step"), away.alias("away"))
    s = F.sum("step").over(order().rowsBetween(W.unboundedPreceding, 0))
    return d.select("seq_id", "t", V.over(s, F.sum("step").over(whole())).alias("arc"), V.over(F.col("away"), F.avg("away").over(whole())).alias("radius"))


def absent(df: DataFrame) -> DataFrame:
    """seq_id, absent: all coordinates are zero."""
    return df.groupBy("seq_id").agg((F.max(F.greatest(*(F.abs(c) for c in XYZ))) == 0).alias("absent"))


def concat_hands(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
    """Two hands' columns side by side, joined on sequence and frame."""
    r = right.select("seq_id", "t", *(F.col(c).alias(f"right_{c}") for c in names))
    return left.select("seq_id", "t", *(F.col(c).alias(f"left_{c}") for c in names)).join(r, ["seq_id", "t"])


def patches(df: DataFrame, half: int, *names: str) -> DataFrame:
    """Sliding windows of 2 half + 1 rows as one array, where they fit."""
    w = order().rowsBetween(-half, half)
    d = df.withColumn("_n", F.count("*").over(whole()))
    d = d.select("seq_id", "t", "_n", F.flatten(F.collect_list(F.array(*names)).over(w)).alias("patch"))
    return d.filter((F.col("t") > half) & (F.col("t") <= F.col("_n") - half)).select("seq_id", (F.col("t") - half).alias("t"), "patch")


def differential_invariants(df: DataFrame) -> DataFrame:
    """Curvature and torsion of five points and their signed-root derivatives; 0 for two rows at either end.

    Degenerate denominators give null.
    """
    at = lambda k: [F.lag(c, -k).over(order()) if k < 0 else F.lead(c, k).over(order()) if k else F.col(c) for c in XYZ]
    p = {k: ([F.lag(c, -k).over(order()) for c in XYZ] if k < 0 else at(k)) for k in range(-2, 3)}
    names = {k: [f"p{k + 2}{c}" for c in XYZ] for k in p}
    d = df.select("seq_id", "t", F.count("*").over(whole()).alias("n"), *(c.alias(m) for k in p for c, m in zip(p[k], names[k], strict=True)))
    q = {k: V.cols(*names[k]) for k in p}
    gap = lambda i, j: V.norm(V.sub(q[i], q[j]))
    inner = (F.col("t") >= 3) & (F.col("t") <= F.col("n") - 2)
    d = d.select("seq_id", "t", inner.alias("inner"), gap(0, -1).alias("a"), gap(1, 0).alias("b"), gap(1, -1).alias("c"), gap(2, 1).alias("d"), gap(2, 0).alias("e"), gap(2, -1).alias("f"), gap(-1, -2).alias("g"), gap(0, -2).alias("k"), gap(1, -2).alias("m"), V.norm(V.cross(V.sub(q[0], q[-1]), V.sub(q[1], q[-1]))).alias("w"), V.det3(V.sub(q[0], q[2]), V.sub(q[-1], q[2]), V.sub(q[1], q[2])).alias("det1"), V.det3(V.sub(q[0], q[-2]), V.sub(q[-1], q[-2]), V.sub(q[1], q[-2])).alias("det2"))
    s = (F.col("a") + F.col("b") + F.col("c")) / 2
    area = F.sqrt(F.greatest(s * (s - F.col("a")) * (s - F.col("b")) * (s - F.col("c")), F.lit(0.0)))
    d = d.withColumn("area", area)
    kappa = F.when(F.col("inner"), V.over(4 * F.col("area"), F.col("a") * F.col("b") * F.col("c"))).otherwise(0.0)
    d = d.withColumn("curvature", kappa)
    height = lambda det: V.over(F.col(det) / 2, F.col("area"))
    t1 = V.over(3 * height("det1"), F.col("d") * F.col("e") * F.col("f") * F.col("curvature"))
    t2 = V.over(3 * height("det2"), F.col("g") * F.col("k") * F.col("m") * F.col("curvature"))
    d = d.withColumn("torsion", F.when(F.col("inner"), t1 + t2).otherwise(0.0))
    turn = lambda c: F.lead(c).over(order()) - F.lag(c).over(order())
    a, b, dd, g, h = F.col("a"), F.col("b"), F.col("d"), F.col("g"), V.over(F.col("w"), F.col("c"))
    slope = V.over(turn("curvature"), F.col("c"))
    r = 2 * a + 2 * b - 2 * dd - 3 * h + g
    kd = V.over(3 * turn("curvature"), 2 * a + 2 * b + dd + g)
    # the product 2 b 2 d in this denominator is part of the descriptor's definition
    td = V.over(4 * (turn("torsion") + r * V.over(F.col("torsion") * slope, 6 * F.col("curvature"))), 2 * a + 2 * b * 2 * dd + h + g)
    root = lambda v: F.when(v != 0, F.signum(v) * F.sqrt(F.abs(v)))
    d = d.select("seq_id", "t", "inner", "curvature", "torsion", kd.alias("kd"), td.alias("td"))
    return d.select("seq_id", "t", "curvature", F.when(F.col("inner"), root(F.col("kd"))).otherwise(0.0).alias("curvature_d"), "torsion", F.when(F.col("inner"), root(F.col("td"))).otherwise(0.0).alias("torsion_d"))
