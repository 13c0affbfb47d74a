"""Sparse linear systems as joins: conjugate gradients on the normal equations, matrix and vectors as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import new_folder, stored


def least_squares(a: DataFrame, b: DataFrame, tol: float = 1e-10, rounds: int | None = None) -> DataFrame:
    """argmin |A x - b| for A (i, j, val) and b (i, ..., val): (j, ..., val).

    Further axes of b number systems with the same matrix; they are solved together, each with step sizes of its own. Columns
    are scaled to length one. A round is two products, a join and a sum each: A p over the columns, and A' r over the rows; their results
    are written, so a round reads the tables of the round before and no more. The driver sees one number a round, the
    largest gradient that is left against the first, and stops under ``tol``, or after ``rounds`` (by default, as many as the smaller
    side and 20 more). Tables that grow with the system are merged, never broadcast, as a broadcast passes through the driver in every round; only the
    step sizes, a row a system, may be. Entries that repeat add up. Rows and columns without an entry take no part; a column without one has no x.
    """
    spark, more = a.sparkSession, [c for c in b.columns if c not in ("i", "val")]
    folder = new_folder(spark, "least-squares")
    a = stored(a.groupBy("i", "j").agg(F.sum("val").alias("val")).filter("val <> 0"), "matrix")
    scale = stored(a.groupBy("j").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("size")), "scale")
    unit = stored(a.hint("merge").join(scale, "j").select("i", "j", (F.col("val") / F.col("size")).alias("a")), "unit")
    if rounds is None:
        n = a.agg(F.count_distinct("i").alias("i"), F.count_distinct("j").alias("j")).first()
        rounds = min(n["i"], n["j"]) + 20
    # without further axes all rows are of system 0
    axes = more or ["system"]
    b = b if more else b.withColumn("system", F.lit(0))
    r = _kept(spark, b.groupBy("i", *axes).agg(F.sum("val").cast("double").alias("r")), folder, "r0")
    s = _kept(spark, _down(unit, r, axes).withColumns({"x": F.lit(0.0), "p": F.col("s")}), folder, "s0")
    square = lambda df, c, name: df.groupBy(*axes).agg(F.sum(F.col(c) * F.col(c)).alias(name))
    first = square(s, "s", "g0")
    for k in range(1, rounds + 1):
        gamma = square(s, "s", "gamma")
        q = unit.hint("merge").join(s.select("j", *axes, "p"), "j").groupBy("i", *axes).agg(F.sum(F.col("a") * F.col("p")).alias("q"))
        both = _kept(spark, r.hint("merge").join(q, ["i", *axes], "full").fillna(0.0, ["r", "q"]), folder, f"q{k}")
        # a system at rest (no gradient left) takes no step
        step = square(both, "q", "q2").join(gamma, axes).select(*axes, F.when(F.col("q2") > 0, F.col("gamma") / F.col("q2")).otherwise(0.0).alias("step"))
        r = _kept(spark, both.join(step, axes, "left").select("i", *axes, (F.col("r") - F.coalesce("step", F.lit(0.0)) * F.col("q")).alias("r")), folder, f"r{k}")
        moved = s.join(step, axes).select("j", *axes, (F.col("x") + F.col("step") * F.col("p")).alias("x"), F.col("p").alias("_p"))
        # columns that no step has reached so far come in here
        new = _kept(spark, moved.hint("merge").join(_down(unit, r, axes), ["j", *axes], "full").fillna(0.0, ["x", "_p", "s"]), folder, f"n{k}")
        turn = square(new, "s", "next").join(gamma, axes).select(*axes, F.when(F.col("gamma") > 0, F.col("next") / F.col("gamma")).otherwise(0.0).alias("turn"))
        s = _kept(spark, new.join(turn, axes).select("j", *axes, "x", "s", (F.col("s") + F.col("turn") * F.col("_p")).alias("p")), folder, f"s{k}")
        left = square(s, "s", "g").join(first, axes).agg(F.max(F.when(F.col("g0") > 0, F.sqrt(F.col("g") / F.col("g0"))))).first()[0]
        if left is None or left <= tol:
            break
    return s.hint("merge").join(scale, "j").select("j", *more, (F.col("x") / F.col("size")).alias("val"))


def _down(unit: DataFrame, r: DataFrame, axes: list[str]) -> DataFrame:
    """A' r: (j, ..., s)."""
    return unit.hint("merge").join(r, "i").groupBy("j", *axes).agg(F.sum(F.col("a") * F.col("r")).alias("s"))


def _kept(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")
