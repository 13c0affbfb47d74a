"""Trajectories as long tables: (seq_id, t, x, y, z, ...), t counting from 1 within a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.sequence import spread


def from_events(events: DataFrame) -> DataFrame:
    """The driver's event stream as trajectories: a sequence a user, ordered by time.

    Dealt by sequence once, so that what follows on sequences shuffles no more.
    """
    e = spread(events.select(F.col("user_id").alias("seq_id"), "ts", "event_id", "value", "props"))
    t = F.row_number().over(W.partitionBy("seq_id").orderBy("ts", "event_id"))
    return e.select(
        "seq_id",
        t.cast("long").alias("t"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.second("ts").cast("double").alias("z"),
        (F.col("seq_id") % 2).alias("split"),
        (F.col("seq_id") % 12 + 1).alias("label"),
    )


def read_text_records(spark: SparkSession, path: str) -> DataFrame:
    """Text records: "frames columns", then rows of decimal-comma numbers for head, left, right and wrist.

    Ids come from the file name, counted from its end: person, gesture, session, record.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    name = F.col("path")
    cut = lambda a, n: F.substring(name, F.length(name) - a, n).try_cast("int")
    fields = F.filter(F.split(F.replace("value", F.lit(","), F.lit(".")), r"\s+"), lambda s: s != "")
    rows = raw.select("path", cut(12, 2).alias("person_id"), cut(9, 2).alias("gesture_id"), cut(6, 1).alias("session_id"), cut(4, 1).alias("record_id"), fields.alias("f"))
    rows = rows.withColumn("cols", F.get("f", F.lit(1)).cast("int")).withColumn("n", F.get("f", F.lit(0)).cast("int"))
    rows = rows.filter("n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("t"))
    at = lambda k: F.get("f", F.lit(2) + (F.col("t") - 1) * F.col("cols") + k).cast("double")
    part = lambda k: F.struct(at(k).alias("x"), at(k + 1).alias("y"), at(k + 2).alias("z"))
    return rows.select("path", "person_id", "gesture_id", "session_id", "record_id", "t", part(0).alias("head"), part(3).alias("left"), part(6).alias("right"), part(9).alias("wrist"))


def from_skeletons(cells: DataFrame, joints: list[int]) -> DataFrame:
    """(class_id, subject_id, skeleton array<struct<joint_id, instances array<array<struct<x,y,z>>>>>) -> long rows."""
    j = cells.select("class_id", "subject_id", F.explode("skeleton").alias("j")).select("class_id", "subject_id", "j.joint_id", "j.instances").filter(F.col("joint_id").isin(joints))
    i = j.select("class_id", "subject_id", "joint_id", F.posexplode("instances").alias("k", "points"))
    p = i.select("class_id", "subject_id", "joint_id", (F.col("k") + 1).alias("instance"), F.posexplode("points").alias("k", "p"))
    return p.select("class_id", "subject_id", "joint_id", "instance", (F.col("k") + 1).alias("t"), "p.x", "p.y", "p.z")


def load_records(spark: SparkSession, path: str, train: DataFrame, without: tuple[int, ...] = (17, 18), length: int = 64, strict: DataFrame | None = None) -> DataFrame:
    """A folder of text records as a data set: excluded gestures left out, split by person, both hands resampled.

    seq_id (a hash of the record's ids), person_id, gesture_id, session_id, record_id, split, hand, t, x, y, z.
    """
    r = exclude(read_text_records(spark, path), F.col("gesture_id").isin(list(without)))
    r = split_by_membership(r, train, "person_id", strict)
    ids = ["person_id", "gesture_id", "session_id", "record_id", "split"]
    r = r.select(F.xxhash64("person_id", "gesture_id", "session_id", "record_id", "path").alias("seq_id"), *ids, "t", F.explode(F.create_map(F.lit("left"), "left", F.lit("right"), "right")).alias("hand", "p"))
    r = r.select("seq_id", *ids, "hand", "t", "p.x", "p.y", "p.z")
    meta = r.select("seq_id", *ids).distinct()
    from strandline.operators.resample import resample

    hands = [resample(r.filter(F.col("hand") == h), length).withColumn("hand", F.lit(h)) for h in ("left", "right")]
    return hands[0].unionByName(hands[1]).join(meta, "seq_id").select("seq_id", *ids, "hand", "t", "x", "y", "z")


def load_skeletons(cells: DataFrame, joints: list[int], train: DataFrame | None = None, without: Column | None = None, seed: int | None = None) -> DataFrame:
    """Nested skeletons as a data set: joints chosen, records left out, split by subject, with a shuffle key if a seed is given."""
    d = from_skeletons(cells if without is None else exclude(cells, without), joints)
    if train is not None:
        d = split_by_membership(d, train, "subject_id")
    return d if seed is None else d.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "class_id", "subject_id", "instance"))


def exclude(df: DataFrame, rule: Column) -> DataFrame:
    """Records that a dataset leaves out (gestures, or a class of one subject)."""
    return df.filter(~F.coalesce(rule, F.lit(False)))


def split_by_membership(df: DataFrame, train: DataFrame, key: str, strict: DataFrame | None = None) -> DataFrame:
    """split = train for keys that are listed; all others are test, or only those in ``strict``."""
    listed = train.select(key).distinct().withColumn("_in", F.lit(True))
    out = df.join(listed, key, "left").withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")
    if strict is not None:
        out = out.filter("split = 'train'").unionByName(out.filter("split = 'test'").join(strict.select(key).distinct(), key, "left_semi"))
    return out


def labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select("seq_id", label).distinct()


def write_stage(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Write a stage's table and read it back."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def cached_artifact(spark: SparkSession, path: str, make) -> DataFrame:
    """Read a learned table if it is there, else make and write it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)


def permuted(df: DataFrame, a: int = 7919, m: int = 104_729) -> DataFrame:
    """Each sequence's rows numbered anew (p) in a fixed pseudo-random order of t."""
    key = (F.col("t") * a + F.col("seq_id") * 31) % m
    return df.withColumn("p", F.row_number().over(W.partitionBy("seq_id").orderBy(key, "t")).cast("long"))


def batch_ids(df: DataFrame, size: int = 256, *order: str) -> DataFrame:
    """Number fixed-size batches of the ordered rows; the last may be short.

    Ranks come from counts of ranges, so no task holds more than its range.
    """
    d = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    n = d.groupBy("_p").agg(F.count("*").alias("_n"))
    base = n.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    row = F.row_number().over(W.partitionBy("_p").orderBy(*order)) + F.col("_b")
    return d.join(base, "_p").withColumn("batch", F.floor((row - 1) / size)).drop("_p", "_b")
