"""Codes of conversations, kept up to date while their files arrive.

    python -m jobs.conversation_codes --turns CONVERSATIONS.parquet --out FOLDER --config jobs/conversation_codes.json

A conversation is a sequence: a point a turn, of its words, characters and lines. The job gives each the same velocity code over a
temporal pyramid that gestures have, so the same encoders and classifiers take both.

A file stream with a checkpoint takes only files that are new. Each micro-batch reduces its texts to points, adds those to
``points`` in a folder of the batch's own number, and makes the codes of the buckets that it touches anew from all their
points; texts are never read twice. Both writes replace whole partitions, so a batch that is repeated after a failure leaves the same rows. A run with nothing
new changes nothing. The number of buckets holds for as long as the folder is used.

A turn that arrives again is one turn: of different versions the one of smallest hash of text and role counts, in whatever order they came.
Turns without a conversation's number are left out; those without a number of their own come first. Null text is empty.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import command_line, steady
from strandline.operators import describe, sequence
from strandline.session import new_folder

log = logging.getLogger("jobs.conversation_codes")
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
CODES = "conv_id long, turns long, level int, bin int, sx double, sy double, sz double, bucket int"


@dataclass(frozen=True)
class Config:
    buckets: int = 16  #: partitions of the codes; those that a batch touches are made anew
    files_per_batch: int = 1000  #: files that one micro-batch takes


def points(turns: DataFrame, buckets: int) -> DataFrame:
    """(conv_id, turn, x, y, z, version, bucket): words, characters and lines of every turn."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    version = F.sha2(F.concat_ws("\x1f", text, F.coalesce("role", F.lit(""))), 256)
    return turns.filter("conv_id is not null").select(
        "conv_id", "turn", words.cast("double").alias("x"), F.length(text).cast("double").alias("y"), (F.regexp_count(text, F.lit("\n")) + 1).cast("double").alias("z"),
        version.alias("version"), F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int").alias("bucket"),
    )


def codes(p: DataFrame) -> DataFrame:
    """Points of whole conversations -> their codes, in long form."""
    one = p.groupBy("conv_id", "turn", "bucket").agg(F.min_by(F.struct("x", "y", "z"), F.struct("version", "x", "y", "z")).alias("p"))
    t = one.select(F.col("conv_id").alias("seq_id"), "turn", "p.x", "p.y", "p.z")
    t = t.withColumn("t", F.row_number().over(sequence.W.partitionBy("seq_id").orderBy(F.col("turn").asc_nulls_first())).cast("long"))
    n = one.groupBy(F.col("conv_id").alias("seq_id"), "bucket").agg(F.count("*").alias("turns"))
    c = steady(describe.velocity_pyramid(t), "sx", "sy", "sz")
    return c.join(n, "seq_id").select(F.col("seq_id").alias("conv_id"), "turns", "level", "bin", "sx", "sy", "sz", "bucket")


def run(spark: SparkSession, turns: str, out: str, config: Config = Config()) -> DataFrame:
    """Take what is new at ``turns`` into ``out`` and return all codes as they stand."""
    landed, made = f"{out}/points", f"{out}/codes"

    def replace(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def batch(df: DataFrame, number: int) -> None:
        new = points(df, config.buckets)
        replace(new.withColumn("batch", F.lit(number)).repartition("bucket"), landed, "batch", "bucket")
        every = spark.read.schema(new.withColumn("batch", F.lit(0)).schema).parquet(landed)
        counts = {r["bucket"]: r["n"] for r in every.filter(F.col("batch") == number).groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        touched = codes(every.filter(F.col("bucket").isin(list(counts))))
        replace(touched.repartition("bucket"), made, "bucket")
        log.info("batch %d: read %d turns, wrote %d of %d buckets to %s", number, sum(counts.values()), len(counts), config.buckets, made)

    # a pattern that matches the path alone: a stream takes a single file, which may stand for a table, under a pattern only
    path = turns.rstrip("/")
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", config.files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    # before the first batch there is nothing to read
    try:
        back = spark.read.schema(CODES).parquet(made)
        log.info("%s holds %d rows", made, back.count())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        back = spark.createDataFrame([], CODES)
        log.info("%s has had no turn yet", turns)
    return back


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice into one new folder and checkpoint; the output after the second run."""
    out = new_folder(spark, "job2-conversation-codes")
    for _ in range(2):
        back = run(spark, f"{sf_dir}/conversations.parquet", out)
    return back.drop("bucket")


ORACLE = r"""
WITH o AS (SELECT conv_id, turn, len(regexp_extract_all(tx, '[^ \t\n\v\f\r]+')) AS x, length(tx) AS y, length(tx) - length(replace(tx, chr(10), '')) + 1 AS z, sha256(tx || chr(31) || coalesce(role, '')) AS version FROM (SELECT *, coalesce(text, '') AS tx FROM conversations) WHERE conv_id IS NOT NULL),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY version) AS k FROM o) WHERE k = 1),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS t, count(*) OVER (PARTITION BY conv_id) AS n, x, y, z FROM d),
u AS (SELECT conv_id, t, n, x / nullif(span, 0) AS x, y / nullif(span, 0) AS y, z / nullif(span, 0) AS z FROM t JOIN (SELECT conv_id, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM t GROUP BY conv_id) USING (conv_id)),
g AS (SELECT conv_id, t, n, {gradient} FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY t)),
v AS (SELECT conv_id, t, n, {velocity} FROM g),
p AS (SELECT conv_id, level, CAST(ceil(t / (n / level)) AS INTEGER) AS bin, sum(sx) AS sx, sum(sy) AS sy, sum(sz) AS sz FROM (SELECT *, unnest([1, 2, 4, 8]) AS level FROM v WHERE sz IS NOT NULL) GROUP BY ALL),
b AS (SELECT conv_id, turns, level, unnest(range(1, level + 1)) AS bin FROM (SELECT conv_id, count(*) AS turns, unnest([1, 2, 4, 8]) AS level FROM t GROUP BY conv_id)),
s AS (SELECT *, sqrt(sum(sx * sx + sy * sy + sz * sz) OVER (PARTITION BY conv_id)) AS size FROM (SELECT b.conv_id, turns, b.level, b.bin, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy, coalesce(sz, 0) AS sz FROM b LEFT JOIN p ON p.conv_id = b.conv_id AND p.level = b.level AND p.bin = b.bin))
SELECT conv_id, turns, CAST(level AS INTEGER) AS level, CAST(bin AS INTEGER) AS bin, {unit} FROM s
""".format(
    gradient=", ".join(f"CASE WHEN n = 1 THEN {c} - {c} WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS v{c}" for c in "xyz"),
    velocity=", ".join(f"v{c} / sqrt(sqrt(vx * vx + vy * vy + vz * vz) + 2.220446049250313e-16) AS s{c}" for c in "xyz"),
    unit=", ".join(f"CASE WHEN size > 0 THEN round(s{c} / size, 9) + 0.0 ELSE 0.0 END AS s{c}" for c in "xyz"),
)


if __name__ == "__main__":
    command_line("codes of conversations", Config, ("turns", "out"), run)
