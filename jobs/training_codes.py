"""Training and test codes of a gesture data set, from its event table.

    python -m jobs.training_codes --events EVENTS.parquet --out CODES --config jobs/training_codes.json

Every sequence is cleaned (missing points and repeats go), described by its square-root velocity at unit scale and pooled over a temporal
pyramid, the form that the classifiers take. Sequences too short for that are listed with a status, not lost. The output is
partitioned by split and label, so that a learner reads only what it trains on.

A run replaces the whole output, so a rerun gives the same files' rows; one that dies midway is repaired by the next.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, steady
from strandline.operators import describe, sequence
from strandline.session import new_folder
from strandline.sources import trajectories

log = logging.getLogger("jobs.training_codes")


@dataclass(frozen=True)
class Config:
    without: tuple[int, ...] = (12,)  #: labels that are left out
    train: tuple[int, ...] = (1, 3, 5, 7, 9)  #: labels whose sequences train; all others test
    shortest: int = 9  #: points that a sequence needs once repeats are gone
    ends: int = 2  #: rows left out at either end
    files: int = 2  #: files a partition


def codes(events: DataFrame, config: Config = Config()) -> DataFrame:
    """(seq_id, points, status, level, bin, sx, sy, sz, split, label); a sequence of status short has one row without a code."""
    t = trajectories.exclude(trajectories.from_events(events).drop("split"), F.col("label").isin(list(config.without)))
    kept = sequence.remove_repeats(sequence.drop_missing(t))
    n = t.groupBy("seq_id", "label").count().select("seq_id", "label").join(kept.groupBy("seq_id").agg(F.count("*").alias("points")), "seq_id", "left").fillna(0, ["points"])
    n = n.withColumn("status", F.when(F.col("points") < config.shortest, "short").otherwise("ok"))
    n = n.withColumn("split", F.when(F.col("label").isin(list(config.train)), "train").otherwise("test"))
    long = kept.join(n.filter("status = 'ok'").select("seq_id"), "seq_id", "left_semi")
    code = steady(describe.velocity_pyramid(long, config.ends), "sx", "sy", "sz")
    return n.join(code, "seq_id", "left").select("seq_id", "points", "status", "level", "bin", "sx", "sy", "sz", "split", "label")


def run(spark: SparkSession, events: str, out: str, config: Config = Config()) -> DataFrame:
    """Write the codes of the table at ``events`` to ``out`` and return them read back."""
    table = spark.read.parquet(events)
    log.info("reading %s: %d events", events, table.count())
    c = codes(table, config)
    spread = c.repartition("split", "label", F.pmod(F.xxhash64("seq_id"), F.lit(config.files)))
    spread.write.mode("overwrite").partitionBy("split", "label").parquet(out)
    back = spark.read.schema(c.schema).parquet(out)
    for r in back.groupBy("split", "label").agg(F.count_distinct("seq_id").alias("sequences"), F.count("*").alias("rows"), F.count_if(F.col("status") == "short").alias("short")).orderBy("split", "label").toLocalIterator():
        log.info("wrote %s split=%s label=%s: %d sequences, %d rows, %d too short", out, *r)
    return back


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice into one new folder; the output after the second run."""
    out = new_folder(spark, "job1-training-codes") + "/codes"
    for _ in range(2):
        back = run(spark, f"{sf_dir}/events.parquet", out)
    return back


ORACLE = """
WITH t AS (SELECT user_id AS seq_id, user_id % 12 + 1 AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(second(ts) AS DOUBLE) AS z FROM events WHERE user_id % 12 + 1 <> 12),
m AS (SELECT *, coalesce(x = lag(x) OVER w AND y = lag(y) OVER w AND z = lag(z) OVER w, false) AS again FROM t WHERE x IS NOT NULL AND NOT isnan(x) WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
k AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY t) AS t, x, y, z FROM m WHERE NOT again),
n AS (SELECT DISTINCT t.seq_id, t.label, coalesce(points, 0) AS points FROM t LEFT JOIN (SELECT seq_id, count(*) AS points FROM k GROUP BY seq_id) USING (seq_id)),
u AS (SELECT k.seq_id, t, points, x / nullif(span, 0) AS x, y / nullif(span, 0) AS y, z / nullif(span, 0) AS z FROM k JOIN n USING (seq_id) JOIN (SELECT seq_id, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM k GROUP BY seq_id) USING (seq_id) WHERE points >= 9),
g AS (SELECT seq_id, t, points, {gradient} FROM u WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
v AS (SELECT seq_id, t - 2 AS t, points - 4 AS n, {velocity} FROM g WHERE t > 2 AND t <= points - 2),
p AS (SELECT seq_id, level, CAST(ceil(t / (n / level)) AS INTEGER) AS bin, sum(sx) AS sx, sum(sy) AS sy, sum(sz) AS sz FROM (SELECT *, unnest([1, 2, 4, 8]) AS level FROM v WHERE sz IS NOT NULL) GROUP BY ALL),
b AS (SELECT seq_id, level, unnest(range(1, level + 1)) AS bin FROM (SELECT seq_id, unnest([1, 2, 4, 8]) AS level FROM n WHERE points >= 9)),
c AS (SELECT b.seq_id, b.level, b.bin, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy, coalesce(sz, 0) AS sz FROM b LEFT JOIN p ON p.seq_id = b.seq_id AND p.level = b.level AND p.bin = b.bin),
s AS (SELECT *, sqrt(sum(sx * sx + sy * sy + sz * sz) OVER (PARTITION BY seq_id)) AS size FROM c)
SELECT n.seq_id, points, CASE WHEN points < 9 THEN 'short' ELSE 'ok' END AS status, CAST(level AS INTEGER) AS level, CAST(bin AS INTEGER) AS bin, {unit}, CASE WHEN label IN (1, 3, 5, 7, 9) THEN 'train' ELSE 'test' END AS split, label
FROM n LEFT JOIN s USING (seq_id)
""".format(
    gradient=", ".join(f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS v{c}" for c in "xyz"),
    velocity=", ".join(f"v{c} / sqrt(sqrt(vx * vx + vy * vy + vz * vz) + 2.220446049250313e-16) AS s{c}" for c in "xyz"),
    unit=", ".join(f"CASE WHEN size IS NULL THEN NULL WHEN size > 0 THEN round(s{c} / size, 9) + 0.0 ELSE 0.0 END AS s{c}" for c in "xyz"),
)


if __name__ == "__main__":
    command_line("training codes of an event table", Config, ("events", "out"), run)
