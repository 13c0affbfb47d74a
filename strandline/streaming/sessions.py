"""Trajectories from a stream: an extension, there is no batch counterpart to match.

A sequence is a session: points of one key whose event times are less than a gap apart. It is emitted when the watermark has
passed its end, whole and numbered, so that the batch operators apply to it in foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_sequences(points: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """(key, ts, x, y, z) stream -> key, begin, seq_id, t, x, y, z of sessions that are over; late points beyond delay are dropped."""
    s = points.withWatermark("ts", delay).groupBy("key", F.session_window("ts", gap).alias("w"))
    rows = s.agg(F.array_sort(F.collect_list(F.struct("ts", "x", "y", "z"))).alias("p"))
    rows = rows.select("key", F.col("w.start").alias("begin"), F.xxhash64("key", "w.start").alias("seq_id"), F.posexplode("p").alias("k", "p"))
    return rows.select("key", "begin", "seq_id", (F.col("k") + 1).cast("long").alias("t"), "p.x", "p.y", "p.z")


def describe_stream(points: DataFrame, describe: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **options: str):
    """Run a batch operator on every group of closed sequences and append its rows to path."""

    def batch(df: DataFrame, _: int) -> None:
        describe(df).write.mode("append").parquet(path)

    return closed_sequences(points, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
