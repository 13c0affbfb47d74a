"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settings(kind: type, values: dict):
    """A job's configuration from a dictionary; names it does not have are refused."""
    known = {f.name for f in fields(kind)}
    if odd := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(odd)}; known: {', '.join(sorted(known))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def steady(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to nine places: the order in which a sum's rows arrive does not show, and a rerun writes the same values."""
    return df.withColumns({n: F.round(n, 9) + F.lit(0.0) for n in names})


def command_line(about: str, kind: type, paths: tuple[str, ...], work: Callable, argv: list[str] | None = None) -> None:
    """Parse --config and one option a path, start a session, do the work, stop the session."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--config", help="JSON file with the job's settings; the defaults hold where it says nothing")
    for x in paths:
        p.add_argument(f"--{x}", required=True, help="a path that Spark's readers and writers understand")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = settings(kind, json.loads(Path(a.config).read_text()) if a.config else {})
    spark = SparkSession.builder.appName(about).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, *(getattr(a, x) for x in paths), config)
    finally:
        spark.stop()
