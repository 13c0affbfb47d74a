"""Session builder with the settings the library's results depend on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster pass an existing session to the operators instead."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings | conf).getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new, uniquely named folder under the shared spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="strandline-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "work", *by: str) -> DataFrame:
    """df written to a new shared folder and read back: what is read many times is worked out once, and a lost executor costs no more than a task."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
