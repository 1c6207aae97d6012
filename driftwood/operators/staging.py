"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; where it is unset, a local session takes a temporary one and a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='driftwood-')}"
    return f"{base.rstrip('/')}/driftwood-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df, written once and read from there: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
