"""Tables between the steps of a job, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; only a local session may do without that."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return (shared or tempfile.mkdtemp(prefix="tidewick-")).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read again; its plan ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
