"""Rows that later steps start from, written to the folder in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """Where this session keeps rows. A temporary folder is used only in local mode and when ``spark.checkpoint.dir`` isn't set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="alertloom-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/kept"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet and read again: what follows starts from them, and doesn't compute or plan what came before again.

    Each reader scans only the columns it needs, and lost executors lose nothing. ``clear`` deletes what a session has kept.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all rows that this session has kept. DataFrames that start from them can't be computed afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
