"""Where intermediate tables may be written: the shared folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local master may go without: there a
    temporary folder is as shared as any."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return f"{tempfile.gettempdir()}/revspan-{spark.sparkContext.applicationId}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/revspan-{uuid.uuid4().hex}/{name}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write ``table`` to the shared folder and read it back: a short lineage that survives
    lost executors, and no second computation."""
    spark = table.sparkSession
    path = scratch_path(spark, name)
    table.write.parquet(path)
    return spark.read.parquet(path)
