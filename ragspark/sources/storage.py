"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of that name in the shared folder (``spark.checkpoint.dir``), deleted with the driver's JVM.

    Where the setting is missing, a temporary folder serves a local master; on a
    cluster it is an error, as executors have no disk in common.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ragspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a scratch folder and read again: a plan that is used more than once is computed once."""
    path = scratch(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
