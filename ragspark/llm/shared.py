"""Helpers that the training-data operators share: shared storage and sizes."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder serves a local master; on a cluster
    an unset folder is an error, because executors have no common local disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ragspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before. Shuffle files of the write go when it ends, the table itself
    by ``discard`` or with the driver's JVM.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    with released_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def _place(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop's objects."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(stored: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once no frame that is still to be computed reads it."""
    place, files = _place(stored.sparkSession, stored.stored_at)
    files.delete(place, True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block, shuffle files go as soon as the query that made them ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and what one keeps adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def buckets_for(df: DataFrame, text: str = "text", bytes_each: int = 8 << 20) -> int:
    """Hash buckets so that each holds about ``bytes_each`` of ``df``'s input.

    The input's size is that of the files below the plan. Where a leaf is no
    file (rows from an RDD, say, of which Spark knows no size) the texts are
    measured in a pass of their own.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [leaves.apply(i) for i in range(leaves.size())]
    if known and all(x.getClass().getSimpleName() == "LogicalRelation" for x in known):
        size = sum(int(str(x.stats().sizeInBytes())) for x in known)
    else:
        size = df.agg(F.sum(F.octet_length(text)).cast("long")).first()[0] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2 * shuffle, math.ceil(size / bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(key: str) -> Column:
    """A key as text: pandas would turn whole numbers into floats where one is null."""
    return F.col(key).cast("string").alias(key)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or the first like it that is not taken (names are compared without case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def tiled(df: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Split each group of ``keys`` into pairs of chunks of about ``limit`` rows.

    Any two rows of one group meet in at least one (group, ``_lo``, ``_hi``), and
    no such cell is expected to hold over ``2 * limit`` rows. ``member`` is the
    column whose hash picks a row's chunk. Groups of one row are left out.

    The sizes meet the rows in a sort-merge join: Spark's estimate for exploded
    rows leaves out how many each row makes, so without the hint it would send
    many millions of them to the driver for a broadcast.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = df.join(sizes.hint("merge"), keys)
    chunks = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col("_chunks")).cast("int")
    return (
        joined.withColumn("_chunks", chunks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
        .drop("_own", "_other", "_chunks", "_n")
    )
