"""A streaming front door: questions in, answers out, each once.

Two sinks give the resume rule. The file sink's own log serves plans that
Structured Streaming runs itself; ``answer_batches`` serves whatever needs
tables of its own (an index, a reranker, verification): every micro-batch writes
one directory that carries its number, so a batch that is run again replaces
what its first try left, and an id that an earlier batch answered is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def answer_stream(
    spark: SparkSession, source: str, schema: StructType, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> None:
    """Answers the Parquet questions that have come to ``source`` since the last call and appends them to ``sink``."""
    questions = spark.readStream.schema(schema).parquet(source)
    query = answer(questions).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _answered(spark: SparkSession, sink: str, before: int) -> DataFrame | None:
    """What batches below ``before`` wrote; None if there is nothing yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    held = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/batch=*/_SUCCESS"))
    numbers = sorted({int(str(s.getPath().getParent().getName()).split("=")[1]) for s in held or []})
    paths = [f"{sink}/batch={n}" for n in numbers if n < before]
    return spark.read.option("basePath", sink).parquet(*paths) if paths else None


def append_once(batch: DataFrame, number: int, answer: Callable[[DataFrame], DataFrame], sink: str, key: str = "id") -> None:
    """Answers a batch's rows whose ``key`` no earlier batch answered into the directory of the batch's number.

    Only directories that were written whole count as answered. Of rows with one
    key the batch answers one.
    """
    known = _answered(batch.sparkSession, sink, number)
    fresh = batch.dropDuplicates([key])
    if known is not None:
        fresh = fresh.join(known.select(key).distinct(), key, "left_anti")
    answer(fresh).write.mode("overwrite").parquet(f"{sink}/batch={number}")


def answer_batches(
    spark: SparkSession, source: str, schema: StructType, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "id", files_at_once: int = 1000,
) -> None:
    """Answers all Parquet questions that have come to ``source``, batch by batch; after a failure the next call goes on with the failed batch.

    ``answer`` gets each batch as a table, so it may read indexes and write
    tables of its own; its result has to keep ``key``.
    """
    questions = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    query = questions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, number: append_once(batch, number, answer, sink, key)).start()
    query.awaitTermination()


def answers(spark: SparkSession, sink: str) -> DataFrame:
    """All answers of a sink that ``answer_batches`` wrote, with the number of their batch."""
    found = _answered(spark, sink, 1 << 62)
    if found is None:
        raise FileNotFoundError(f"no answers at {sink}")
    return found


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Events of each key in windows of ``width``; those later than ``late`` are left out of a stream."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", width), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), *keys, "n")
