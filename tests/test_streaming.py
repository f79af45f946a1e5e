import pytest
from pyspark.sql import functions as F

from ragspark.streaming import resume


def test_a_failed_batch_is_run_again_and_writes_nothing_twice(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.range(6).withColumn("q", F.concat(F.lit("q"), F.col("id").cast("string")))
    for part in (rows.filter("id < 3"), rows.filter("id >= 2")):
        part.coalesce(1).write.mode("append").parquet(source)
    calls = []

    def fails(batch):
        calls.append(sorted(r.id for r in batch.collect()))
        done = batch.withColumn("a", F.upper("q"))
        if len(calls) == 2:
            # The batch is written in part, and the run dies before it is committed.
            done.write.mode("overwrite").parquet(f"{sink}/batch=1")
            raise RuntimeError("lost")
        return done

    with pytest.raises(Exception, match="lost"):
        resume.answer_batches(spark, source, rows.schema, fails, sink, check, files_at_once=1)
    resume.answer_batches(spark, source, rows.schema, fails, sink, check, files_at_once=1)
    resume.answer_batches(spark, source, rows.schema, fails, sink, check, files_at_once=1)
    assert sorted(calls[0] + calls[2]) == list(range(6)) and sorted(calls[1]) == sorted(calls[2]) and len(calls) == 3
    got = resume.answers(spark, sink).collect()
    assert sorted((r.id, r.a) for r in got) == [(i, f"Q{i}") for i in range(6)]


def test_a_replayed_batch_replaces_what_it_wrote(spark, tmp_path):
    sink = str(tmp_path / "out")
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, q string")
    for _ in range(2):
        resume.append_once(batch, 0, lambda b: b.select("id"), sink)
    resume.append_once(batch.union(spark.createDataFrame([(3, "d")], batch.schema)), 1, lambda b: b.select("id"), sink)
    assert sorted((r.batch, r.id) for r in resume.answers(spark, sink).collect()) == [(0, 1), (0, 2), (1, 3)]


def test_no_answers_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        resume.answers(spark, str(tmp_path / "none"))
