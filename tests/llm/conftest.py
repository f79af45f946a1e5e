import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark: SparkSession):
    """Makes a documents table of (doc_id, text) pairs, written as Parquet so that stages read what they would."""
    import uuid

    def make(rows, extra: dict | None = None) -> DataFrame:
        full = [(i, t, None, "src", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        for name, value in (extra or {}).items():
            df = df.withColumn(name, F.lit(value))
        path = f"{spark.conf.get('spark.checkpoint.dir')}/docs-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


#: Names that the operators use for columns of their own.
CLASHES = {n: 1 for n in ("_row", "_hash", "_text", "_size", "_order", "_kept", "at", "again", "similar", "kept", "fp", "ids", "score", "shard", "spans", "lang_pred", "v", "id", "h1", "rank")}


@pytest.fixture(scope="session")
def clashes():
    return CLASHES
