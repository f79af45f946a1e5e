"""A training corpus in five stages: languages, lines, near-duplicates, benchmarks, packing.

Every stage takes the documents that the one before kept and returns the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import copies, decontaminate, langid, lines, packing
from ragspark.llm.shared import materialise, table

#: Columns of ``documents``; others, whatever their names, are left behind.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language has at least this share of it.
LEAST_SHARE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language prevails; those without letters or without such a language go.

    The model is fitted on the labels of the documents themselves. A missing
    label is filled with the prediction.
    """
    docs = docs.select(*COLUMNS)
    names, model = langid.fit(docs)
    found = langid.identify(docs, names, model, keep=docs.columns)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; a document with no word left goes."""
    found = lines.remove_similar_lines(docs.select(*COLUMNS))
    kept = found.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")})
    return kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingles, Jaccard 0.8) the row with the smallest id, then text hash.

    Candidates come from the SimHash operator and from MinHash bands and are verified on the whole sets. A null id
    comes last. Rows without a near copy stay, whatever their ids.
    """
    docs = docs.select(*COLUMNS)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), copies.node("text").alias("node"))
    own = docs.select(rank.alias("rank")).groupBy(F.col("rank.node").alias("node")).agg(F.min("rank").alias("rank"))
    rooted = own.join(copies.near_copies(docs), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("rank").alias("rank")).select(
        F.col("rank.doc_id").alias("_id"), F.col("rank.hash").alias("_hash"), F.col("rank.node").alias("_node"))
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"]) & (copies.node("text") == kept["_node"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed along the curve."""
    return packing.piece_digests(packing.pack(docs, packing.default_tokenizer()))


STAGES = [
    ("language_id", languages),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL expresses neither the language model nor fingerprints, edit distances and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
