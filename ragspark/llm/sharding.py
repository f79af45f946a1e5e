"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a score that depends on nothing else; a record goes
to the shard with the largest score. Adding a shard therefore only moves the
records for which the new shard scores best, and removing one only moves its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.llm.shared import materialise, table, text_or_empty

#: Hex digits of the MD5 that make the 52-bit draw of a (key, shard) pair.
DRAW_DIGITS = 13
#: Rows of a broadcast table, of 16 bytes each.
MOST_BROADCAST = 1 << 20


def rendezvous_shard(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The shard of ``key`` among ``shards``, pairs of (shard id, weight above 0).

    The draw u in (0, 1) is the head of md5("key:shard"); the score is
    -weight / ln(u), so a shard gets records in proportion to its weight. Equal
    scores go to the smaller shard id. A null key hashes as the text "null".
    """
    if not shards or any(w <= 0 for _, w in shards) or len({s for s, _ in shards}) < len(shards):
        raise ValueError("shards need distinct ids and weights above 0")
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def scored(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(text, F.lit(f":{shard}")))
        draw = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double")
        u = (draw + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("minus"))

    best = [scored(s, w) for s, w in shards]
    return -(F.greatest(*best) if len(best) > 1 else best[0]).getField("minus")


def equal_shards(n: int) -> list[tuple[int, float]]:
    return [(s, 1.0) for s in range(n)]


def assign_shards(
    df: DataFrame, key: str, shards: Sequence[tuple[int, float]], grown: Sequence[tuple[int, float]] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns ``key`` and ``keep`` of ``df`` with ``shard``, ``slot`` and ``grown_shard``.

    ``slot`` numbers a shard's rows from 0 without gaps in the order of the key
    and the kept columns (nulls first). Rows are range-partitioned by that
    order, counted per (range, shard), and numbered within; the table of counts
    has ranges times shards rows and is broadcast if those are MOST_BROADCAST at most. Rows equal in all these columns
    take neighbouring slots in any order; null keys all go to one shard; an empty
    table gives an empty result. Columns of ``df`` not named do not matter.
    """
    spark = df.sparkSession
    cols = [key, *keep]
    out = df.select(
        *cols,
        rendezvous_shard(F.col(key), shards).cast("int").alias("shard"),
        (rendezvous_shard(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialise(
        out.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()), "shards"
    )
    before = (
        ranged.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(
            Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "_part", F.coalesce("_base", F.lit(0)).alias("_base"))
    )
    within = F.row_number().over(Window.partitionBy("_part", "shard").orderBy(*cols))
    return (
        ranged.withColumn("_row", within)
        .join(F.broadcast(before) if parts * len(shards) <= MOST_BROADCAST else before, ["shard", "_part"])
        .select(*cols, "shard", (F.col("_base") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` over shards 0 to 23 under the law ``key``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    return assign_shards(docs, "doc_id", equal_shards(24), equal_shards(25), ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _draws(n: int) -> str:
    return (
        f"list_transform(range(0, {n}), lambda s: "
        "('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || s::varchar), 1, 13))::bigint)"
    )


def _shard(n: int) -> str:
    return f"(list_position({_draws(n)}, list_max({_draws(n)})) - 1)::int"


#: With equal weights the largest draw has the largest score. DuckDB has no CRC-32; it is folded over the bytes.
OP1_SQL = f"""
WITH steps AS (
  SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v
  FROM (SELECT unnest(range(0, 256))::bigint AS b)
), crc AS (SELECT list(v ORDER BY b) AS t FROM steps),
placed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
    list_reduce(regexp_extract_all(hex(encode(coalesce(text, ''))), '..').list_transform(lambda x: ('0x' || x)::bigint),
      lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::bigint) AS folded,
    {_shard(24)} AS shard, {_shard(25)} AS grown_shard
  FROM documents, crc
)
SELECT doc_id, size::bigint AS size, xor(folded, 4294967295)::bigint AS text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::bigint AS slot, grown_shard
FROM placed
"""
