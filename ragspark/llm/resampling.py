"""Importance resampling towards a target: weights from hashed n-gram ratios, and an exact draw of the highest scores.

Texts are scored in NumPy against arrays of buckets. A document's score is a
whole number, so a histogram of scores gives exact ranks: counts summed from the
top are a score's offset, the score at which the draw is full is the cutoff, and
only rows at or above it are numbered, by document within each score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.llm.shared import carried, materialise, table, text_or_empty

#: Bytes of text that are turned to words at once.
CHUNK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32)
#: The CRC-32 of one byte, as the table of a step: what the finished code differs by from the raw one is the same for all.
_STEP = _CRC ^ _CRC[0]


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``longest`` words, joined by one space, in ``buckets`` buckets by the CRC-32 of their bytes."""

    longest: int = 1
    buckets: int = 10_000


def crc32_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes, a byte of all runs at a time; runs over 64 bytes one by one."""
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    left = np.flatnonzero((sizes > 0) & (sizes <= 64))
    at = 0
    while len(left):
        c = crc[left]
        crc[left] = _STEP[(c ^ data[starts[left] + at]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        at += 1
        left = left[sizes[left] > at]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > 64):
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return crc


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in lower-cased bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _INSIDE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashed(texts: list[bytes], f: Features) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(index of the text, bucket) of all features and (words of each text, first text), for several texts at a time.

    Texts are joined by line ends, which no word holds; a run of words lies in one text.
    """
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        data = _LOWER[np.frombuffer(b"\n".join(texts[begin:end]), dtype=np.uint8)]
        starts, ends = word_spans(data)
        borders = np.cumsum([len(t) + 1 for t in texts[begin:end]])
        owner = np.searchsorted(borders, starts, side="right")
        owners, codes = [owner], [crc32_runs(data, starts, ends - starts)]
        if f.longest > 1:
            # Words joined by one space, in bytes of their own.
            lengths = ends - starts
            places = np.concatenate([[0], np.cumsum(lengths + 1)])
            joined = np.full(int(places[-1]), 0x20, dtype=np.uint8)
            within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            joined[np.repeat(places[:-1], lengths) + within] = data[np.repeat(starts, lengths) + within]
            for n in range(2, f.longest + 1):
                if len(starts) < n:
                    break
                one = owner[: len(owner) - n + 1] == owner[n - 1 :]
                first = np.flatnonzero(one)
                owners.append(owner[first])
                codes.append(crc32_runs(joined, places[first], places[first + n] - 1 - places[first]))
        yield np.concatenate(owners), np.concatenate(codes) % np.uint32(f.buckets), np.bincount(owner, minlength=end - begin), begin
        begin = end


def bucket_counts(df: DataFrame, f: Features, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts: each batch is one array of counts, and the arrays are summed by bucket."""
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(f.buckets, dtype=np.int64)
        for batch in batches:
            for _, buckets, _, _ in hashed([t.encode() for t in batch["_text"]], f):
                total += np.bincount(buckets, minlength=f.buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    rows = df.select(F.col(text).alias("_text")).filter("_text IS NOT NULL")
    return rows.mapInPandas(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, raw: DataFrame, f: Features) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to raw) of every bucket; ``f.buckets`` numbers reach the driver."""
    def array(counts: DataFrame) -> np.ndarray:
        out = np.zeros(f.buckets, dtype=np.float64)
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
        return out

    t, s = array(target), array(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + f.buckets) / ((s + 1) * (t.sum() + f.buckets)))).astype(np.int64)


def weighed(df: DataFrame, gain: np.ndarray, f: Features, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) of every row; a null text has no word and the weight 0."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_bucket = sent.value
        for batch in batches:
            n = len(batch)
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for owner, buckets, held, begin in hashed([t.encode() for t in batch["_text"]], f):
                size = len(held)
                words[begin : begin + size] = held
                features[begin : begin + size] = np.bincount(owner, minlength=size)
                # Sums in doubles would lose whole numbers beyond 2^53; these are added as longs.
                np.add.at(weight, owner + begin, by_bucket[buckets])
            yield pd.DataFrame({"_key": batch["_key"], "n_words": words, "n_features": features, "weight": weight})

    rows = df.select(carried(key).alias("_key"), text_or_empty(text).alias("_text"))
    out = rows.mapInPandas(score, "_key string, n_words long, n_features long, weight long")
    return out.select(F.col("_key").cast(kind).alias(key), "n_words", "n_features", "weight")


def noisy_score(weight: str, key: str, seed: int):
    """weight + floor(1000 Gumbel noise), the noise drawn from sha256("seed:key"); a null key draws as the text "null"."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.col(weight) + F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def ranks(scored: DataFrame, percent: int, least_words: int, key: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank``: 1, 2, .. of the floor(percent N / 100) highest scores among N rows of enough words, else null.

    Ties go to the smaller key (nulls first), then to the smaller weight and number of
    features; rows equal in all columns are counted as one before anything is
    shuffled, and take neighbouring ranks.
    """
    spark = scored.sparkSession
    cols = scored.columns
    rows = materialise(scored.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies")), "scored")
    able = rows.filter(F.col("n_words") >= least_words)
    counts = able.groupBy("score").agg(F.sum("_copies").alias("_n"))
    # Ranges of scores, highest first; sums within a range, then over the ranges, so that no task holds all scores.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialise(counts.repartitionByRange(parts, F.desc("score")).withColumn("_part", F.spark_partition_id()), "score-counts")
    sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.withColumn("_above", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(F.broadcast(base), "_part").select(
        "score", (F.col("_above") + F.col("_base")).alias("_above"))
    total = ranged.agg(F.sum("_n")).first()[0] or 0
    wanted = total * percent // 100
    cutoff = offsets.filter(F.col("_above") < wanted).agg(F.min("score")).first()[0]
    nothing = F.lit(None).cast("long")
    if cutoff is None:
        ranked = able.withColumn("_first", nothing)
    else:
        surviving = able.filter(F.col("score") >= cutoff).join(offsets.filter(F.col("score") >= cutoff), "score")
        order = [F.col(key), *[F.col(c) for c in cols if c != key]]
        earlier = F.sum("_copies").over(Window.partitionBy("score").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        ranked = surviving.withColumn("_first", F.col("_above") + F.coalesce(earlier, F.lit(0)) + 1).drop("_above").unionByName(
            able.filter(F.col("score") < cutoff).withColumn("_first", nothing))
    unable = rows.filter(F.col("n_words") < least_words).withColumn("_first", nothing)
    out = ranked.unionByName(unable).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)))
    rank = F.col("_first") + F.col("_i")
    return out.select(*cols, F.when(rank <= wanted, rank).cast("long").alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, f: Features = Features(),
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs(doc_id, text), drawn towards target(text).

    A null text, on either side, has no word; an empty target or table gives
    weights of smoothed counts or no rows. Columns not named do not matter.
    """
    gain = gains(bucket_counts(target, f), bucket_counts(docs, f), f)
    scored = weighed(docs, gain, f).withColumn("score", noisy_score("weight", "doc_id", seed))
    return ranks(scored, percent, least_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` drawn towards the texts of ``benchmark``, single words in 10,000 buckets."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB has no CRC-32; it is folded over the bytes of each distinct word.
OP13_SQL = f"""
WITH steps AS (
  SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v
  FROM (SELECT unnest(range(0, 256))::bigint AS b)
), crc AS (SELECT list(v ORDER BY b) AS t FROM steps),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents),
raw AS (SELECT r, unnest(ws) AS w FROM docs),
target AS (SELECT unnest(regexp_extract_all({_LOWERED}, '{_WORD}')) AS w FROM benchmark),
hashed AS (
  SELECT w, xor(list_reduce(regexp_extract_all(hex(encode(w)), '..').list_transform(lambda x: ('0x' || x)::bigint),
    lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM raw UNION SELECT w FROM target), crc
), s AS (SELECT bucket, count(*) AS n FROM raw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::double AS s_all, coalesce((SELECT sum(n) FROM t), 0)::double AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::double * (t_all + 10000))))::bigint AS g
  FROM s FULL JOIN t USING (bucket), sums
), weights AS (SELECT r, count(*) AS n_features, sum(g)::bigint AS weight FROM raw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double)
      / 4294967296::double)))::bigint AS score
  FROM docs LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) END AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
