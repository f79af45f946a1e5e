"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each block of
vectors keeps inverted files, for every pivot the vectors that rank it and at
which place. A query walks the files of its own nearest pivots, ranks a block's
vectors by Spearman's footrule on the two orders, and the best are ranked anew
by their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.llm.shared import materialise, table

#: Pivots of an index, the bounded sample it is fitted on, and how many of them represent a vector.
PIVOTS, PREFIX = 256, 128
#: The share of each block that is measured exactly, the best by footrule.
SHARE = 0.1
#: Vectors of a block, and queries handled with it at once.
BLOCK, CHUNK = 4096, 1024
NEAREST = 10


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: ``id``, ``v`` (doubles) and the vector's two hashes ``h1`` and ``h2``.

    A null id, and a vector that is null, empty, all zero, or has a null or
    non-finite component, take no part. Rows with the same id and vector count once.
    """
    doubles = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    good = rows.select(F.col(key).cast("long").alias("id"), doubles.alias("v")).filter(
        F.col("id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    return good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit("second"))}).dropDuplicates(["id", "h1", "h2"])


def classes_of(good: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids; no other copy can be among the nearest of any query."""
    first = Window.partitionBy("h1", "h2").orderBy("id")
    kept = good.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= keep)
    return kept.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids"))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first."""
    square = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
    return np.argsort(square, axis=1, kind="stable")[:, :prefix]


def inverted_files(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by pivot: (row, place) arrays, and where each pivot's postings begin."""
    n, prefix = order.shape
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    begins = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
    return (by_pivot // prefix).astype(np.int32), (by_pivot % prefix).astype(np.int32), begins


def footrule_scores(order: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, prefix: int) -> np.ndarray:
    """For one query's order: prefix * (prefix + 1) less the footrule, halved, for each of ``n`` rows; larger is nearer.

    A pivot that one of the two lacks counts as at the place after the last.
    """
    rows, places, begins = files
    at = np.concatenate([np.arange(begins[p], begins[p + 1]) for p in order])
    own = np.repeat(np.arange(len(order)), begins[order + 1] - begins[order])
    return np.bincount(rows[at], weights=prefix - np.maximum(places[at], own), minlength=n)


def search(
    rows: DataFrame, is_query, key: str, vector: str, k: int = NEAREST, pivots: int = PIVOTS, prefix: int = PREFIX,
    share: float = SHARE,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found of every query row.

    ``is_query`` is a condition on the id, as ``F.col("id")``. Nearness is the
    Euclidean distance in doubles, ties go to the smaller id, and a query's own
    id is no candidate. Equal vectors are indexed once with their k + 1
    smallest ids, which is exact for any number of copies. All other vectors are
    in the index; blocks are of BLOCK vectors, whatever the partitions, and
    queries meet all blocks, in chunks, so a task holds one block and one chunk.
    Of each block at least 2 (k + 1) vectors are measured. An id with several
    vectors is a candidate with each of them, and asks with the smallest,
    compared component by component. Vectors of each length are searched among
    their own kind. See ``usable`` for what takes no part. Empty tables give an
    empty result.
    """
    good = usable(rows, key, vector)
    lengths = sorted(r["n"] for r in good.groupBy(F.size("v").alias("n")).count().collect()) or [0]
    if len(lengths) == 1:
        return _search(good, is_query, k, pivots, prefix, share)
    good, out = materialise(good, "usable-vectors"), None
    # Of an id's vectors of several lengths, those of the smallest length ask.
    asking = good.filter(is_query).groupBy("id").agg(F.min(F.size("v")).alias("_n"))
    for n in lengths:
        own = good.filter(F.size("v") == n)
        here = asking.filter(F.col("_n") == n).select("id")
        one = _search(own, is_query, k, pivots, prefix, share).join(here.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
        out = one if out is None else out.union(one)
    return out


def _search(good: DataFrame, is_query, k: int, pivots: int, prefix: int, share: float) -> DataFrame:
    """``search`` among usable vectors of one length."""
    stored = materialise(classes_of(good, k + 1), "vectors")
    smallest = good.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    wanted = materialise(smallest.select("id", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit("second")).alias("h2"), "v"), "queries")
    top = stored.select("v").orderBy(F.xxhash64("v", F.lit("pivot")), "v").limit(pivots).collect()
    points = np.array([r["v"] for r in top]) if top else np.zeros((1, 1))
    prefix = min(prefix, len(points))

    def block_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.iloc[a : a + BLOCK]
                x = np.array(part["v"].tolist())
                yield pd.DataFrame([{
                    "n": len(x), "x": x.tobytes(), "p": orders(x, points, prefix).astype("<i2").tobytes(),
                    "h1": part["h1"].to_numpy(np.int64).tobytes(), "h2": part["h2"].to_numpy(np.int64).tobytes(),
                }])

    schema = "n int, x binary, p binary, h1 binary, h2 binary"
    parts = max(1, -(-stored.count() // BLOCK))
    blocks = stored.repartition(parts, "h1").mapInPandas(block_up, schema).withColumn("k", F.spark_partition_id())
    asked = wanted.dropDuplicates(["h1", "h2"])
    n_chunks = max(1, -(-asked.count() // CHUNK))
    chunks = (
        asked.withColumn("c", F.pmod(F.xxhash64("h2"), F.lit(n_chunks))).repartition(n_chunks, "c").sortWithinPartitions("c")
        .mapInPandas(block_up, schema)
    )
    chunks = materialise(chunks.select(*[F.col(c).alias(f"q{c}") for c in ("n", "x", "p", "h1", "h2")]), "chunks")
    dealt = chunks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = materialise(blocks, "blocks").join(dealt.hint("shuffle_hash"), "k")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.frombuffer(r.x).reshape(r.n, -1)
                files = inverted_files(np.frombuffer(r.p, dtype="<i2").reshape(r.n, -1).astype(np.int64), len(points))
                h1, h2 = np.frombuffer(r.h1, dtype=np.int64), np.frombuffer(r.h2, dtype=np.int64)
                q1, q2 = np.frombuffer(r.qh1, dtype=np.int64), np.frombuffer(r.qh2, dtype=np.int64)
                queries = np.frombuffer(r.qx).reshape(r.qn, -1)
                budget = min(r.n, max(2 * (k + 1), int(np.ceil(share * r.n))))
                out = []
                for i, order in enumerate(np.frombuffer(r.qp, dtype="<i2").reshape(r.qn, -1).astype(np.int64)):
                    near = np.argpartition(-footrule_scores(order, files, r.n, prefix), budget - 1)[:budget]
                    score = np.sqrt(((x[near] - queries[i]) ** 2).sum(axis=1))
                    best = np.flatnonzero(score <= np.partition(score, min(k, len(score) - 1))[min(k, len(score) - 1)])
                    out.append(pd.DataFrame({"q1": q1[i], "q2": q2[i], "h1": h1[near[best]], "h2": h2[near[best]], "score": score[best]}))
                yield pd.concat(out)

    found = pairs.mapInPandas(probe, "q1 long, q2 long, h1 long, h2 long, score double")
    members = stored.select("h1", "h2", "ids")
    ranked = Window.partitionBy("q1", "q2").orderBy("score", F.element_at("ids", 1))
    nearest = (
        found.join(members, ["h1", "h2"]).withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= k + 1)
        .groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    )
    flat = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id")))))
    queries = wanted.select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    return (
        queries.join(nearest, ["q1", "q2"])
        .select("query_id", F.slice(F.sort_array(F.filter(flat, lambda c: c["vec_id"] != F.col("query_id"))), 1, k).alias("best"))
        .select("query_id", F.posexplode("best").alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every ``embeddings`` row whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, "vec_id", "embedding")
