"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` bits are linked. Every bit
position has a vector over GF(2) of radius + 1 components; mask v keeps the
positions whose vector has an odd product with v. Any ``radius`` positions span
too small a space to reach all v, so some mask misses all of them: each linked
pair agrees under at least one mask and meets in that table's bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import carried, discard, materialise, table, tiled

BITS = 64
SEED = 42
#: Fingerprints of a bucket that are compared in one cell.
CELL = 4096
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted, as an unsigned number.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a
    text of fewer words than a shingle is one shingle, one without words is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    places = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long, of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["_text"]], dtype=np.uint64)
            yield pd.DataFrame({key: batch[key], "fp": found.view(np.int64)})

    return docs.select(carried(key), F.col(text).alias("_text")).mapInPandas(each, f"`{key}` string, fp long").withColumn(key, F.col(key).cast(kind))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks, as signed longs; any ``radius`` positions are missed by one of them."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(bits) if bin((i % vectors + 1) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (member, first member) that connect what the links among ``members`` connect."""
    codes = members.view(np.uint64)
    left, edges = np.arange(len(codes)), []
    while len(left):
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(codes[left] ^ codes[queue.pop()]) <= radius
            if near.any():
                edges += [(int(members[i]), int(members[first])) for i in left[near]]
                queue += left[near].tolist()
                left = left[~near]
    return edges


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits.

    Within a bucket, or a cell of a large one, a spanning forest of its links is
    returned in place of all pairs, so no link between components is lost.
    """
    tables = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for k, m in enumerate(covering_masks(radius))
    ])
    posted = distinct.select("fp", F.explode(tables).alias("_")).select("fp", "_.t", "_.k")
    cells = tiled(posted, ["t", "k"], "fp", CELL).groupBy("t", "k", "_lo", "_hi").agg(F.collect_list("fp").alias("fps")).select("fps")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges: set[tuple[int, int]] = set()
            for fps in batch["fps"]:
                if len(fps) == 2:
                    a, b = int(fps[0]), int(fps[1])
                    if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                        edges.add((max(a, b), min(a, b)))
                elif len(fps) > 2:
                    edges.update(_forest(np.sort(np.asarray(fps, dtype=np.int64)), radius))
            yield pd.DataFrame(list(edges), columns=["a", "b"], dtype="int64")

    return cells.mapInPandas(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for all nodes of the undirected edges (a, b).

    Alternating large-star and small-star rounds; each writes its edges to the
    shared folder and drops the ones before. Minima are combined before they are
    shuffled; a hub's own edges meet its one minimum in a join that adaptive
    execution splits where they are many.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "large-star")
        discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("_"))
        edges = materialise(edges.select("_.a", F.col("_.m").alias("b")).filter("a <> b").distinct(), "small-star")
        discard(large)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of each row.

    ``component_id`` is the smallest key among the rows it can reach over links
    of fingerprints at most ``radius`` bits apart. Null and empty texts have
    fingerprint 0 and link like others. Rows with equal texts share a
    fingerprint and are joined as one; a null key has no rank among keys, so a
    component of null keys only has a null id. Only ``key`` and ``text`` are read.
    """
    marked = materialise(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(key).alias("_least"))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return marked.hint("merge").join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``: 4-word shingles, 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
