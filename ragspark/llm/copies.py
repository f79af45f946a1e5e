"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

Candidates are the components of SimHash fingerprints (covering LSH, as ``op3``
finds them) and, as most pairs at the threshold differ in more bits than masks
can cover, what meets in a MinHash band. Both are verified on the whole sets, so
no pair is linked wrongly. A pair at the threshold itself meets in none of the
bands with a probability of (1 - 0.8^ROWS)^BANDS, 7 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import buckets_for, materialise, release_memory, text_or_empty, tiled
from ragspark.llm.simhash import components, near_duplicates
from ragspark.llm.words import hashed_text, mix, window_hashes

SHINGLE, BANDS, ROWS = 5, 30, 5
#: Bits in which linked fingerprints differ at most.
RADIUS = 4
#: Jaccard similarity from which sets are linked, as a fraction.
SIMILAR = (4, 5)
#: Sets of a band's bucket that are compared in one cell.
CELL = 256
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] | np.uint64(1)


def node(text: str) -> Column:
    """A 64-bit hash of a text's words, alike for texts with the same words (ASCII white space and case do not count)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_replace(F.translate(text_or_empty(text), upper, upper.lower()), r"[ \x09-\x0D]+", " ")
    return F.xxhash64(F.trim(words))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; fewer words than a shingle are one."""
    words = hashed_text(text.encode("utf-8", "surrogatepass"), lower=True)
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """One 64-bit key of each band."""
    # Shingles are hashed already: odd factors permute them well enough.
    least = np.min([(found[i : i + 2048] * _FACTORS).min(axis=1) for i in range(0, len(found), 2048)], axis=0).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, dtype=np.uint64)
    for column in least.T:
        key = mix(key ^ column)
    return key.view(np.int64)


def forest(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what the pairs of similar sets connect."""
    least, whole = SIMILAR
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    everything = np.concatenate(sets)
    left, edges = np.ones(len(ids), bool), []
    for first in range(len(ids)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue and left.any():
            one = queue.pop()
            can = np.flatnonzero(left & (whole * np.minimum(sizes, sizes[one]) >= least * np.maximum(sizes, sizes[one])))
            if not len(can):
                continue
            own = everything if len(can) == len(ids) else np.concatenate([everything[ends[i] - sizes[i] : ends[i]] for i in can])
            place = np.searchsorted(sets[one], own)
            same = sets[one][np.minimum(place, sizes[one] - 1)] == own
            common = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes[can]) - sizes[can])
            near = can[whole * common >= least * (sizes[can] + sizes[one] - common)]
            edges += [(ids[i], ids[first]) for i in near]
            left[near] = False
            queue += near.tolist()
    return edges


def _band_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(n, bands(s)) for n, t in zip(batch["_node"], batch["_text"], strict=True) if len(s := shingles(t))]
        yield pd.DataFrame(rows, columns=["_node", "keys"])
    release_memory()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"_node": batch["_node"], "set": [shingles(t).tobytes() for t in batch["_text"]]})
    release_memory()


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    edges: set[tuple[int, int]] = set()
    for _, cell in rows.groupby("cell"):
        cell = cell.drop_duplicates("_node")
        edges.update(forest(cell["_node"].tolist(), [np.frombuffer(s, np.uint64) for s in cell["set"]]))
    return pd.DataFrame(list(edges), columns=["a", "b"], dtype="int64")


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``node`` and ``root``, for all nodes (as ``node`` gives them) that have a near copy.

    Two nodes have one root if links of similar texts connect them. Texts are
    read whole; those without words are alike and have one node.
    """
    texts = docs.select(node(text).alias("_node"), text_or_empty(text).alias("_text"))
    keys = materialise(texts.mapInPandas(_band_keys, "_node long, keys array<long>"), "bands").dropDuplicates(["_node"])
    worded = texts.filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    alike = materialise(near_duplicates(worded, "_node", "_text", SHINGLE, RADIUS).select("_node", "component_id").distinct(), "fingerprint-components")
    posted = keys.select("_node", F.posexplode("keys").alias("t", "k")).union(alike.select("_node", F.lit(BANDS).alias("t"), F.col("component_id").alias("k")))
    cells = tiled(posted, ["t", "k"], "_node", CELL).groupBy("t", "k", "_lo", "_hi").agg(F.array_sort(F.collect_set("_node")).alias("nodes"))
    # Near copies meet in many bands and mostly in a component: cells of the same members are compared once.
    cells = materialise(cells.filter(F.size("nodes") > 1).select("nodes").distinct(), "band-cells")
    members = cells.select(F.xxhash64("nodes").alias("cell"), F.explode("nodes").alias("_node"))
    active = texts.join(members.select("_node").distinct(), "_node", "left_semi").dropDuplicates(["_node"])
    sets = materialise(active.mapInPandas(_sets, "_node long, set binary"), "shingle-sets")
    bucket = F.pmod(F.xxhash64("cell", F.lit(3)), F.lit(4 * buckets_for(docs, text)))
    linked = members.join(sets, "_node").withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_links, "a long, b long")
    return components(linked)
