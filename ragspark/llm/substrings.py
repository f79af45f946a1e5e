"""Substring dedup by fixed-block anchors.

Any window of 35 words holds a block of 18 words that begins at a multiple of
18 in its document. Those reference blocks are indexed; every run of 18 words of
every document probes the index. A window around a hit may occur twice; such
windows are compared whole, by 96 more bits of hash, and what the repeated ones
cover, the maximal exact repeats, is removed.

Probes travel packed: a row is what one batch of documents has for one bucket
of hashes, a few bytes a probe. A batch sends each hash once, however often it
has it, so a passage that all documents share costs a few bytes a batch. Groups
of any size are counted, never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import buckets_for, carried, materialise, table, text_or_empty
from ragspark.llm.words import hashed_text, in_chunks, window_hashes

WINDOW = 35
#: Every window of 2 * BLOCK - 1 words or more holds a whole reference block.
BLOCK = (WINDOW + 1) // 2
#: Bytes of text in a batch.
BATCH_BYTES = 3 << 20
PACKED = "bucket int, batch long, n int, payload binary"


def pack(at: np.ndarray, marks: np.ndarray, *hashes: np.ndarray) -> bytes:
    """Ascending positions as steps of 2 bytes (4 where one needs it), a bit each of ``marks``, and the hashes."""
    steps = np.diff(at, prepend=0)
    wide = len(steps) and steps.max() > 0xFFFF
    return b"".join([b"\4" if wide else b"\2", steps.astype("<u4" if wide else "<u2").tobytes(), np.packbits(marks).tobytes(), *(h.tobytes() for h in hashes)])


def unpack(payload: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """What ``pack`` was given."""
    width, at, out = payload[0], 1, []
    out.append(np.frombuffer(payload, f"<u{width}", n, at).astype(np.int64).cumsum())
    at += width * n
    out.append(np.unpackbits(np.frombuffer(payload, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
    at += (n + 7) // 8
    for kind in kinds:
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def deal(
    bucket: np.ndarray, n_buckets: int, batch: int, marks: np.ndarray, *hashes: np.ndarray, places: np.ndarray | None = None
) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of PACKED for the entries of one batch; an entry's position is its place in the batch, or in ascending ``places``."""
    if not len(bucket):
        return
    by = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
    sorted_ = bucket[by]
    begins = np.flatnonzero(np.diff(sorted_, prepend=-1))
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(by)], strict=True):
        at = by[begin:end]
        yield int(sorted_[begin]), batch, len(at), pack(at if places is None else places[at], marks[at], *(h[at] for h in hashes))


def batch_number(n: int) -> int:
    """The same for a partition's n-th batch whenever that partition is computed."""
    return (TaskContext.get().partitionId() << 32) + n


def anchors(n_buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packed probes of every run of BLOCK words, reference blocks marked, and a list of each batch's documents."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(in_chunks(batches, "_size", BATCH_BYTES)):
            number, hashes, marks, counts = batch_number(number), [], [], []
            for text in batch["_text"]:
                words = hashed_text(text.encode("utf-8", "surrogatepass"))
                found = window_hashes(words, BLOCK) if len(words) >= WINDOW else words[:0]
                hashes.append(found)
                counts.append(len(found))
                marks.append(np.arange(len(found)) % BLOCK == 0)
            h, mark = np.concatenate(hashes), np.concatenate(marks)
            first, head = firsts(h)
            reference, often = np.zeros(len(h), bool), np.zeros(len(h), bool)
            reference[head[mark]] = True
            often[head[~first]] = True
            send, h = np.flatnonzero(first), h[first]
            bucket = ((h >> np.uint64(39)) % np.uint64(n_buckets)).astype(np.int64)
            low, high = h.astype("<u4"), (h >> np.uint64(32)).astype(np.uint8) & np.uint8(127) | often[send].astype(np.uint8) << np.uint8(7)
            rows = list(deal(bucket, n_buckets, number, reference[send], low, high, places=send))
            yield pd.DataFrame([*rows, listing(batch, counts, number, n_buckets, first, head)], columns=["bucket", "batch", "n", "payload"])

    return emit


def firsts(h: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the first with their hash (and the same in ``more``), and each entry's first one."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    _, heads, group = np.unique(h, return_index=True, return_inverse=True)
    own = np.arange(len(h))
    head = heads[group]
    if more is not None:
        head = np.where(more == more[head], head, own)
    return head == own, head


def listing(
    batch: pd.DataFrame, counts: list[int], number: int, n_buckets: int, first: np.ndarray | None = None, head: np.ndarray | None = None
) -> tuple[int, int, int, bytes]:
    """The row that tells which entries of a batch are whose: row numbers, hashes of texts and numbers of entries.

    After these come the entries that were not sent, each with the first one of its kind.
    """
    body = batch["_row"].to_numpy("<i8").tobytes() + batch["_hash"].to_numpy("<i8").tobytes() + np.array(counts, dtype="<i8").tobytes()
    if first is not None:
        unsent = np.flatnonzero(~first)
        body += unsent.astype("<u4").tobytes() + head[unsent].astype("<u4").tobytes()
    return n_buckets + number % n_buckets, number, len(counts), body


def repeated_anchors(rows: pd.DataFrame, n_buckets: int) -> pd.DataFrame:
    """Of one bucket, the probes whose hash is a reference block's and occurs more than once."""
    if rows["bucket"].iloc[0] >= n_buckets:
        return rows[["batch", "n", "payload"]].assign(listing=True)
    parts = [unpack(p, n, "<u4", "u1") for p, n in zip(rows["payload"], rows["n"], strict=True)]
    h = np.concatenate([p[2].astype(np.uint64) | (p[3] & np.uint8(127)).astype(np.uint64) << np.uint64(32) for p in parts])
    times = np.concatenate([1 + (p[3] >> np.uint8(7)) for p in parts])
    reference = np.unique(h[np.concatenate([p[1] for p in parts])])
    if not len(reference):
        return _hits(rows, parts, np.zeros(len(h), dtype=bool))
    place = np.searchsorted(reference, h)
    place[place == len(reference)] = 0
    same = reference[place] == h
    count = np.bincount(place[same], weights=times[same], minlength=len(reference))
    return _hits(rows, parts, same & (count[place] > 1))


def repeated_windows(rows: pd.DataFrame, n_buckets: int) -> pd.DataFrame:
    """Of one bucket, the windows whose 96-bit hash occurs more than once, in several batches or (marked) in one."""
    if rows["bucket"].iloc[0] >= n_buckets:
        return rows[["batch", "n", "payload"]].assign(listing=True)
    parts = [unpack(p, n, "<u8", "<u4") for p, n in zip(rows["payload"], rows["n"], strict=True)]
    a, b = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    order = np.lexsort((b, a))
    equal = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    again = np.concatenate([p[1] for p in parts])
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    return _hits(rows, parts, again)


def _hits(rows: pd.DataFrame, parts: list[list[np.ndarray]], hit: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum([len(p[0]) for p in parts])
    out = []
    for batch, part, end in zip(rows["batch"], parts, ends, strict=True):
        at = part[0][hit[end - len(part[0]) : end]]
        if len(at):
            out.append((batch, len(at), at.astype("<u4").tobytes(), False))
    return pd.DataFrame(out, columns=["batch", "n", "payload", "listing"])


def by_document(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one batch, each document's hits as ascending positions within it."""
    marked = rows[~rows["listing"]]
    if marked.empty:
        return pd.DataFrame({"_row": [], "_hash": [], "at": []})
    about = rows[rows["listing"]].iloc[0]
    row, text_hash, counts = np.frombuffer(about["payload"], dtype="<i8", count=3 * about["n"]).reshape(3, -1)
    unsent, head = np.frombuffer(about["payload"], dtype="<u4", offset=24 * about["n"]).reshape(2, -1)
    at = np.concatenate([np.frombuffer(p, dtype="<u4") for p in marked["payload"]])
    at = np.sort(np.concatenate([at, unsent[np.isin(head, at)]])).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    cuts = np.searchsorted(at, begins)
    some = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame({
        "_row": row[some], "_hash": text_hash[some],
        "at": [(at[cuts[d] : cuts[d + 1]] - begins[d]).astype("<u4").tobytes() for d in some],
    })


def candidates(hits: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold a hit run of BLOCK words."""
    change = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(change, np.maximum(hits - (WINDOW - BLOCK), 0), 1)
    np.add.at(change, hits + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: n_words - WINDOW + 1])


def windows(n_buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packed hashes of the candidate windows, positions counted over a document's candidates, and the batch's list."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(in_chunks(batches, "_size", BATCH_BYTES)):
            number, first, second, counts = batch_number(number), [], [], []
            for text, hits in zip(batch["_text"], batch["at"], strict=True):
                words = hashed_text(text.encode("utf-8", "surrogatepass"))
                starts = candidates(np.frombuffer(hits, dtype="<u4").astype(np.int64), len(words))
                first.append(window_hashes(words, WINDOW)[starts])
                second.append(window_hashes(words, WINDOW, 2)[starts].astype("<u4"))
                counts.append(len(starts))
            a, b = np.concatenate(first), np.concatenate(second)
            once, head = firsts(a, b)
            often = np.zeros(len(a), bool)
            often[head[~once]] = True
            send = np.flatnonzero(once)
            a, b = a[send], b[send]
            bucket = ((a >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
            rows = list(deal(bucket, n_buckets, number, often[send], a, b, places=send))
            yield pd.DataFrame([*rows, listing(batch, counts, number, n_buckets, once, head)], columns=["bucket", "batch", "n", "payload"])

    return emit


def _round(packed: DataFrame, rule: Callable[[pd.DataFrame, int], pd.DataFrame], n_buckets: int) -> DataFrame:
    hits = packed.groupBy("bucket").applyInPandas(lambda rows: rule(rows, n_buckets), "batch long, n int, payload binary, listing boolean")
    return hits.groupBy("batch").applyInPandas(by_document, "_row long, _hash long, at binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` (the words kept, one space between) of each row.

    A word goes if a window of 35 consecutive words that covers it also starts
    elsewhere, in the same or another document, word for word; windows are
    judged on the input. Null texts have no words. Rows equal in key and text
    count as documents of their own and repeat each other. Null keys are told
    apart by their texts. Whole texts are read; other columns do not matter.
    """
    kind = docs.schema[key].dataType.simpleString()
    n_buckets = buckets_for(docs, text)
    texts = docs.select(
        F.col(key), text_or_empty(text).alias("_text"), F.octet_length(text_or_empty(text)).cast("long").alias("_size"),
        F.xxhash64(F.col(key), F.lit("row")).alias("_row"), F.xxhash64(text_or_empty(text)).alias("_hash"),
    )
    work = texts.drop(key)
    first = materialise(_round(work.mapInPandas(anchors(n_buckets), PACKED), repeated_anchors, n_buckets), "anchors")
    first = first.dropDuplicates(["_row", "_hash"])
    near = work.join(first, ["_row", "_hash"])
    second = materialise(_round(near.mapInPandas(windows(n_buckets), PACKED), repeated_windows, n_buckets), "repeats")
    again = second.dropDuplicates(["_row", "_hash"]).withColumnRenamed("at", "again")
    marked = texts.join(first, ["_row", "_hash"], "left").join(again, ["_row", "_hash"], "left")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for one, body, hits, chosen in zip(batch[key].array, batch["_text"], batch["at"], batch["again"], strict=True):
                words = body.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if chosen is not None:
                    starts = candidates(np.frombuffer(hits, dtype="<u4").astype(np.int64), n)[np.frombuffer(chosen, dtype="<u4")]
                    change = np.zeros(n + 1, dtype=np.int32)
                    change[starts] += 1
                    change[starts + WINDOW] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:n] == 0)]
                rows.append((one, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=[key, "n_words", "n_removed", "kept"])

    found = marked.select(carried(key), "_text", "at", "again").mapInPandas(keep, f"`{key}` string, n_words long, n_removed long, kept string")
    return found.withColumn(key, F.col(key).cast(kind))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the words that repeated windows of 35 cover."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
