"""Line dedup by an exact set-similarity join.

A line is the set of its words. Two lines match if the Jaccard similarity of
their sets is at least 0.8; a line that matches an earlier one, by document key
and then position, is removed. Matches are judged on the input.

Words are ordered by rarity over all lines. Lines that match share a word of
their prefixes, the first |x| - ceil(0.8 |x|) + 1 words in that order, so only
prefixes are posted. A posting also has its place, the line's size and a 128-bit
bitmap of the set: the positional, length and bitmap filters drop pairs that
cannot reach the overlap. (The words that only one of two sets has are no fewer
than the bits in which their bitmaps of odd counts differ.) What is left is verified on the whole sets. Equal
sets are found apart, by a 128-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import buckets_for, fresh, materialise, table, text_or_empty
from ragspark.llm.substrings import PACKED, batch_number, deal, listing, unpack
from ragspark.llm.words import in_chunks, mix, word_hashes, word_spans

THRESHOLD = 0.8
#: Hashed word counts that the order by rarity comes from, and how they travel.
RARITY, RARITY_CHUNK = 1 << 18, 1 << 12
BATCH_BYTES = 2 << 20
#: Lines compared in one cell of the verification.
CELL = 512
#: Words with several cells are broadcast if there are at most so many (12 bytes each), else joined.
MOST_BROADCAST = 1 << 20


def needed(size: np.ndarray | int, threshold: float) -> np.ndarray:
    """ceil(threshold * size), safe from rounding."""
    return np.ceil(np.asarray(size) * threshold - 1e-9).astype(np.int64)


def overlap(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Common words that two sets of so many words in all need to match."""
    return np.ceil(np.asarray(sizes) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)


def segments(text: bytes, limit: int = BATCH_BYTES) -> Iterator[bytes]:
    """The text in parts that end at line ends; a longer line is a part of its own."""
    at = 0
    while len(text) - at > limit:
        end = text.rfind(b"\n", at, at + limit)
        end = end if end >= at else text.find(b"\n", at + limit)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def buffers(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Parts of the texts, by the texts' places, in groups of about ``limit`` bytes; one line may be larger."""
    owners, parts, total = [], [], 0
    for i, text in enumerate(texts):
        for part in segments(text.encode("utf-8", "surrogatepass"), limit):
            if total and total + len(part) > limit:
                yield owners, parts
                owners, parts, total = [], [], 0
            owners.append(i)
            parts.append(part)
            total += len(part) + 1
    if parts:
        yield owners, parts


class Sets:
    """The word sets of the lines that have words, of one part of a text.

    line: line number of each; begins: where each set begins in ``words`` (hashes
    in the order by rarity); sizes.
    """

    def __init__(self, part: bytes, rarity: np.ndarray | None):
        data = np.frombuffer(part, dtype=np.uint8)
        starts, ends = word_spans(data)
        breaks = np.flatnonzero(data == 10)
        self.n_lines = len(breaks) + 1
        hashes = word_hashes(data, starts, ends, lower=True)
        if rarity is None:
            self.words = hashes
            return
        of = np.searchsorted(breaks, starts)
        rank = rarity[hashes >> np.uint64(46)]
        if self.n_lines < 1 << 22:
            # One sort: by line, rank and the hash's head, which tells a part's words apart but for rare cases.
            key = of.astype(np.uint64) << np.uint64(42) | rank.astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32)
            order = np.argsort(key)
            key, sorted_ = key[order], hashes[order]
            clear = not ((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])).any()
        if self.n_lines >= 1 << 22 or not clear:
            order = np.lexsort((hashes, rank, of))
        hashes, of = hashes[order], of[order]
        first = np.ones(len(of), dtype=bool)
        first[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
        self.words, of = hashes[first], of[first]
        self.begins = np.flatnonzero(np.diff(of, prepend=-1))
        self.line = of[self.begins]
        self.sizes = np.diff(np.append(self.begins, len(of)))

    def of(self, i: int) -> np.ndarray:
        return self.words[self.begins[i] : self.begins[i] + self.sizes[i]]


def rarity_of(texts: DataFrame) -> np.ndarray:
    """Rank class by hashed word, from counts over all lines; the table's size is fixed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(RARITY, dtype=np.int64)
        for batch in batches:
            for _, parts in buffers(batch["_text"].tolist()):
                total += np.bincount((Sets(b"\n".join(parts), None).words >> np.uint64(46)).astype(np.int64), minlength=RARITY)
        parts = total.reshape(-1, RARITY_CHUNK)
        yield pd.DataFrame({"chunk": np.arange(len(parts)), "counts": [p.tobytes() for p in parts]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, dtype=np.int64) for c in rows["counts"]], axis=0)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "counts": [total.tobytes()]})

    schema = "chunk long, counts binary"
    rows = texts.select("_text").mapInPandas(count, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    total = np.zeros(RARITY, dtype=np.int64)
    for r in rows:
        total[r["chunk"] * RARITY_CHUNK : (r["chunk"] + 1) * RARITY_CHUNK] = np.frombuffer(r["counts"], dtype=np.int64)
    return np.floor(8 * np.log2(1 + total)).astype(np.uint16)


def _set_hashes(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set, two order-free hashes and the bitmap: of each of 128 bits, whether an odd number of words fall on it."""
    a = np.add.reduceat(mix(sets.words ^ np.uint64(0x5851F42D4C957F2D)), sets.begins)
    b = np.add.reduceat(mix(sets.words ^ np.uint64(0x14057B7EF767814F)), sets.begins)
    one, place = np.uint64(1) << (sets.words & np.uint64(63)), sets.words & np.uint64(64)
    low, high = (np.bitwise_xor.reduceat(np.where((place > 0) == half, one, np.uint64(0)), sets.begins) for half in (False, True))
    return a, b, low, high


def _prefixes(sets: Sets, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each posting: its set, place and word."""
    # A set of n words matches an unequal one only if n of n + 1 words are enough.
    able = sets.sizes >= threshold * (sets.sizes + 1) - 1e-9
    lengths = np.where(able, sets.sizes - needed(sets.sizes, threshold) + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return owner, place, sets.words[sets.begins[owner] + place]


#: What a packed posting and a packed line hold after the line's place in its batch and a mark.
POSTING = ("<u4", "u1", "<u8", "<u8", "<u8", "<u4", "<u2")
LINE = ("<u8", "<u8", "<i8", "<i8", "<u4")


def _post(rarity: np.ndarray, n_buckets: int, threshold: float):
    """Packed prefix postings, packed lines and each batch's list of documents; lines without words are not counted."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(in_chunks(batches, "_size", BATCH_BYTES)):
            # Lines in the order of removal, so that the copy of a set that is posted is the batch's earliest.
            batch = batch.sort_values(["_order", "_hash"], kind="stable", ignore_index=True)
            number, first = batch_number(number), 0
            lines, postings, n_lines = [], [], np.zeros(len(batch), dtype=np.int64)
            orders, hashes = batch["_order"].to_numpy(np.int64), batch["_hash"].to_numpy(np.int64)
            for owners, parts in buffers(batch["_text"].tolist()):
                sets = Sets(b"\n".join(parts), rarity)
                if not len(sets.begins):
                    continue
                doc = np.repeat(owners, [p.count(b"\n") + 1 for p in parts])[sets.line]
                own = np.bincount(doc, minlength=len(batch))
                at = np.arange(len(doc)) - np.repeat((np.cumsum(own) - own)[own > 0], own[own > 0]) + n_lines[doc]
                a, b, low, high = _set_hashes(sets)
                owner, place, word = _prefixes(sets, threshold)
                lines.append((a, b, orders[doc], hashes[doc], at))
                postings.append((word, low[owner], high[owner], a[owner], sets.sizes[owner], place, owner + first))
                n_lines += own
                first += len(a)
            rows = [listing(batch, n_lines.tolist(), number, 2 * n_buckets)]
            if lines:
                a, b, order, text_hash, at = (np.concatenate(x) for x in zip(*lines, strict=True))
                # Only the batch's first line of a set is sent and posted; its later copies are known as such here.
                _, heads, group = np.unique(a, return_index=True, return_inverse=True)
                head = heads[group]
                copy = (head != np.arange(len(a))) & (b == b[head])
                later = np.flatnonzero(copy & ((order != order[head]) | (text_hash != text_hash[head]) | (at != at[head])))
                if len(later):
                    rows.append((4 * n_buckets + number % n_buckets, number, len(later), later.astype("<u4").tobytes()))
                send = np.flatnonzero(~copy)
                a, b, order, text_hash, at = (x[send] for x in (a, b, order.astype("<i8"), text_hash.astype("<i8"), at.astype("<u4")))
                packed = deal((a % np.uint64(n_buckets)).astype(np.int64), n_buckets, number, np.ones(len(a), bool), a, b, order, text_hash, at, places=send)
                rows += [(n_buckets + k, *rest) for k, *rest in packed]
                post = np.flatnonzero(~copy[np.concatenate([x[6] for x in postings])])
                word, low, high, own, size, place, owner = (np.concatenate(x)[post] for x in zip(*postings, strict=True))
                rows += deal(
                    (word % np.uint64(n_buckets)).astype(np.int64), n_buckets, number, np.ones(len(post), bool),
                    (word >> np.uint64(24)).astype("<u4"), (word >> np.uint64(56)).astype("u1"), low, high, own,
                    size.astype("<u4"), np.minimum(place, 0xFFFF).astype("<u2"), places=owner,
                )
            yield pd.DataFrame(rows, columns=["bucket", "batch", "n", "payload"])

    return emit


def later_copies(a: np.ndarray, b: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Which lines have an earlier line with the same set. Lines with the same order are the same line."""
    by = np.lexsort((*order[::-1], b, a))
    same = (a[by][1:] == a[by][:-1]) & (b[by][1:] == b[by][:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    head = by[np.flatnonzero(np.concatenate([[True], ~same]))][group]
    later = np.zeros(len(a), bool)
    later[by] = np.any([o[by] != o[head] for o in order], axis=0)
    return later


def active_postings(
    word: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, size: np.ndarray, place: np.ndarray, threshold: float
) -> np.ndarray:
    """Which postings share their word with another set's that the filters leave.

    Postings are sorted by word and size and compared with the d-th next, for
    growing d, as long as words agree and sizes can match: no pair is stored.
    """
    by = np.lexsort((size, word))
    word, low, high, own, size, place = word[by], low[by], high[by], own[by], size[by].astype(np.int64), place[by].astype(np.int64)
    rest, active = size - place, np.zeros(len(word), bool)
    left, d = np.arange(len(word) - 1), 0
    while len(left):
        d += 1
        left = left[left + d < len(word)]
        right = left + d
        near = (word[left] == word[right]) & (size[left] >= needed(size[right], threshold))
        left = left[near]
        unsure = left[~(active[left] & active[left + d])]
        right = unsure + d
        total = size[unsure] + size[right]
        least = overlap(total, threshold)
        hit = (own[unsure] != own[right]) & (np.minimum(rest[unsure], rest[right]) >= least)
        odd = np.bitwise_count(low[unsure] ^ low[right]).astype(np.int64) + np.bitwise_count(high[unsure] ^ high[right])
        hit &= odd <= total - 2 * least
        active[unsure[hit]] = active[right[hit]] = True
    out = np.zeros(len(word), bool)
    out[by] = active
    return out


def _one_bucket(rows: pd.DataFrame, n_buckets: int, threshold: float) -> pd.DataFrame:
    """By batch the lines with an earlier copy (kind 1), or the active postings: lines and the heads of words (kind 0)."""
    bucket = rows["bucket"].iloc[0]
    if bucket >= 2 * n_buckets:
        return rows[["batch", "n", "payload"]].assign(kind=2 if bucket < 4 * n_buckets else 1)
    kinds = POSTING if bucket < n_buckets else LINE
    parts = [unpack(p, n, *kinds) for p, n in zip(rows["payload"], rows["n"], strict=True)]
    columns = [np.concatenate([p[i] for p in parts]) for i in range(2, 2 + len(kinds))]
    if bucket < n_buckets:
        word = columns[0].astype(np.uint64) | columns[1].astype(np.uint64) << np.uint64(32)
        hit = active_postings(word, *columns[2:], threshold)
    else:
        hit = later_copies(*columns)
    ends, out = np.cumsum([len(p[0]) for p in parts]), []
    for batch, part, end in zip(rows["batch"], parts, ends, strict=True):
        own = slice(end - len(part[0]), end)
        at = part[0][hit[own]].astype("<u4")
        if len(at):
            more = word[own][hit[own]].tobytes() if bucket < n_buckets else b""
            out.append((batch, len(at), at.tobytes() + more, 0 if bucket < n_buckets else 1))
    return pd.DataFrame(out, columns=["batch", "n", "payload", "kind"])


def merged(marks: DataFrame) -> DataFrame:
    """One mark of each document: of its rows, in one batch or several, only some may have sent or posted a line."""
    found = marks.groupBy("_row", "_hash").agg(
        F.collect_set("equal").alias("_equal"), F.collect_set(F.when(F.length("active") > 0, F.struct("active", "words"))).alias("_posted"))

    def strung(parts: str, one) -> Column:
        return F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, one(x)))

    return found.select(
        "_row", "_hash", strung("_equal", lambda x: x).alias("equal"),
        strung("_posted", lambda x: x["active"]).alias("active"), strung("_posted", lambda x: x["words"]).alias("words"))


MARKS = "_row long, _hash long, equal binary, active binary, words binary"


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one batch, each document's copies of earlier lines and its active postings, by place among its lines with words."""
    about = rows[rows["kind"] == 2].iloc[0]
    row, text_hash, counts = np.frombuffer(about["payload"], dtype="<i8").reshape(3, -1)
    begins = np.concatenate([[0], np.cumsum(counts)])
    parts = {}
    for kind in (0, 1):
        own = rows[rows["kind"] == kind]
        at = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(own["payload"], own["n"], strict=True)] or [np.empty(0, "<u4")])
        by = np.argsort(at, kind="stable")
        parts[kind] = at[by].astype(np.int64), np.searchsorted(at[by], begins)
        if not kind:
            words = np.concatenate([np.frombuffer(p, "<u8", n, 4 * n) for p, n in zip(own["payload"], own["n"], strict=True)] or [np.empty(0, "<u8")])[by]
    (active, at0), (equal, at1) = parts[0], parts[1]
    some = np.flatnonzero((np.diff(at0) > 0) | (np.diff(at1) > 0))
    return pd.DataFrame({
        "_row": row[some], "_hash": text_hash[some],
        "equal": [(equal[at1[d] : at1[d + 1]] - begins[d]).astype("<u4").tobytes() for d in some],
        "active": [(active[at0[d] : at0[d + 1]] - begins[d]).astype("<u4").tobytes() for d in some],
        "words": [words[at0[d] : at0[d + 1]].tobytes() for d in some],
    })


def _send(rarity: np.ndarray):
    """For each active posting its word's head and the whole set of its line.

    A line with an earlier copy is not sent: it goes anyhow, and whatever it
    matches matches its earliest copy, which is earlier still.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                at, word = np.frombuffer(r.active, dtype="<u4"), np.frombuffer(r.words, dtype="<u8")
                new = ~np.isin(at, np.frombuffer(r.equal, dtype="<u4"))
                at, word = at[new].tolist(), word[new].astype(np.int64).tolist()
                if not at:
                    continue
                lines = [line for line in r.body.encode("utf-8", "surrogatepass").split(b"\n") if line.split()]
                wanted = sorted(set(at))
                found = Sets(b"\n".join(lines[i] for i in wanted), rarity)
                sets = {i: np.sort(found.of(n)).tobytes() for n, i in enumerate(wanted)}
                rows += [(w, r.place, r.text, r.row, i, sets[i]) for i, w in sorted(set(zip(at, word, strict=True)))]
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=SENT_COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=SENT_COLUMNS)

    return emit


SENT = "word long, `_order` long, `_hash` long, `_row` long, line int, words binary"
SENT_COLUMNS = ["word", "_order", "_hash", "_row", "line", "words"]


def _verify(threshold: float):
    """Of the cells in a bucket, the lines to ``ask`` about that match an earlier line of their cell that may ``match``."""
    ratio = threshold / (1 + threshold)

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["word", "_cell", "_order", "_hash", "line", "match"])
        cells = rows[["word", "_cell"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)])).tolist()
        places = list(zip(rows["_row"].tolist(), rows["_order"].tolist(), rows["_hash"].tolist(), rows["line"].tolist(), strict=True))
        words, asks, matches, found = rows["words"].tolist(), rows["ask"].tolist(), rows["match"].tolist(), set()
        for a, b in zip(starts, [*starts[1:], len(places)], strict=True):
            earlier: list[frozenset[int]] = []
            last = None
            for place, one, ask, match in zip(places[a:b], words[a:b], asks[a:b], matches[a:b], strict=True):
                own = frozenset(np.frombuffer(one, dtype=np.uint64).tolist())
                n = len(own)
                if ask and place != last and place not in found:
                    for other in earlier:
                        m = len(other)
                        if m >= threshold * n - 1e-9 and n >= threshold * m - 1e-9 and len(own & other) >= ratio * (n + m) - 1e-9:
                            found.add(place)
                            break
                if match and place != last:
                    earlier.append(own)
                    last = place
        return pd.DataFrame([(r, h, line) for r, _, h, line in found], columns=["_row", "_hash", "line"])

    return check


def similar_lines(sent: DataFrame, n_buckets: int, threshold: float) -> DataFrame:
    """``_row``, ``_hash`` and ``line`` of the sent lines that match an earlier line which shares their word.

    The lines of a word are dealt into cells of about CELL, first compared
    within. In a family of near copies that settles all but the first of each
    cell; only the unsettled lines of words with several cells then meet the
    other cells. Every pair is looked at unless its later line is settled.
    """
    sizes = sent.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("_cells"))
    large = materialise(sizes.filter("_cells > 1"), "large-words")
    few = large.count()
    large = F.broadcast(large) if few <= MOST_BROADCAST else large
    own = F.pmod(F.xxhash64("_row", F.lit(17)), F.coalesce("_cells", F.lit(1))).cast("int")
    bucket = F.pmod(F.xxhash64("word", "_cell"), F.lit(n_buckets)).alias("bucket")
    schema = "_row long, _hash long, line int"
    names = ["word", "_order", "_hash", "_row", "line", "words"]

    def compared(cells: DataFrame) -> DataFrame:
        return cells.select("*", bucket).groupBy("bucket").applyInPandas(_verify(threshold), schema)

    def dealt(how: str, cell: Column, ask: bool, match: bool) -> DataFrame:
        cells = sent.join(large, "word", how) if few else sent.withColumn("_cells", F.lit(1))
        return cells.select(*names, cell.alias("_cell"), F.lit(ask).alias("ask"), F.lit(match).alias("match"))

    settled = compared(dealt("left", own, True, True))
    if not few:
        return settled
    settled = materialise(settled, "settled-lines")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("_cells") - 1), lambda c: c != own))
    asked = dealt("inner", others, True, False).join(settled, ["_row", "_hash", "line"], "left_anti").select(*names, "_cell", "ask", "match")
    return settled.union(compared(dealt("inner", own, False, True).union(asked)))


def remove_similar_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and ``kept``, ``n_lines``, ``n_removed``, ``removed`` (line numbers from 0).

    Lines end at a line feed; words are runs of anything but ASCII white space,
    A-Z lower-cased. Lines are in the order of the key, the text's hash and the
    place; ``key`` must be a whole number, a null one comes first. Lines without
    words stay. A null text has no lines and stays null. Rows equal in key and
    text are one document, given as often; their lines are not later than each
    other's. Texts are read whole. Extra columns are kept; one with the name of
    an added column gives way.
    """
    added = ("kept", "n_lines", "n_removed", "removed")
    docs = docs.drop(*added)
    n_buckets = buckets_for(docs, text)
    body = text_or_empty(text)
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(
        body.alias("_text"), F.octet_length(body).cast("long").alias("_size"), order.alias("_order"),
        F.xxhash64(order, F.lit("row")).alias("_row"), F.xxhash64(body).alias("_hash"),
    )
    rarity = rarity_of(texts)
    packed = texts.mapInPandas(_post(rarity, n_buckets, threshold), PACKED)
    hits = packed.groupBy("bucket").applyInPandas(lambda rows: _one_bucket(rows, n_buckets, threshold), "batch long, n int, payload binary, kind int")
    marks = merged(materialise(hits.groupBy("batch").applyInPandas(_gather, MARKS), "line-marks"))
    equal = marks.filter(F.length("equal") > 0).select("_row", "_hash", "equal")
    sent = texts.join(marks.filter(F.length("active") > 0), ["_row", "_hash"]).select(
        F.col("_text").alias("body"), F.col("_order").alias("place"), F.col("_hash").alias("text"), F.col("_row").alias("row"), "equal", "active", "words")
    sent = materialise(sent.mapInPandas(_send(rarity), SENT), "line-sets")
    similar = similar_lines(sent, n_buckets, threshold)
    similar = materialise(similar.groupBy("_row", "_hash").agg(F.collect_set("line").alias("similar")), "similar-lines")
    row, own_hash, at_, more_ = (fresh(n, docs.columns) for n in ("_row", "_hash", "_at", "_similar"))
    own = docs.withColumns({row: F.xxhash64(order, F.lit("row")), own_hash: F.xxhash64(body)})
    marked = own.join(equal.toDF(row, own_hash, at_), [row, own_hash], "left").join(similar.toDF(row, own_hash, more_), [row, own_hash], "left")
    names = docs.columns
    place = names.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, ats, mores = batch.columns
            found = [_kept(*x) for x in zip(columns[place].to_pylist(), ats.to_pylist(), mores.to_pylist(), strict=True)]
            new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=[*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return marked.select(*docs.columns, at_, more_).mapInArrow(keep, f"{schema}, kept string, n_lines long, n_removed long, removed array<int>")


def _kept(text: str | None, equal: bytes | None, similar: list[int] | None) -> tuple[str | None, int, int, list[int]]:
    """A text without the removed lines, its lines, how many went and which; the removed are counted over lines with words."""
    lines = [] if text is None else text.split("\n")
    gone = {*(np.frombuffer(equal, dtype="<u4").tolist() if equal else ()), *(similar or ())}
    if not gone:
        return text, len(lines), 0, []
    worded = [i for i, line in enumerate(lines) if line.encode("utf-8", "surrogatepass").split()]
    drop = {worded[i] for i in gone}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop), sorted(drop)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without lines that match an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_similar_lines(docs)
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("kept", 256).alias("kept_sha256"))
