"""Packing along a space-filling curve.

A document's tokens make a hashed count vector, which a fixed random matrix
projects to a few dimensions; the Hilbert index of that point is its key.
Documents are range-sorted by key, so neighbours on the curve are alike, and
their tokens are cut into sequences one after the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import carried, materialise, table

SEQUENCE = 2048
#: Id that ends every document.
END_ID = 1
#: Counts are hashed into FEATURES numbers, projected to DIMS, each cut into 2^DEPTH steps.
FEATURES, DIMS, DEPTH = 1024, 3, 10
#: Words whose ids a worker remembers, and their bytes; a block's own words may exceed them.
CACHE_WORDS, CACHE_BYTES = 400_000, 64 << 20
#: Characters of texts that are cut into words at once, and words that the tokenizer's model gets at once.
BLOCK_CHARS, BLOCK_WORDS = 4_000_000, 20_000

#: The UTF-8 of plain texts: tab, line ends, U+0020 to 7E and U+00C0 to 23F. But for U+0130 and "<|" they are normal (NFC),
#: lower-case by character, and all beyond ASCII but the two SIGNS are letters.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
SIGNS = ("×".encode(), "÷".encode())
#: Ends a text in a block of plain texts, in which it can't stand.
END = "\0"
SPACE, LETTER, OTHER, DIGIT, LAST = range(5)
#: The kind of a byte of lower-case plain texts. With CONTRACTIONS the tokenizer's own split rule.
KINDS = np.array(
    [LAST if c == END else SPACE if c in "\t\n\r " else DIGIT if c in "0123456789" else LETTER if c.isalpha() or ord(c) > 127 else OTHER for c in map(chr, range(256))],
    dtype=np.uint8,
)
CONTRACTIONS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


def is_plain(text: str) -> bool:
    raw = text.encode()
    return not raw.translate(None, PLAIN) and b"<|" not in raw and b"\xc4\xb0" not in raw


def cut_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-case plain texts without white space, and where each word begins in them, their length last.

    A word is a run of letters, a digit, a run of other signs, a contraction after its apostrophe, or END. The last
    byte must be END or white space.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    kind = KINDS[data]
    for sign in SIGNS:
        if sign in raw:
            at = np.flatnonzero((data[:-1] == sign[0]) & (data[1:] == sign[1]))
            kind[at] = kind[at + 1] = OTHER
    first = np.ones(len(data), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind >= DIGIT
    marks = np.flatnonzero((data == ord("'")) & first)
    for one, two in CONTRACTIONS.items():
        at = marks[data[marks + 1] == ord(one)]
        if two:
            at = at[data[at + 2] == ord(two)]
        first[at + 1] = False
        first[at + 2 + len(two)] = True
    kept = kind != SPACE
    letters = data[kept]
    return letters, np.append(np.flatnonzero(first[kept]), len(letters)).astype(np.int64)


def gathered(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, by their numbers in a table of ids and of where each word's end, and where each word ends in them."""
    sizes = np.diff(ends, prepend=0)[codes]
    to = np.cumsum(sizes)
    return ids[np.repeat(ends[codes] - to, sizes) + np.arange(sizes.sum())], to


class Words:
    """A table of words and their ids. Texts are cut by the block, and the tokenizer's model sees the words that are new."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # The last id of a word, and no other, has the suffix: the split rule leaves no such text within a word.
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.closing[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(self.model.model.end_of_word_suffix)]] = True
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)} | {ord(" "): ord(" ")}
        self.chars = np.array([moved.get(b, b) for b in range(256)], dtype="<u2")
        self.end = np.array([END_ID], dtype=self.wide)
        self.words, self.ids, self.ends = pa.array([END], pa.large_string()), self.end, np.array([1])

    def found(self, words: pa.LargeStringArray) -> np.ndarray:
        """The places of unlike words in the table. New ones are added; a full table first loses what is not among them."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count and (len(self.words) + at.null_count > CACHE_WORDS or self.words.nbytes > CACHE_BYTES):
            kept = np.append(0, np.setdiff1d(at.drop_null().to_numpy(), [0]))
            self.words = self.words.take(pa.array(kept))
            self.ids, self.ends = gathered(self.ids, self.ends, kept)
            at = pc.index_in(words, value_set=self.words)
        places = at.fill_null(-1).to_numpy().astype(np.int64)
        new = words.filter(at.is_null())
        if len(new):
            places[places < 0] = len(self.words) + np.arange(len(new))
            ids = np.concatenate([self.by_model(new.slice(i, BLOCK_WORDS)) for i in range(0, len(new), BLOCK_WORDS)])
            ends = len(self.ids) + 1 + np.flatnonzero(self.closing[ids])
            if len(ends) != len(new):
                raise ValueError("the tokenizer does not end each word with its suffix")
            self.words, self.ids, self.ends = pa.concat_arrays([self.words, new]), np.append(self.ids, ids), np.append(self.ends, ends)
        return places

    def by_model(self, words: pa.LargeStringArray) -> np.ndarray:
        """The ids of words, one word after the other."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_buffer()
        text = self.chars[np.frombuffer(joined, dtype=np.uint8)].tobytes().decode("utf-16-le")
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.wide)

    def block(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts, each with END after it, and where each text ends in them."""
        letters, begins = cut_words(text.lower().encode())
        cut = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(letters)).dictionary_encode()
        places = self.found(cut.dictionary)[cut.indices.to_numpy()]
        ids, to = gathered(self.ids, self.ends, places)
        return ids, to[places == 0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end id last; the same as the tokenizer's own for any text."""
        out: list[np.ndarray] = [self.end] * len(texts)
        waiting: list[int] = []
        size = 0

        def flush() -> None:
            if waiting:
                ids, ends = self.block("".join(texts[i] + END for i in waiting))
                for i, one in zip(waiting, np.split(ids, ends[:-1]), strict=True):
                    out[i] = one
                waiting.clear()

        for i, text in enumerate(texts):
            if not is_plain(text):
                out[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], dtype=self.wide)
            elif len(text) > BLOCK_CHARS:
                out[i] = np.concatenate([self.block(part)[0] for part in _slices(text + END)])
            else:
                if size + len(text) > BLOCK_CHARS:
                    flush()
                    size = 0
                waiting.append(i)
                size += len(text)
        flush()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one text as bytes."""
        return self.encode_all([text])[0].tobytes()


def _slices(text: str) -> Iterator[str]:
    """A long text in slices of about BLOCK_CHARS; all but the last end with a space."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + BLOCK_CHARS - 1) + 1 or len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(9).standard_normal((FEATURES, DIMS))


def hilbert_indices(points: np.ndarray, depth: int) -> np.ndarray:
    """The places of points (one a row) of the 2^depth grid on the Hilbert curve through it."""
    x = [v.astype(np.int64) for v in points.T]
    n, steps = len(x), [1 << d for d in range(depth - 1, 0, -1)]
    for q in steps:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, key = np.zeros_like(x[0]), np.zeros_like(x[0])
    for q in steps:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
    for bit in range(depth - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ turn) >> bit & 1)
    return key


def hilbert_index(point: list[int], depth: int) -> int:
    """The place of one point."""
    return int(hilbert_indices(np.array([point]), depth)[0])


def curve_keys(docs: list[np.ndarray]) -> list[int]:
    """The Hilbert keys of documents' ids. A key depends on its document alone: sums are by row, not by BLAS."""
    out: list[int] = []
    for at in range(0, len(docs), 256):
        some = docs[at : at + 256]
        hashed = ((d.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22) for d in some)
        shares = np.array([np.bincount(h, minlength=FEATURES) for h in hashed]) / np.array([[len(d)] for d in some])
        roots = np.sqrt(shares)
        points = np.stack([(roots * axis).sum(axis=1) for axis in _projection().T], axis=1) / np.sqrt(FEATURES) * 16
        cells = np.clip((1 / (1 + np.exp(-points)) * (1 << DEPTH)).astype(int), 0, (1 << DEPTH) - 1)
        out += hilbert_indices(cells, DEPTH).tolist()
    return out


def curve_key(ids: np.ndarray) -> int:
    """The Hilbert key of one document's ids."""
    return curve_keys([ids])[0]


def tokenised(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """``key``, the little-endian ids as ``ids``, bytes an id as ``wide`` and the curve key as ``curve``."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_of(path)
        for batch in batches:
            ids = words.encode_all([t or "" for t in batch["_text"]])
            yield pd.DataFrame({key: batch[key], "ids": [i.tobytes() for i in ids], "wide": words.wide.itemsize, "curve": curve_keys(ids)})

    found = docs.select(carried(key), F.col(text).alias("_text")).mapInPandas(each, f"`{key}` string, ids binary, wide int, curve long")
    return found.withColumn(key, F.col(key).cast(kind))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces that all documents are cut into, with their ids.

    Columns: ``key``, ``start`` (the document's ids before the piece),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence.

    Each range of the curve fills sequences of 2048 one after the other; the
    tokens left at its end fill sequences of descending powers of two, which
    need no padding. Nothing is padded then. A null or empty text is the end id
    alone; equal texts have one key and are told apart by a hash of ``key``, so
    a large group of copies is spread over ranges; rows with equal or null keys
    are packed as documents of their own. ``tokenizer`` is the path of the file.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    stored = materialise(tokenised(docs, tokenizer, key, text).withColumn("tie", F.xxhash64(F.col(key))), "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stored.repartitionByRange(parts, "curve", "tie").sortWithinPartitions("curve", "tie", key)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, offset, open_rows = 0, 0, []
        for batch in batches:
            rows = []
            for one, raw, wide, base in zip(batch[key].array, batch["ids"], batch["wide"], batch["_part"], strict=True):
                ids = np.frombuffer(raw, dtype=f"<u{wide}").astype("<u4")
                start = 0
                while start < len(ids):
                    take = min(len(ids) - start, SEQUENCE - offset)
                    open_rows.append((one, start, take, ids[start : start + take].tobytes(), len(ids), (int(base) << 33) + sequence, offset))
                    start, offset = start + take, offset + take
                    if offset == SEQUENCE:
                        rows += open_rows
                        sequence, offset, open_rows = sequence + 1, 0, []
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(_powers(open_rows), columns=columns)

    columns = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    pieces = ranged.select(carried(key), "ids", "wide", F.spark_partition_id().alias("_part")).mapInPandas(
        fill, f"`{key}` string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumn(key, F.col(key).cast(kind))


def _powers(rows: list[tuple]) -> list[tuple]:
    """The pieces of an unfinished sequence, cut anew into sequences of descending powers of two."""
    left, out = sum(r[2] for r in rows), []
    size, offset, shift = 0, 0, -1
    for one, start, length, ids, total, sequence, _ in rows:
        done = 0
        while done < length:
            if offset == size:
                left -= size
                size, offset, shift = 1 << (left.bit_length() - 1), 0, shift + 1
            take = min(length - done, size - offset)
            out.append((one, start + done, take, ids[4 * done : 4 * (done + take)], total, sequence + shift, offset))
            done, offset = done + take, offset + take
    return out


def piece_digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32`` in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return piece_digests(pack(table(spark, sf_dir, "documents"), default_tokenizer())).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def token_crc32(ids: list[int]) -> int:
    """CRC-32 of ids as the contract has it, for tests."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
