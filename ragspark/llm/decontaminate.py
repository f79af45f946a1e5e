"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits leaves one of any k + 1
pieces of it untouched. All pieces of all items are sought at once by an
automaton; around each hit, Myers' bit-parallel algorithm finds the item's
edit distance to the nearest substring.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import carried, table

#: Edits allowed, as a share of an item's characters, rounded down.
ERROR_RATE = 0.08
#: Shorter items, in normalised characters, are matched without edits and at word bounds only.
MIN_CHARS = 25
#: Items that a task holds at once; more are sought in further passes.
ITEMS_AT_ONCE = 5000


def normalised(text: str) -> str:
    """Lower case, one space for any white space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces, nearly equal, with their offsets."""
    at = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def pattern_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_match(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of ``text``, and the first end of one (Myers)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(d0 | plus)), plus & d0
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
        if score < best:
            best, end = score, j
    return best, end


def bounded(text: str, start: int, end: int) -> bool:
    """Whether no word of letters and digits goes on over either end of the span."""
    return not (
        (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())
    )


class Matcher:
    """Finds approximate occurrences of items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.min_chars = min_chars
        self.items = [(key, text, int(len(text) * rate) if len(text) >= min_chars else 0, pattern_bits(text)) for key, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item key, distance, end, the item's length) of the best occurrence of each item found; items may share a key."""
        if not self.items:
            return []
        windows: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                windows.setdefault(i, set()).add(end + 1 - size - offset)
        found = []
        for i, starts in windows.items():
            key, item, budget, bits = self.items[i]
            m, best, seen = len(item), (budget + 1, 0), -1
            if m < self.min_chars:
                starts = {s for s in starts if bounded(text, s, s + m)}
            exact = min((s for s in starts if s >= 0 and text.startswith(item, s)), default=None)
            if exact is not None:
                best, starts = (0, exact + m), ()
            for s in sorted(starts):
                low, high = max(0, s - budget), s + m + budget
                if high <= seen:
                    continue
                # A hit's window reaches on to the next ones where they overlap by more than half.
                seen = high + m // 2
                score, at = best_match(bits, m, text[low : max(0, seen)])
                best = min(best, (score, low + at))
            if best[0] <= budget:
                found.append((key, *best, m))
        return found


@lru_cache(maxsize=2)
def _matcher(token: str, items: tuple[tuple[int, str], ...], rate: float, min_chars: int) -> Matcher:
    return Matcher(list(items), rate, min_chars)


def find_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """One row per (row of ``docs``, item) that matches: ``key``, ``item_key``, ``distance``, ``end``, ``n_chars``.

    Texts and items are normalised (lower case, white space collapsed);
    ``distance`` is the smallest number of edits to a substring of the text,
    ``end`` where the first such ends in the normalised text, ``n_chars`` the
    item's length. Up to floor(rate * length) edits match. Items shorter than
    ``min_chars`` match without edits, at word bounds. Items with a null key or
    text, or without characters, take no part; equal items give a row each. Null and empty texts match nothing. Rows of ``docs`` are handled one by
    one, whole, and no row is shuffled. Items go to the tasks in blocks of at
    most ``at_once``, in as many passes as that takes.
    """
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, key), (items, item_key)))
    texts = docs.select(carried(key), F.col(text).alias("_text"))
    schema = f"`{key}` string, `{item_key}` {item_kind}, distance long, end long, n_chars long"
    out = None
    for held in item_blocks(items, item_key, item_text, at_once):
        one = texts.mapInPandas(_seeker(held, rate, key, item_key, min_chars), schema)
        out = one if out is None else out.union(one)
    return out.withColumn(key, F.col(key).cast(kind))


def item_blocks(items: DataFrame, item_key: str, item_text: str, at_once: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items' keys and normalised texts, in blocks of about half of ``at_once``; one block at least."""
    usable = items.select(F.col(item_key).alias("_i"), F.col(item_text).alias("_t")).dropna()
    n = max(1, -(-usable.count() // max(1, at_once // 2)))
    for block in range(n):
        rows = usable.filter(F.pmod(F.xxhash64("_i", "_t"), F.lit(n)) == block) if n > 1 else usable
        yield tuple(sorted((r["_i"], t) for r in rows.collect() if (t := normalised(r["_t"]))))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """The rows of ``docs`` that match no item, by the rules of ``find_items``; no row is shuffled."""
    for held in item_blocks(items, item_key, item_text, at_once):
        docs = docs.mapInArrow(_cleaner(held, rate, docs.columns.index(text), min_chars), docs.schema)
    return docs


def _cleaner(held: tuple[tuple[int, str], ...], rate: float, text: int, min_chars: int):
    token = uuid.uuid4().hex

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(token, held, rate, min_chars)
        for batch in batches:
            yield batch.filter(pa.array([not (t and matcher.find(normalised(t))) for t in batch.column(text).to_pylist()], pa.bool_()))

    return clean


def _seeker(held: tuple[tuple[int, str], ...], rate: float, key: str, item_key: str, min_chars: int):
    token = uuid.uuid4().hex

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(token, held, rate, min_chars)
        for batch in batches:
            rows = [(i, *hit) for i, t in enumerate(batch["_text"]) if t for hit in matcher.find(normalised(t))]
            found = pd.DataFrame(rows, columns=["_row", item_key, "distance", "end", "n_chars"])
            found[key] = batch[key].array.take(found["_row"].to_numpy(int))
            yield found[[key, item_key, "distance", "end", "n_chars"]]

    return seek


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ``documents`` and ``benchmark`` items that they hold, up to 8 % edits."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
