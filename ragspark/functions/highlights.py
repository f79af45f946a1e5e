"""Where patterns for normalised text stand in the original: an offset map, matches mapped back, overlaps merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators.segment import merged_intervals

#: Marks that stand on the letter before them; normalised text is without them.
MARKS = "[̀-ͯ]"


def normalised(c: Column) -> Column:
    """Small letters without marks, composed or not: one character or none for each of the original."""
    return F.lower(T.strip_accents(F.regexp_replace(F.translate(c, "İ", "I"), MARKS, "")))


def offset_map(c: Column) -> Column:
    """For each character of ``normalised`` its place in the original, the end as a last entry; null where both are alike."""
    places = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0)), lambda x, i: F.when(~x.rlike(MARKS), i))
    return F.when(c.rlike(MARKS), F.concat(F.array_compact(places), F.array(F.char_length(c))))


def spans(c: Column, pattern: Column) -> Column:
    """array of (desde, hasta) in the original of all matches of a pattern in its normalised text; empty matches count for nothing.

    A span ends behind the last character matched, so marks that follow it stay outside.
    """
    out = normalised(c)
    return _in_original(_places(F.split(out, pattern), F.regexp_extract_all(out, pattern, F.lit(0))), offset_map(c))


def _places(between: Column, found: Column) -> Column:
    """array of (a, b) of the matches ``found`` in normalised text; what stands between them tells where each begins."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["between"])
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("a"), end.alias("b")))).alias("spans"))

    # Behind the last match stands one more piece, which has no match.
    pairs = F.filter(F.zip_with(between, found, lambda b, m: F.struct(b.alias("between"), m.alias("match"))), lambda x: x["match"].isNotNull())
    return F.filter(F.aggregate(pairs, zero, step)["spans"], lambda s: s["b"] > s["a"])


def _in_original(raw: Column, places: Column) -> Column:
    """Spans of normalised text mapped back by ``offset_map``."""
    mapped = F.transform(raw, lambda s: F.struct(F.get(places, s["a"]).alias("desde"), (F.get(places, s["b"] - 1) + 1).alias("hasta")))
    plain = F.transform(raw, lambda s: F.struct(s["a"].alias("desde"), s["b"].alias("hasta")))
    return F.when(places.isNull(), plain).otherwise(mapped)


def highlights(rows: DataFrame, patterns: DataFrame, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """(keys, desde, hasta) to be marked in rows(keys, texto) for patterns(on, patron); spans that overlap or touch are one.

    Patterns meet only the rows that share the columns ``on`` with them. Null texts and patterns mark nothing.
    """
    # Each step stands in a column, so a text is normalised once, not in every place that uses it.
    text, kept = F.col("texto"), list(dict.fromkeys([*keys, *on]))
    texts = rows.filter("texto IS NOT NULL").select(*kept, normalised(text).alias("_out"), offset_map(text).alias("_map"))
    asked = texts.join(patterns.filter("patron IS NOT NULL").select(*on, "patron"), list(on))
    cut = asked.select(*keys, "_map", F.split("_out", F.col("patron")).alias("_between"), F.regexp_extract_all("_out", F.col("patron"), F.lit(0)).alias("_found"))
    raw = cut.select(*keys, "_map", _places(F.col("_between"), F.col("_found")).alias("_raw"))
    one = raw.select(*keys, F.explode(_in_original(F.col("_raw"), F.col("_map"))).alias("s")).select(*keys, "s.desde", "s.hasta")
    return merged_intervals(one, list(keys), "desde", "hasta")
