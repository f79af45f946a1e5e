"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Measures are column expressions over a text; a rule bounds one of them. The
whole table becomes columns of a single projection, so a scan of the texts is
all that it costs: nothing is shuffled and no Python worker is started.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import fresh, table, text_or_empty

#: Fixed values of the contract: white space between words, symbols, and the base rules.
SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: What begins a bullet line, ends an interrupted one, and makes a word one of language.
BULLET, ELLIPSIS, LETTER = r"^[\x20\x09]*[-*•‣]", r"(\.\.\.|…)[\x20\x09\x0D]*\z", r"\p{L}"
#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = (
    "a", "about", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you",
    "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y",
    "au", "aux", "ce", "dans", "des", "du", "elle", "est", "et", "il", "je", "le", "les", "ne", "par", "pas", "pour", "qui", "sur", "une",
    "das", "dem", "den", "der", "die", "ein", "eine", "ich", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu",
)


@dataclass(frozen=True)
class Rule:
    """``measure``, an SQL expression over the measures, has to lie in [least, most]; a null bound does not bind.

    A null measure (a ratio of a text without words or lines) breaks no rule.
    """

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The thresholds in use; ratios are of words or of lines that hold a word.
RULES = (
    Rule("words", "n_words", 50, 100_000),
    Rule("word_length", "word_chars / n_words", 2, 14),
    Rule("symbols", "n_symbols / n_words", most=0.1),
    Rule("stop_words", "n_stop_words / n_words", least=0.02),
    Rule("letters", "n_letter_words / n_words", least=0.7),
    Rule("duplicate_lines", "n_dup_lines / n_lines", most=0.4),
    Rule("bullets", "n_bullet_lines / n_lines", most=0.9),
    Rule("ellipses", "n_ellipsis_lines / n_lines", most=0.3),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many of ``words`` lie in windows of ``window`` words that the array holds twice or more.

    Half a hash and the place of each window make one long; among the sorted
    longs, windows without a neighbour of the same half stand alone and go. The
    few that are left are sorted by their words, so a hash decides nothing.
    """
    def at(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(window)]

    def with_neighbour(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))

    def counted(w: Column) -> Column:
        keys = F.transform(w, lambda x, i: F.shiftleft(F.xxhash64(*at(w, i)), 32).bitwiseOR(i.cast("long")))
        likely = bound(F.sort_array(keys), lambda s: with_neighbour(s, lambda x, y: F.shiftright(x, 32) == F.shiftright(y, 32)))
        places = F.filter(F.transform(likely, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")), lambda i: i <= F.size(w) - window)
        grams = F.sort_array(F.transform(places, lambda i: F.struct(F.array(*at(w, i)).alias("g"), i.alias("i"))))
        twice = bound(grams, lambda s: with_neighbour(s, lambda x, y: x["g"] == y["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(window)])))))

    return bound(words, lambda w: counted(w))


def measures(text: Column) -> Column:
    """All measures of a text as one struct of longs; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))

    def count(rows: Column) -> Column:
        return F.size(rows).cast("long")

    def of_words(w: Column) -> list[Column]:
        stops = F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))
        return [
            count(w).alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"), count(stops).alias("n_stop_words"),
            count(F.filter(w, lambda x: x.rlike(LETTER))).alias("n_letter_words"),
        ]

    def of_lines(ls: Column) -> list[Column]:
        return [
            count(ls).alias("n_lines"), (count(ls) - count(F.array_distinct(ls))).alias("n_dup_lines"),
            count(F.filter(ls, lambda x: x.rlike(BULLET))).alias("n_bullet_lines"),
            count(F.filter(ls, lambda x: x.rlike(ELLIPSIS))).alias("n_ellipsis_lines"),
        ]

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))
    symbols = (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
    return bound(words, lambda w: bound(lines, lambda ls: F.struct(*of_words(w), *of_lines(ls), symbols.alias("n_symbols"))))


def judged(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``df`` with its measures, ``base_failed``, ``failed`` (names of the broken rules, in their order) and ``kept``.

    A null text counts as an empty one, which has no word and fails the base.
    Rows are judged one by one, so repeats and ties do not matter; an empty
    table gives an empty result. Columns of ``df`` keep their names: one that a
    measure's name clashes with is left out of the result.
    """
    held = fresh("_m", df.columns)
    rows = df.withColumn(held, measures(F.col(text)))
    names = [f.name for f in rows.schema[held].dataType.fields]
    made = {n.lower() for n in [*names, "base_failed", "failed", "kept"]}
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    m = rows.select(*own, *[F.col(held)[n].alias(n) for n in names])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*[_broken(r) for r in rules]))).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0))


def _broken(rule: Rule) -> Column:
    """The rule's name if its measure is out of bounds, else null; a division by zero is a null measure."""
    value = F.expr(" / ".join(f"nullif({p.strip()}, 0)" if i else p for i, p in enumerate(rule.measure.split("/"))))
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value < rule.least)
    if rule.most is not None:
        out = out | (value > rule.most)
    return F.when(out, F.lit(rule.name))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the base rules and by RULES."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"),
    )


def _sql_broken(rule: Rule) -> str:
    value = "::double / ".join(f"nullif({p.strip()}, 0)" if i else p.strip() for i, p in enumerate(rule.measure.split("/")))
    out = [f"{value} {op} {bound_}" for op, bound_ in (("<", rule.least), (">", rule.most)) if bound_ is not None]
    return f"CASE WHEN {' OR '.join(out)} THEN '{rule.name}' END"


OP11_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NO_SPACE}')) AS ls
  FROM documents
), words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
grams AS (
  SELECT r, i, w AS a, lead(w) OVER own AS b, lead(w, 2) OVER own AS c FROM words WINDOW own AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM grams WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), repeated AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::bigint AS n_symbols, len(ls)::bigint AS n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN {STOP_WORDS}))::bigint AS n_stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '{LETTER}')))::bigint AS n_letter_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '{BULLET}')))::bigint AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '{ELLIPSIS}')))::bigint AS n_ellipsis_lines
  FROM split LEFT JOIN repeated USING (r)
), v AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
    concat_ws(',', {", ".join(_sql_broken(r) for r in RULES)}) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v
"""
