"""Plugs for models: encoders, rerankers and planners, with stand-ins that need none.

A plug is a function over columns. The stand-ins are lexical and deterministic;
their scores are not those of a neural model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators.ranking import ranked, rounded

Scorer = Callable[[Column, Column], Column]


def token_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct tokens that the passage has: the stand-in for a cross-encoder."""
    asked = F.array_distinct(T.tokens(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, T.tokens(passage))) / F.size(asked))


def reranked(candidates: DataFrame, queries: DataFrame, scorer: Scorer = token_overlap, k: int | None = None) -> DataFrame:
    """candidates(qid, texto, ...) in the order of ``scorer`` on queries(qid, text); any scorer may be plugged in."""
    scored = candidates.join(queries.select("qid", F.col("text").alias("_asked")), "qid").withColumn("score", rounded(scorer(F.col("_asked"), F.col("texto"))))
    return ranked(scored.drop("_asked"), k)


def subqueries(plans: DataFrame, most: int = 3, max_words: int = 25) -> DataFrame:
    """plans(qid, question, proposals) to rows: cut to words, not empty, no copy of the question, distinct, ``most`` each."""
    def cut(s: Column) -> Column:
        return F.array_join(F.slice(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""), 1, max_words), " ")

    rows = plans.select("qid", "question", F.posexplode("proposals").alias("ord", "raw")).withColumn("sub", cut(F.col("raw")))
    rows = rows.filter((F.col("sub") != "") & (F.lower("sub") != F.lower(cut(F.col("question")))))
    first = rows.groupBy("qid", F.lower("sub").alias("_key")).agg(F.min_by("sub", "ord").alias("sub"), F.min("ord").alias("ord"))
    return ranked(first.drop("_key"), most, [F.col("ord")]).select("qid", "pos", "sub")
