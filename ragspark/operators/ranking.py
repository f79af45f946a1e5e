"""Operators over ranked lists.

A ranked list is a relation ``(qid, pos, doc_id, chunk_id, score, ...)`` with
``pos`` from 1 without gaps in each ``qid``; several lists of a query carry
``list_ord`` as well. Every window is partitioned by the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("doc_id", "chunk_id")


def _by(*cols: str | Column, partition: Sequence[str] = ("qid",)):
    return Window.partitionBy(*partition).orderBy(*cols)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """A double to so many digits as SQL engines round it: the scaled double to a whole number, halves away from zero.

    Spark's own ``round`` goes by the shortest decimal instead and parts from that at halves.
    """
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * scale) / scale


def canonical_order(score: str | Column = "score", digits: int = 6) -> list[Column]:
    """Rounded score downwards, then document and chunk upwards."""
    return [rounded(score, digits).desc(), F.col("doc_id"), F.col("chunk_id")]


def ranked(df: DataFrame, k: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """``df`` with ``pos`` in canonical (or the given) order, cut to ``k`` rows of each query."""
    out = df.drop("pos").withColumn("pos", F.row_number().over(_by(*(order or canonical_order()))))
    return out.filter(F.col("pos") <= k) if k else out


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the lists of each query; other columns come from a key's first appearance."""
    rest = [c for c in lists.columns if c not in ("qid", *KEY, "score", "pos", "list_ord")]
    first = [F.min_by(c, F.struct("list_ord", "pos")).alias(c) for c in rest]
    fused = lists.groupBy("qid", *KEY).agg(F.sum(1.0 / (k + F.col("pos"))).alias("score"), *first)
    return ranked(fused)


def reorder_with(base: DataFrame, others: DataFrame, k: int = 60) -> DataFrame:
    """``base`` in the order of its fusion with ``others``; scores stay."""
    votes = base.select("qid", *KEY, "pos").unionByName(others.select("qid", *KEY, "pos"))
    sums = votes.groupBy("qid", *KEY).agg(F.sum(1.0 / (k + F.col("pos"))).alias("_rrf"))
    return ranked(base.join(sums, ["qid", *KEY]), order=canonical_order("_rrf", 9)).drop("_rrf")


def with_caps(df: DataFrame, cls: Column, cap: Column, exempt: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows of each query among those within their class's cap.

    Too few of them are filled up with the first of the others; rows keep their
    original order. Exempt rows count against no cap.
    """
    free = F.coalesce(exempt, F.lit(False))
    rank = F.sum(F.when(~free, 1).otherwise(0)).over(
        Window.partitionBy("qid", "_cls").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = df.withColumn("_cls", cls).withColumn("_free", free).withColumn("_cap", cap)
    marked = marked.withColumn("_ok", F.col("_free") | (rank <= F.col("_cap")))
    turn = marked.withColumn("_turn", F.row_number().over(_by(F.col("_ok").desc(), "pos"))).filter(F.col("_turn") <= limit)
    kept = turn.drop("_cls", "_free", "_cap", "_ok", "_turn")
    return ranked(kept.withColumnRenamed("pos", "_old"), order=[F.col("_old")]).drop("_old")


def per_document_cap(df: DataFrame, cap: int, limit: int) -> DataFrame:
    return with_caps(df, F.col("doc_id"), F.lit(cap), F.lit(False), limit)


def type_quota(df: DataFrame, caps: dict[str, int], limit: int, named: Column | None = None, factor: float = 1.0) -> DataFrame:
    """Caps by the column ``clase``; rows of no capped class, and named documents, are exempt."""
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(F.col("clase") == name, F.lit(round(n * factor))).otherwise(cap)
    free = cap.isNull() | (named if named is not None else F.lit(False))
    return with_caps(df, F.col("clase"), F.coalesce(cap, F.lit(0)), free, limit)


def guarantee(candidates: DataFrame, primaries: DataFrame, limit: int, is_primary: Column) -> DataFrame:
    """Candidates with all ``primaries`` in: missing ones are appended, the last others give way."""
    missing = primaries.join(candidates.select("qid", *KEY), ["qid", *KEY], "left_anti")
    sizes = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("_n")).join(
        missing.groupBy("qid").agg(F.count(F.lit(1)).alias("_m")), "qid", "left")
    back = F.row_number().over(Window.partitionBy("qid", "_primary").orderBy(F.col("pos").desc()))
    marked = candidates.withColumn("_primary", F.coalesce(is_primary, F.lit(False))).withColumn("_back", back).join(sizes, "qid")
    over = F.col("_n") + F.coalesce("_m", F.lit(0)) - limit
    kept = marked.filter(F.col("_primary") | (F.col("_back") > over)).drop("_primary", "_back", "_n", "_m").withColumn("_part", F.lit(0))
    both = kept.unionByName(missing.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return ranked(both.withColumnRenamed("pos", "_old"), limit, [F.col("_part"), F.col("_old"), *map(F.col, KEY)]).drop("_old", "_part")


def penalise(df: DataFrame, factors: dict[str, float], status: str = "vigencia") -> DataFrame:
    """Order by the score times the status's factor (divided by it where negative); scores stay."""
    factor = F.lit(1.0)
    for name, f in factors.items():
        factor = F.when(F.col(status) == name, F.lit(f)).otherwise(factor)
    value = F.when(F.col("score") >= 0, F.col("score") * factor).otherwise(F.col("score") / factor)
    return ranked(df, order=canonical_order(value))


def first_of_key(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each key of a query."""
    once = F.row_number().over(Window.partitionBy("qid", *KEY).orderBy(*order))
    return df.withColumn("_once", once).filter("_once = 1").drop("_once")


def fuse(lookup: DataFrame, lists: DataFrame, fixed: DataFrame, limit: int = 10) -> DataFrame:
    """Lookup rows, then the query's only list or the fusion of its lists, without repeats, ``limit`` in all.

    Fixed rows that are not among the first ``limit`` take the last places.
    """
    sizes = lists.groupBy("qid").agg(F.countDistinct("list_ord").alias("_lists"))
    counted = lists.join(sizes, "qid")
    single = counted.filter("_lists = 1").drop("_lists", "list_ord")
    many = rrf(counted.filter("_lists > 1").drop("_lists"))
    body = single.unionByName(many.select(*single.columns)).withColumn("_part", F.lit(1))
    head = lookup.withColumn("_part", F.lit(0))
    whole = first_of_key(head.unionByName(body, allowMissingColumns=True), ["_part", "pos"])
    kept = ranked(whole.withColumnRenamed("pos", "_old"), limit, [F.col("_part"), F.col("_old")]).drop("_old", "_part")
    more = first_of_key(fixed, ["pos"]).join(kept.select("qid", *KEY), ["qid", *KEY], "left_anti")
    more = ranked(more.withColumnRenamed("pos", "_old"), limit, [F.col("_old")]).drop("_old")
    room = more.groupBy("qid").agg(F.count(F.lit(1)).alias("_fixed"))
    trimmed = kept.join(room, "qid", "left").filter(F.col("pos") <= limit - F.coalesce("_fixed", F.lit(0))).drop("_fixed")
    both = trimmed.withColumn("_part", F.lit(0)).unionByName(more.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return ranked(both.withColumnRenamed("pos", "_old"), order=[F.col("_part"), F.col("_old")]).drop("_old", "_part")
