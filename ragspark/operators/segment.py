"""Segmentation: documents to citable fragments with offsets, parts and dense ids."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``pos`` from 1 and ``texto`` of each line with words."""
    parts = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    return docs.select(key, F.posexplode(parts).alias("pos", "texto")).withColumn("pos", F.col("pos") + 1)


def offsets(rows: DataFrame, key: str = "doc_id", gap: int = 2) -> DataFrame:
    """``inicio`` and ``fin`` of each fragment in its document, ``gap`` characters apart."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("texto") + gap).over(before), F.lit(0)).cast("long")
    return rows.withColumn("inicio", start).withColumn("fin", F.col("inicio") + F.length("texto"))


def dense_ids(rows: DataFrame, order: list[str], name: str = "chunk_id") -> DataFrame:
    """A global row number from 0 in ``order``, without bringing all rows to one task.

    ``order`` begins with a number. Its quantiles, one for each shuffle partition,
    cut the rows into ranges by value, so a range is the same whenever it is
    computed; the counts of the ranges give each its first number.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = sorted(set(rows.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order[0]))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", bucket)
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    # As many numbers as ranges. A join on the range instead lets Spark infer filters on columns that its other side lacks.
    first = [F.lit(x).cast("long") for x in accumulate((sizes.get(i, 0) for i in range(len(cuts))), initial=0)]
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_row", within).withColumn(name, F.get(F.array(*first), F.col("_range")) + F.col("_row") - 1).drop("_range", "_row")


def parts_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``parte`` from 0 and ``n_partes`` of the rows that share ``keys``."""
    return rows.withColumn("parte", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).withColumn(
        "n_partes", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def repeat_suffix(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``veces``: how often a key has occurred so far; ``sufijo``: ``~k`` from the second on."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("veces", n).withColumn("sufijo", F.when(F.col("veces") > 1, F.concat(F.lit("~"), F.col("veces"))).otherwise(F.lit("")))


def numbering_gaps(rows: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose number leaves a gap after, or falls behind, the one before."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("anterior", before).filter((F.col(number) > F.col("anterior") + 1) | (F.col(number) < F.col("anterior")))


def without_running_headers(lines: DataFrame, least_pages: int = 3, max_chars: int = 120) -> DataFrame:
    """lines(doc_id, page, line_no, line) without short lines that stand on so many pages of their document."""
    seen = lines.groupBy("doc_id", "line").agg(F.countDistinct("page").alias("_pages"))
    headers = seen.filter((F.col("_pages") >= least_pages) & (F.length("line") < max_chars)).select("doc_id", "line")
    return lines.join(headers, ["doc_id", "line"], "left_anti")


def carried_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that was not null, up to each row."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def section_path(levels: Column, cut: int = 90) -> Column:
    """Headings joined from the top, each cut to so many characters."""
    return F.array_join(F.transform(levels, lambda x: F.substring(x, 1, cut)), " > ")


def validity(marks: Column, notes: Column) -> Column:
    """Status of an article from its marks and notes."""
    def has(c: Column, pattern: str) -> Column:
        return F.coalesce(c.rlike(pattern), F.lit(False))

    changed, repealed = "(?i)modificad|subrogad|adicionad", "(?i)derogad"
    return (
        F.when(has(marks, "(?i)inexequible") & ~has(marks, changed), F.lit("inexequible"))
        .when(has(marks, repealed) | has(notes, repealed), F.lit("derogado"))
        .when(has(marks, changed) | has(notes, changed), F.lit("modificado"))
        .otherwise(F.lit("vigente"))
    )


def merged_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals of each key merged where they overlap or touch."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int")
    island = rows.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(running))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
