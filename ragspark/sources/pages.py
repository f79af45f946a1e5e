"""Pages as relations: HTML becomes rows of blocks by column functions, tables and lists flattened.

No parser object walks a page. The markup is cut where a block element begins;
each piece is a row, and what a piece belongs to (its table, row and cell) is a
running count over the pieces before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import text as T

#: Named characters of HTML that pages in Spanish use.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ", "uuml": "ü",
    "Aacute": "Á", "Eacute": "É", "Iacute": "Í", "Oacute": "Ó", "Uacute": "Ú", "Ntilde": "Ñ", "Uuml": "Ü", "iquest": "¿", "iexcl": "¡", "laquo": "«", "raquo": "»",
    "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "ndash": "–", "mdash": "—", "hellip": "…", "ordf": "ª", "ordm": "º", "deg": "°", "sect": "§", "middot": "·",
    "copy": "©", "reg": "®", "shy": "­", "amp": "&",
}
#: Elements at which a piece begins.
CUTS = "p|h[1-6]|li|ol|ul|table|tr|td|th|div|blockquote|center|body|/table|/ol|/ul|/div"
BEFORE = (Window.unboundedPreceding, Window.currentRow)


def unescaped(c: Column) -> Column:
    """Named characters and decimal or hexadecimal numbers of the Basic Multilingual Plane as themselves."""
    def numbered(text: Column, pattern: str, base: int) -> Column:
        def put(acc: Column, found: Column) -> Column:
            code = F.lpad(F.conv(F.regexp_extract(found, r"([0-9A-Fa-f]+);", 1), base, 16), 4, "0")
            return F.replace(acc, found, F.decode(F.unhex(code), "UTF-16BE"))

        return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), text, put)

    table = F.array(*[F.struct(F.lit(f"&{name};").alias("name"), F.lit(char).alias("char")) for name, char in ENTITIES.items()])
    named = F.aggregate(table, numbered(numbered(c, r"&#\d{1,4};", 10), r"&#[xX][0-9A-Fa-f]{1,4};", 16), lambda acc, e: F.replace(acc, e["name"], e["char"]))
    return F.when(c.contains("&"), named).otherwise(c)


def plain(c: Column) -> Column:
    """Text of a piece of markup: tags out, characters decoded, white space cleaned."""
    return T.clean_spaces(unescaped(F.regexp_replace(c, r"<[^>]*>?", "")))


def without(html: Column, *elements: str) -> Column:
    """``html`` without whole elements, each given as name and, after a space, a pattern that its attributes hold."""
    for element in elements:
        name, _, attributes = element.partition(" ")
        holding = rf"(?=[^>]*{attributes})" if attributes else ""
        html = F.regexp_replace(html, rf"(?is)<({name})\b{holding}[^>]*>.*?</\1\s*>", "")
    return html


#: What no reader wants, and struck text.
NOISE = ("script", "style", "head", "s", "strike", "del")
#: Notes at the foot of a page that a word processor exported, and the marks that call them.
FOOTNOTES = (r"div \bid\s*=\s*[\"']?(?:ftn|edn)", r"a \bhref\s*=\s*[\"']?#_(?:ftn|edn)")


def pieces(pages: DataFrame, keys: Sequence[str], html: Column) -> DataFrame:
    """(keys, k, tag, marca, texto): the page cut where block elements begin; ``marca`` is the markup of the piece's tags."""
    cut = F.split(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), rf"(?i)(?=<(?:{CUTS})\b)")
    # Whole pages are dealt by their document, before anything is read: the windows behind need no other shuffle, and a table in few files has all cores.
    rows = pages.repartition(keys[0]).select(*keys, F.posexplode_outer(cut).alias("k", "piece")).filter("k IS NOT NULL")
    # What stands behind the end of a paragraph, an item or a cell belongs to none.
    rows = rows.withColumn("piece", F.regexp_replace("piece", r"(?is)^(<(p|h[1-6]|li|td|th|center)\b.*?</\2\s*>).*$", "$1"))
    return rows.select(
        *keys, "k", F.lower(F.regexp_extract("piece", r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"),
        F.array_join(F.regexp_extract_all("piece", F.lit(r"<[^>]*>"), F.lit(0)), "").alias("marca"), plain(F.col("piece")).alias("texto"))


def blocks(pages: DataFrame, keys: Sequence[str], html: Column) -> DataFrame:
    """(keys, pos, tag, marca, texto) of every block with text, in order.

    A table is one block: cells joined by " | ", rows by line ends, rows without
    text left out; a table without text has an empty one. Text of a table inside
    a table belongs to the outer one's cell.
    """
    rows = pieces(pages, keys, html)
    run = Window.partitionBy(*keys).orderBy("k").rowsBetween(*BEFORE)

    def count(*tags: str) -> Column:
        return F.sum(F.col("tag").isin(*tags).cast("int")).over(run)

    depth = rows.withColumn("_in", count("table") - count("/table"))
    placed = depth.withColumn("_table", F.last(F.when((F.col("tag") == "table") & (F.col("_in") == 1), F.col("k")), ignorenulls=True).over(run)).withColumns({
        "_row": count("tr"), "_cell": count("td", "th")})
    outside = placed.filter((F.col("_in") <= 0) & (F.col("texto") != "")).select(*keys, F.col("k").alias("pos"), "tag", "marca", "texto")
    inside = placed.filter("_in > 0")

    def joined(df: DataFrame, by: list[str], key: str, sep: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(key, "texto")))
        return df.groupBy(*keys, *by).agg(F.array_join(F.transform(listed, lambda x: x["texto"]), sep).alias("texto"))

    cells = joined(inside.filter("_cell > 0 AND (texto <> '' OR tag IN ('td', 'th'))"), ["_table", "_row", "_cell"], "k", " ")
    lines = joined(cells.withColumn("texto", F.trim("texto")), ["_table", "_row"], "_cell", " | ").filter(F.regexp_replace("texto", "[ |]", "") != "")
    tables = joined(lines, ["_table"], "_row", "\n")
    marks = placed.filter("tag = 'table' AND _in = 1").select(*keys, F.col("k").alias("_table"), "marca")
    return outside.unionByName(marks.join(tables, [*keys, "_table"], "left").select(
        *keys, F.col("_table").alias("pos"), F.lit("table").alias("tag"), "marca", F.coalesce("texto", F.lit("")).alias("texto")))


def paths(rows: DataFrame, ranks: Sequence[float], keys: Sequence[str] = ("doc_id",), order: str = "pos") -> DataFrame:
    """``rows`` with ``ruta``: the labels in effect at each row, its own included, of rows with a ``rango`` and an ``etiqueta``.

    A heading is in effect until one of its rank or a lower number comes. Of
    each rank the last heading is known by a window; it holds if no heading of a
    lower number came after it.
    """
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(*BEFORE)
    last = {r: F.last(F.when(F.col("rango") == r, F.struct(F.col(order).alias("p"), F.col("etiqueta").alias("e"))), ignorenulls=True).over(run) for r in ranks}
    held = rows.withColumns({f"_r{i}": last[r] for i, r in enumerate(ranks)})
    shown, above = [], F.lit(-1).cast("long")
    for i in range(len(ranks)):
        own = F.col(f"_r{i}")
        shown.append(F.when(own["p"] > above, own["e"]))
        above = F.greatest(above, F.coalesce(own["p"].cast("long"), F.lit(-1).cast("long")))
    return held.withColumn("ruta", F.array_compact(F.array(*shown)) if ranks else F.array().cast("array<string>")).drop(*[f"_r{i}" for i in range(len(ranks))])
