"""Readers of line tables, as a PDF's text layer lands them: lines(doc_id, pagina, linea, texto) become paragraphs, articles and extracts.

Everything is gaps and islands: a flag says where something begins, its running
sum numbers it, and a grouping joins what has one number. Nothing walks a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import text as T
from ragspark.sources import norms as N

#: Page numbers, titles and their ranks, provisions behind the articles and their ordinals, closings, markers of an item that stand alone.
PAGE_NUMBER = r"^\s*-?\s*\d{1,3}\s*-?\s*$"
LEVEL = r"(?iu)^(T[ÍI]TULO|CAP[ÍI]TULO|SECCI[ÓO]N)\b"
LEVEL_RANKS = {"T": 2.0, "C": 3.0, "S": 4.0}
SUBTITLE_RANK = 5.0
PROVISIONS = r"(?iu)^DISPOSICI[ÓO]N(?:ES)?\s+(TRANSITORIAS?|FINAL(?:ES)?|COMPLEMENTARIAS?)"
ORDINAL = (r"(?iu)^((?:DÉCIMO|DECIMO|VIGÉSIMO|VIGESIMO)?\s*(?:PRIMERA|SEGUNDA|TERCERA|CUARTA|QUINTA|SEXTA|S[ÉE]PTIMA|OCTAVA|NOVENA|D[ÉE]CIMA|UND[ÉE]CIMA|DUOD[ÉE]CIMA))\s*[.\-–]+")
CLOSED = r"^(?:Dada en|Dado en|Firmad[oa] en)\b"
MARKER = r"^(?:[a-zñ]{1,2}\)|\d{1,2}\)|[ivx]{1,4}\)|[-•])$"
#: References to rulings in a digest, what closes an extract, single letters, titles, ends of paragraphs, labels, and the index behind it.
REF = r"(?:SC|STC|AC|ATC|SL|SP|STL|STP|AL|AP)\s?\d{1,5}-\d{4}"
REF_ALONE = rf"^({REF})$"
EXTRACT_END = rf"\(({REF})(?:\s*,\s*{REF})*\s*;\s*\d{{1,2}}/\d{{1,2}}/\d{{4}}\)\S{{0,3}}\s*$"
OPEN_END = rf"\({REF}(?:\s*,\s*{REF})*\s*;?\s*$"
LETTER = r"^[A-ZÁÉÍÓÚÑ]$"
TITLE = r"^[^a-záéíóúñ]{4,70}$"
FIGURES = r"^[\d/ ().;,]+$"
PARAGRAPH_END = r"[.:;»”\")]\s*$"
LABEL = r"^[A-ZÁÉÍÓÚÑ. ]{4,40}:"
INDEX = r"(?iu)^Índice alfabético$"
#: Share of a digest's pages from which on a line is a running header.
HEADER_SHARE = 0.6
_PLACE = ("pagina", "linea")


def _in_order(by: tuple[str, ...] = _PLACE):
    return Window.partitionBy("doc_id").orderBy(*by)


def _islands(rows: DataFrame, begins: Column, order: tuple[str, ...], number: str) -> DataFrame:
    """``rows`` with the running number of the island each lies in."""
    return rows.withColumn("_begins", begins).withColumn(number, F.sum(F.col("_begins").cast("int")).over(_in_order(order))).drop("_begins")


def _joined(rows: DataFrame, keys: list[str], order: tuple[str, ...], sep: str = " ") -> DataFrame:
    """The texts of each island in order, as one."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "texto")))
    return rows.groupBy("doc_id", *keys).agg(F.array_join(F.transform(listed, lambda x: x["texto"]), sep).alias("texto"))


def law_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, texto) of lines: page numbers out, broken words joined, markers that stand alone glued to what follows.

    A paragraph ends at an empty line, and begins at an article, a title, a
    provision or a marker. Of markers in a row the second is glued to the first,
    the fourth to the third, and so on.
    """
    rows = lines.withColumn("texto", F.trim(T.repaired_symbols(F.coalesce("texto", F.lit(""))))).filter(~F.col("texto").rlike(PAGE_NUMBER))
    text, before = F.col("texto"), F.lag("texto").over(_in_order())
    alone = F.coalesce(before.rlike(MARKER), F.lit(False))
    opens = text.rlike(N.PDF_ARTICLE) | text.rlike(LEVEL) | text.rlike(PROVISIONS) | text.rlike(MARKER) | alone | F.coalesce(before == "", F.lit(True))
    blocks = _islands(rows, (text != "") & opens, _PLACE, "k").filter("texto <> ''")
    whole = _joined(blocks, ["k"], _PLACE)
    whole = whole.withColumn("texto", T.clean_spaces(F.regexp_replace("texto", "([a-záéíóúñ])- ([a-záéíóúñ])", "$1$2")))
    own = _in_order(("k",))
    marked = whole.withColumn("_mark", F.col("texto").rlike(MARKER)).withColumn("_i", F.row_number().over(own))
    last = F.coalesce(F.last(F.when(~F.col("_mark"), F.col("_i")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    glued = _islands(marked.withColumn("_before", F.col("_i") - last - 1), F.col("_before") % 2 == 0, ("k",), "pos")
    return _joined(glued, ["pos"], ("k",)).select("doc_id", F.col("pos").cast("long").alias("pos"), "texto")


def law_articles(lines: DataFrame) -> DataFrame:
    """Articles (see ``norms.articles``) of a law's lines; provisions behind the articles are numbered by their ordinals.

    A title's name is the capital paragraph behind it; a short line in front of
    an article that ends no sentence is a subtitle.
    """
    rows = law_paragraphs(lines)
    run = _in_order(("pos",))
    text, after = F.col("texto"), F.coalesce(F.lead("texto").over(run), F.lit(""))
    article = F.upper(F.regexp_extract("texto", N.PDF_ARTICLE, 1))
    level = F.when((F.length("texto") < 120) & text.rlike(LEVEL), F.upper(F.substring("texto", 1, 1)))
    kind = F.when((F.length("texto") < 80) & text.rlike(PROVISIONS), F.upper(F.regexp_extract("texto", PROVISIONS, 1)))
    cls = F.when(kind.startswith("TRANS"), "TRANSITORIA").when(kind.startswith("FINAL"), "FINAL").when(kind.isNotNull(), "COMPLEMENTARIA")
    rows = rows.withColumns({"_article": article, "_level": level, "_class": cls})
    # A title ends the provisions before it.
    state = F.last(F.when(F.col("_class").isNotNull(), F.col("_class")).when(F.col("_level").isNotNull(), F.lit("")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_in", F.nullif(state, F.lit("")))
    ordinal = F.upper(F.regexp_replace(F.regexp_extract("texto", ORDINAL, 1), r"\s+", " "))
    number = F.when(F.col("_article") != "", F.col("_article")).when(F.col("_in").isNotNull() & (ordinal != ""), F.concat_ws(" ", "_in", ordinal))
    capital = (F.upper("texto") == F.col("texto")) & (F.lower("texto") != F.col("texto"))
    short = (F.length("texto") < 110) & ~text.rlike(r"[.:;,]$") & ~capital & after.rlike(N.PDF_ARTICLE)
    rank = F.when(F.col("_level").isNotNull(), F.element_at(F.create_map(*[F.lit(x) for pair in LEVEL_RANKS.items() for x in pair]), F.col("_level"))).when(
        F.col("_class").isNotNull(), 2.0).when(short, SUBTITLE_RANK)
    return N.articles(rows.select(
        "doc_id", "pos", "texto", number.alias("num"), F.lit(True).alias("ancla"), rank.alias("rango"),
        F.when(F.col("_level").isNotNull(), F.rtrim("texto", F.lit(". "))).otherwise(text).alias("etiqueta"), F.col("_level").isNotNull().alias("pide"),
        (capital & F.col("_level").isNull() & (F.col("_article") == "") & (F.length("texto") < 150)).alias("puede"), text.rlike(CLOSED).alias("cierre")),
        (*LEVEL_RANKS.values(), SUBTITLE_RANK))


def running_headers(lines: DataFrame, share: float = HEADER_SHARE) -> DataFrame:
    """(doc_id, texto) of the lines that stand on at least this share of a document's pages."""
    rows = lines.withColumn("texto", F.trim("texto"))
    pages = rows.groupBy("doc_id").agg(F.countDistinct("pagina").alias("_pages"))
    seen = rows.filter("texto <> ''").select("doc_id", "texto", "pagina").distinct().groupBy("doc_id", "texto").agg(F.count(F.lit(1)).alias("_n"))
    return seen.join(pages, "doc_id").filter(F.col("_n") >= share * F.col("_pages")).select("doc_id", "texto")


def digest_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, k, texto) of a digest's lines: headers, page numbers and empty lines out, values (": NAME") behind their labels."""
    rows = lines.withColumn("texto", F.trim(F.coalesce("texto", F.lit("")))).filter((F.col("texto") != "") & ~F.col("texto").rlike(r"^\s*\d{1,3}\s*$"))
    rows = rows.join(running_headers(lines), ["doc_id", "texto"], "left_anti")
    first = F.row_number().over(_in_order()) == 1
    rows = _islands(rows, ~F.col("texto").startswith(":") | first, _PLACE, "k")
    rows = rows.withColumn("texto", F.when(F.col("texto").startswith(":"), F.col("texto")).otherwise(T.clean_spaces(F.col("texto"))))
    return _joined(rows, ["k"], _PLACE, "")


def digest_paragraphs(rows: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, pos, texto) of rows(doc_id, part, k, texto): titles, labels and letters stand alone, other lines go on to an end of a paragraph.

    A reference that is cut at a line's end is no end of a paragraph.
    """
    run = Window.partitionBy("doc_id", part).orderBy("k")
    text = F.col("texto")
    alone = (text.rlike(TITLE) & ~text.rlike(OPEN_END) & ~text.rlike(FIGURES)) | text.rlike(LABEL) | text.rlike(LETTER)
    ends = alone | (text.rlike(PARAGRAPH_END) & ~text.rlike(OPEN_END))
    rows = rows.withColumns({"_alone": alone, "_ends": ends})
    begins = F.col("_alone") | F.coalesce(F.lag("_ends").over(run), F.lit(True))
    rows = rows.withColumn("_b", begins).withColumn("pos", F.sum(F.col("_b").cast("int")).over(run))
    return _joined(rows, [part, "pos"], ("k",))


def digest_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, seccion, n, titulo, pos, texto) of a digest: extracts, each closed by its reference, then a review for each reference that stands alone.

    What follows the last closing goes with the last extract. Extracts begin at
    the first single letter; the index behind the middle of the digest ends it.
    """
    rows = digest_lines(lines)
    t = F.col("texto")
    sizes = Window.partitionBy("doc_id")
    rows = rows.withColumns({"_k": F.row_number().over(_in_order(("k",))), "_all": F.count(F.lit(1)).over(sizes)})
    rows = rows.withColumn("_end", F.min(F.when(t.rlike(INDEX) & (F.col("_k") - 1 > F.floor(F.col("_all") / 2)), F.col("_k"))).over(sizes))
    kept = rows.filter(F.col("_end").isNull() | (F.col("_k") < F.col("_end")))
    kept = kept.withColumns({"_a": F.coalesce(F.min(F.when(t.rlike(LETTER), F.col("_k"))).over(sizes), F.lit(1)), "_b": F.min(F.when(t.rlike(REF_ALONE), F.col("_k"))).over(sizes)})
    first = kept.filter((F.col("_k") >= F.col("_a")) & (F.col("_b").isNull() | (F.col("_k") < F.col("_b")))).withColumn("_p", F.lit(0))
    paras = digest_paragraphs(first.select("doc_id", "_p", "k", "texto"), "_p").filter(~t.rlike(LETTER))
    # Extracts are numbered by the closings from here to the end, counted backwards; the tail has none and goes to the last.
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    closes = t.rlike(EXTRACT_END)
    paras = paras.withColumn("_closes", closes.cast("int")).withColumns({"_left": F.sum("_closes").over(back), "_total": F.sum("_closes").over(Window.partitionBy("doc_id"))})
    paras = paras.filter("_total > 0").withColumn("n", F.col("_total") - F.greatest(F.col("_left"), F.lit(1)) + 1)
    ref = F.regexp_replace(F.max(F.when(F.col("_closes") == 1, F.regexp_extract("texto", EXTRACT_END, 1))).over(Window.partitionBy("doc_id", "n")), r"\s+", "")
    extracts = paras.select("doc_id", F.lit("extracto").alias("seccion"), "n", ref.alias("titulo"), "pos", "texto")
    second = _islands(kept.filter(F.col("_k") >= F.col("_b")), F.col("texto").rlike(REF_ALONE), ("k",), "_r").withColumn("_head", F.col("texto").rlike(REF_ALONE))
    heads = second.filter("_head").select("doc_id", "_r", F.regexp_replace("texto", r"\s+", "").alias("titulo"))
    reviews = digest_paragraphs(second.filter("NOT _head").select("doc_id", "_r", "k", "texto"), "_r").join(heads, ["doc_id", "_r"])
    return extracts.unionByName(reviews.select("doc_id", F.lit("providencia").alias("seccion"), F.col("_r").alias("n"), "titulo", "pos", "texto"))
