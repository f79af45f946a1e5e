"""Inventory of norms: names and keys of its rows, matching with what is there, addresses and their validation."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import citations as C
from ragspark.functions import text as T
from ragspark.operators.ingest import parser_of

#: Order of an inventory row's keys; kinds that are never cited; senates of the courts; areas by weight.
KEYS = ("doc_id", "nombre_citable", "tipo", "numero", "anio", "organo_emisor", "alias_citables", "fuente", "donde_buscar", "url", "items_del_banco", "areas", "canonico",
        "origen", "prioridad", "ola", "estado", "justificacion")
EXCLUDED_KINDS = ("doctrina", "auto", "decision_administrativa")
CONSTITUTIONAL = ("C", "T", "SU")
SENATES = {"SL": "Laboral", "SC": "Civil", "SP": "Penal", "STC": "Civil", "STL": "Laboral"}
#: Corrected year of a law that does not exist, documents and laws of the first waves, origins of the second.
CORRECTED = {"ley/1692/2017": "ley/1692/2013"}
WAVE_0 = ("constitucion", "codigo_general_proceso", "ley_472_1998")
WAVE_1 = ("ley/80/1993", "ley/2220/2022", "decreto/2153/1992", "ley/1116/2006")
WAVE_2_ORIGINS = ("seed_targets", "sample_50.legal_basis", "citations.CODES")
#: Where norms lie, and the bytes that a page has at least.
SENATE_SITE = "http://www.secretariasenado.gov.co/senado/basedoc/"
COURT_SITE = "https://www.corteconstitucional.gov.co/relatoria/"
ANDEAN_SITE = "https://www.comunidadandina.org/StaticFiles/DocOf/"
LEAST_BYTES, LEAST_MARKDOWN = 12_000, 2_000


def whole_number(c: Column) -> Column:
    """"046" as "46"; what is no number stays."""
    return F.when(c.rlike(r"^\d+$"), F.regexp_replace(c, r"^0+(?=\d)", "")).otherwise(c)


def match_key(tipo: Column, numero: Column, anio: Column) -> Column:
    """The key that rows of one norm share, whatever zeros its number has; known errors are corrected."""
    key = F.concat_ws("/", tipo, whole_number(numero), anio)
    fixed = F.create_map(*[F.lit(x) for pair in CORRECTED.items() for x in pair])
    return F.coalesce(F.element_at(fixed, key), key)


def cite_of_id(doc_id: Column) -> Column:
    """"ley_599_2000" as "Ley 599 de 2000", "sentencia_c-355_2006" as "Sentencia C-355 de 2006"; else null."""
    norm, ruling = r"^(ley|decreto|resolucion|acuerdo)_(\d+)_(\d{4})$", r"^sentencia_([a-z]+)-(\d+)_(\d{4})$"
    kind = F.initcap(F.regexp_replace(F.regexp_extract(doc_id, norm, 1), "^resolucion$", "resolución"))
    return F.when(doc_id.rlike(norm), F.concat(kind, F.lit(" "), whole_number(F.regexp_extract(doc_id, norm, 2)), F.lit(" de "), F.regexp_extract(doc_id, norm, 3))).when(
        doc_id.rlike(ruling), F.concat(F.lit("Sentencia "), F.upper(F.regexp_extract(doc_id, ruling, 1)), F.lit("-"), F.regexp_extract(doc_id, ruling, 2), F.lit(" de "),
                                       F.regexp_extract(doc_id, ruling, 3)))


def ruling_name(court: Column, number: Column, year: Column) -> Column:
    """Rulings of the constitutional court have three digits at least."""
    padded = F.when(court.isin(*CONSTITUTIONAL) & (F.length(number) < 3), F.lpad(number, 3, "0")).otherwise(number)
    return F.concat(F.lit("Sentencia "), court, F.lit("-"), padded, F.lit(" de "), year)


def bodies_of_row(rows: DataFrame) -> DataFrame:
    """rows(excel_id, titulo) with ``cuerpos`` that they name and ``propio``, the row's own body if the id or else the title names one only."""
    of_id, of_title = (C.bodies(C.citations(F.coalesce(c, F.lit("")))) for c in (cite_of_id(F.col("excel_id")), F.col("titulo")))
    found = rows.withColumn("_a", of_id).withColumn("_b", of_title)
    own = F.when(F.size("_a") == 1, F.get("_a", F.lit(0))).when(F.size("_b") == 1, F.get("_b", F.lit(0)))
    return found.withColumn("cuerpos", F.array_union("_a", "_b")).withColumn("propio", own).drop("_a", "_b")


def new_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Inventory rows, and the columns ``keep``, for rows(excel_id, titulo, tipo, propio): a ruling, a numbered norm, or another document."""
    own, title = F.col("propio"), F.col("titulo")
    court, number = F.split_part(own["numero"], F.lit("-"), F.lit(1)), whole_number(F.split_part(own["numero"], F.lit("-"), F.lit(2)))
    ruling, numbered = own["tipo"] == "jurisprudencia", own["numero"].isNotNull()
    pair = r"(\d{1,5}) de (\d{4})"

    def by(a: Column, b: Column, c: Column) -> Column:
        return F.when(F.coalesce(ruling, F.lit(False)), a).when(F.coalesce(numbered, F.lit(False)), b).otherwise(c)

    def in_title(k: int) -> Column:
        return F.when(title.rlike(pair), F.regexp_extract(title, pair, k))

    kind = F.initcap(F.regexp_replace(own["tipo"], "^resolucion$", "resolución"))
    senate = F.trim(F.concat(F.lit("Corte Suprema de Justicia, Sala de Casación "), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SENATES.items() for x in p]), court), F.lit(""))))
    court_name = F.when(court.isin(*CONSTITUTIONAL), F.lit("Corte Constitucional")).otherwise(senate)
    made_by = F.when(own["tipo"] == "ley", F.lit("Congreso de la República")).when(own["tipo"] == "decreto", F.lit("Gobierno Nacional"))
    return rows.select(
        *keep, by(F.concat_ws("_", F.lit("sentencia"), F.lower(court), number, own["anio"]), F.concat_ws("_", own["tipo"], own["numero"], own["anio"]), T.slug(F.col("excel_id"))).alias("doc_id"),
        by(ruling_name(court, number, own["anio"]), F.concat(kind, F.lit(" "), own["numero"], F.lit(" de "), own["anio"]),
           F.trim(F.get(F.split(title, r"\s+·\s+|\s+\("), F.lit(0)))).alias("nombre_citable"),
        "tipo", by(F.concat_ws("-", court, number), own["numero"], in_title(1)).alias("numero"), by(own["anio"], own["anio"], in_title(2)).alias("anio"),
        by(court_name, made_by, F.when(F.col("tipo") == "decision_andina", F.lit("Comisión de la Comunidad Andina"))).alias("organo_emisor"))


def matched(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """rows(excel_id, cuerpos, propio) with the ``doc_id`` of existing(doc_id, canonico) they are, null if new.

    A row's own body counts first, then the codes that it names, by name; other norms in its title do not.
    """
    codes = F.array_sort(F.filter("cuerpos", lambda b: b["numero"].isNull()))
    order = F.concat(F.when(F.col("propio").isNotNull(), F.array("propio")).otherwise(F.array().cast("array<struct<tipo:string,numero:string,anio:string>>")), codes)
    keys = rows.select("excel_id", F.posexplode(order).alias("ord", "b")).select("excel_id", "ord", match_key(F.col("b.tipo"), F.col("b.numero"), F.col("b.anio")).alias("key"))
    own = existing.select("doc_id", match_key(F.col("canonico.tipo"), F.col("canonico.numero"), F.col("canonico.anio")).alias("key"))
    best = keys.join(own, "key").groupBy("excel_id").agg(F.min_by("doc_id", F.struct("ord", "doc_id")).alias("doc_id"))
    return rows.join(best, "excel_id", "left")


def classified(rows: DataFrame) -> DataFrame:
    """rows(doc_id, tipo, estado, origen, prioridad, items, clave, es_codigo) with their ``estado``, ``prioridad`` and ``ola``."""
    state = F.when(F.col("tipo").isin(*EXCLUDED_KINDS), F.lit("excluido")).when(F.col("estado").rlike("revisar|verificar"), F.lit("por_verificar")).otherwise(F.lit("pendiente"))
    n = F.coalesce("items", F.lit(0))
    high = F.col("origen").isin("citations.CODES", "sample_50.legal_basis") | (n >= 5)
    priority = F.coalesce("prioridad", F.when(F.coalesce(high, F.lit(False)), F.lit("alta")).when(n >= 2, F.lit("media")).otherwise(F.lit("baja")))
    out = rows.withColumn("estado", state).withColumn("prioridad", priority)
    second = F.col("origen").isin(*WAVE_2_ORIGINS) | (F.col("prioridad") == "alta")
    wave = F.when(F.col("doc_id").isin(*WAVE_0), F.lit(0)).when(F.coalesce(F.col("es_codigo") | F.col("clave").isin(*WAVE_1), F.lit(False)), F.lit(1)).when(
        F.coalesce(second, F.lit(False)), F.lit(2)).otherwise(F.lit(3))
    return out.withColumn("ola", wave)


def owning_area(areas: Column, weights: dict[str, int], default: str = "transversales") -> Column:
    """The known area of the least weight, the first by name of equals; the default without any."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    ranked = F.array_sort(F.transform(F.filter(areas, lambda a: F.map_contains_key(known, a)), lambda a: F.struct(F.element_at(known, a).alias("w"), a.alias("a"))))
    return F.coalesce(F.get(ranked, F.lit(0))["a"], F.lit(default))


def folder_document(files: DataFrame) -> DataFrame:
    """``carpeta`` and ``archivo``: of files(carpeta, archivo, n_fichas) the folder's one document, else the one that its name calls a ruling."""
    docs = files.filter(F.lower("archivo").rlike(r"\.(pdf|docx?)$"))
    called = F.col("archivo").rlike("(?i)SENTENCIA|FALLO") & ~F.col("archivo").rlike("(?i)SALVAMENTO|ACLARACI|AUTO")
    by = docs.groupBy("carpeta").agg(F.count(F.lit(1)).alias("n"), F.max("n_fichas").alias("f"), F.min("archivo").alias("one"), F.count_if(called).alias("c"), F.min(F.when(called, F.col("archivo"))).alias("named"))
    return by.select("carpeta", F.when((F.col("f") == 1) & (F.col("n") == 1), F.col("one")).when(F.col("c") == 1, F.col("named")).alias("archivo")).filter("archivo IS NOT NULL")


def candidate_urls(tipo: Column, cite: Column, name: Column) -> Column:
    """Addresses (url, parser) where a norm may lie, the likeliest first; ``cite`` is its (tipo, numero, anio)."""
    digits = F.lpad(whole_number(cite["numero"]), 4, "0")
    law = F.when(cite["tipo"].isin("ley", "decreto") & cite["numero"].rlike(r"^\d+$"), F.struct(
        F.concat(F.lit(SENATE_SITE), cite["tipo"], F.lit("_"), digits, F.lit("_"), cite["anio"], F.lit(".html")).alias("url"), F.lit("senado").alias("parser")))
    court, number = F.split_part(cite["numero"], F.lit("-"), F.lit(1)), whole_number(F.split_part(cite["numero"], F.lit("-"), F.lit(2)))
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    ruling = F.when((tipo == "sentencia") & (cite["tipo"] == "jurisprudencia") & court.isin(*CONSTITUTIONAL), F.struct(
        F.concat(F.lit(COURT_SITE), cite["anio"], F.lit("/"), court, F.when(court == "SU", F.lit("")).otherwise(F.lit("-")), padded, F.lit("-"), F.substr(cite["anio"], F.lit(3)), F.lit(".htm")).alias("url"),
        F.lit("corte_constitucional").alias("parser")))
    decision = F.regexp_extract(name, r"\b(\d{3})\b", 1)
    andean = F.when((tipo == "decision_andina") & (decision != ""), F.struct(F.concat(F.lit(ANDEAN_SITE), F.lit("DEC"), whole_number(decision), F.lit(".pdf")).alias("url"), F.lit("pdf").alias("parser")))
    return F.array_compact(F.array(law, ruling, andean))


def shows_number(text: Column, cite: Column) -> Column:
    """Whether the head of a text shows the number and year of what was asked for."""
    head = F.substring(text, 1, 60_000)
    court, number = F.split_part(cite["numero"], F.lit("-"), F.lit(1)), whole_number(F.split_part(cite["numero"], F.lit("-"), F.lit(2)))
    ruling = F.concat(F.lit("(?i)"), court, F.lit(r"\s*-?\s*0*"), number, F.lit(r"\s*(?:/|-|de)\s*(?:"), cite["anio"], F.lit("|"), F.substr(cite["anio"], F.lit(3)), F.lit(r")\b"))
    norm = F.concat(F.lit(r"\b0*"), whole_number(cite["numero"]), F.lit(r"\b"))
    return F.when(cite["tipo"] == "jurisprudencia", F.regexp_like(head, ruling)).when(
        cite["numero"].rlike(r"^\d+$"), F.regexp_like(head, norm) & F.contains(head, F.coalesce(cite["anio"], F.lit("")))).otherwise(F.lit(True))


def rejection(status: Column, size: Column, magic: Column, parser: Column, text: Column, cite: Column) -> Column:
    """Why an answer is not the document that was asked for; null if it is."""
    small = size < F.when(parser == "legalize", F.lit(LEAST_MARKDOWN)).otherwise(F.lit(LEAST_BYTES))
    pdf = parser.isin("pdf", "pdf_sentencia", "relatoria_csj")
    marked = F.contains(text, F.lit("<!--Inicio documento-->")) | F.contains(text, F.lit("panel-documento"))
    return (
        F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(small, F.concat(F.lit("muy pequeño ("), size.cast("string"), F.lit(" bytes)")))
        .when(pdf, F.when(magic != "%PDF-", F.lit("no es PDF")))
        .when((parser == "senado") & ~marked, F.lit("sin marcador de documento"))
        .when(~shows_number(text, cite), F.lit("número o año ausentes del contenido"))
    )


def resolved(probes: DataFrame) -> DataFrame:
    """One row for each document of probes(doc_id, ord, url, parser, motivo null if valid): the first valid address, and all tried up to it.

    Addresses without a parser are logged and never win.
    """
    why = F.when(F.col("parser") == "manual", F.lit("fuente sin parser")).otherwise(F.col("motivo"))
    tried = probes.withColumn("why", why)
    first = tried.groupBy("doc_id").agg(F.min(F.when(F.col("why").isNull(), F.col("ord"))).alias("_win"))
    upto = tried.join(first, "doc_id").filter(F.col("_win").isNull() | (F.col("ord") <= F.col("_win")))
    won = F.col("ord") == F.col("_win")
    return upto.groupBy("doc_id").agg(
        F.when(F.max("_win").isNotNull(), F.lit("ok")).otherwise(F.lit("no_encontrado")).alias("estado"),
        F.max(F.when(won, F.col("url"))).alias("url"), F.max(F.when(won, F.col("parser"))).alias("parser"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", F.coalesce("why", F.lit("ok")).alias("motivo")))), lambda x: F.struct(x["url"].alias("url"), x["motivo"].alias("motivo"))).alias("probadas"))


def to_download(resolved_: DataFrame, done: DataFrame) -> DataFrame:
    """Resolved documents(doc_id, url) without a complete download of the same address in done(doc_id, url, completo)."""
    return resolved_.filter("estado = 'ok'").join(done.filter("completo").select("doc_id", "url"), ["doc_id", "url"], "left_anti")


def harvested(court: Column, number: Column, year: Column) -> Column:
    """An inventory row (doc_id, nombre_citable, numero, url) for a ruling found by its number."""
    padded = F.when(F.length(number.cast("string")) < 3, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    short = F.lpad((year % 100).cast("string"), 2, "0")
    name = F.concat(court, F.lit("-"), number.cast("string"))
    return F.struct(
        F.concat_ws("_", F.lit("sentencia"), F.lower(court), number.cast("string"), year.cast("string")).alias("doc_id"),
        F.concat(F.lit("Sentencia "), name, F.lit(" de "), year.cast("string")).alias("nombre_citable"), name.alias("numero"),
        F.concat(F.lit(COURT_SITE), year.cast("string"), F.lit("/"), court, F.when(court == "SU", F.lit("")).otherwise(F.lit("-")), padded, F.lit("-"), short, F.lit(".htm")).alias("url"))


def natural_order(numero: Column, anio: Column) -> list[Column]:
    """Order of rulings: year, court, number."""
    return [anio.cast("int"), F.array_position(F.array(*map(F.lit, CONSTITUTIONAL)), F.split_part(numero, F.lit("-"), F.lit(1))), F.split_part(numero, F.lit("-"), F.lit(2)).cast("int")]


def upserted(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of both, the new one where a key is in both; of several new ones the last by ``ord``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("ord") if "ord" in both.columns else F.lit(0))
    return both.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n", "_new")


def unique_key(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows``; a key that comes twice is an error when they are computed."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("_n")


# -- inventory files ------------------------------------------------------------------------------------------------------------------------


def emitted(head: str, rows: Iterable[dict]) -> str:
    """An inventory file: its head, then each row's keys in the fixed order, others by name, values in JSON (which is YAML)."""
    out = [head.rstrip("\n"), "documentos:"]
    for row in rows:
        shown = {k: v for k, v in row.items() if not k.startswith("_")}
        names = sorted(shown, key=lambda k: (KEYS.index(k) if k in KEYS else len(KEYS), k))
        out += [f"{'  - ' if i == 0 else '    '}{k}: {json.dumps(shown[k], ensure_ascii=False)}" for i, k in enumerate(names)]
    return "\n".join(out) + "\n"


def parsed(text: str) -> tuple[str, list[dict]]:
    """Head and rows of an inventory file as ``emitted`` writes them."""
    head, _, body = text.partition("documentos:")
    rows: list[dict] = []
    for line in filter(str.strip, body.splitlines()):
        if line.startswith("  - "):
            rows.append({})
        name, _, value = line[4:].partition(": ")
        rows[-1][name.strip()] = json.loads(value)
    return head, rows


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archivo, fila as JSON, doc_id) of all inventory files below ``path``; a doc_id in two rows is an error."""
    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            found = [(p, json.dumps(r, ensure_ascii=False), r["doc_id"]) for p, t in zip(batch["path"], batch["value"], strict=True) for r in parsed(t)[1]]
            yield pd.DataFrame(found, columns=["archivo", "fila", "doc_id"])

    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("path"))
    return unique_key(files.mapInPandas(rows, "archivo string, fila string, doc_id string"))


def probe_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, url, parser) to try for docs(doc_id, tipo, nombre, canonico, url): the given address alone, else the candidates."""
    given = F.array(F.struct(F.trim("url").alias("url"), parser_of(F.trim("url")).alias("parser")))
    plan = F.when(F.trim(F.coalesce("url", F.lit(""))) != "", given).otherwise(candidate_urls(F.col("tipo"), F.col("canonico"), F.col("nombre")))
    return docs.select("doc_id", F.posexplode(plan).alias("ord", "c")).select("doc_id", "ord", "c.url", "c.parser")
