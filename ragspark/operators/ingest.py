"""Ingest: inventory, candidate addresses, validation, harvest rule, dedupe, resume and manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import text as T
from ragspark.sources.storage import stored

#: Address parts and the parser that reads what lies there; the first that fits counts.
PARSERS = (
    (("secretariasenado.gov.co", "cancilleria.gov.co/normograma", "normograma.dian.gov.co"), "senado"),
    (("corteconstitucional.gov.co",), "corte_constitucional"),
    (("funcionpublica.gov.co/eva/gestornormativo",), "funcion_publica"),
    (("raw.githubusercontent.com/legalize-dev/",), "legalize"),
    (("cortesuprema.gov.co",), "pdf_sentencia"),
)
#: Host endings and the source's name.
HOST_SOURCES = (
    ("secretariasenado.gov.co", "Secretaría del Senado"),
    ("corteconstitucional.gov.co", "Relatoría de la Corte Constitucional"),
    ("cortesuprema.gov.co", "Relatoría de la Corte Suprema de Justicia"),
    ("funcionpublica.gov.co", "Función Pública (Gestor Normativo)"),
    ("comunidadandina.org", "Comunidad Andina"),
    ("cancilleria.gov.co", "Cancillería (normograma)"),
    ("normograma.dian.gov.co", "DIAN (normograma)"),
    ("raw.githubusercontent.com", "SUIN-Juriscol (vía legalize-co)"),
    ("samai.consejodeestado.gov.co", "SAMAI (Consejo de Estado)"),
    ("superfinanciera.gov.co", "Superintendencia Financiera de Colombia"),
    ("alcaldiabogota.gov.co", "Alcaldía de Bogotá (SISJUR)"),
    ("suin-juriscol.gov.co", "SUIN-Juriscol"),
)


def parser_of(url: Column) -> Column:
    out = F.when(F.lower(url).endswith(".pdf"), F.lit("pdf")).otherwise(F.lit("manual"))
    for parts, name in reversed(PARSERS):
        test = F.lit(False)
        for part in parts:
            test = test | url.contains(part)
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def source_of(url: Column, declared: Column, endings=HOST_SOURCES) -> Column:
    """Name of the first host ending that fits the address, else the declared one."""
    out = declared
    for ending, name in reversed(endings):
        out = F.when(T.host(url).endswith(ending), F.lit(name)).otherwise(out)
    return out


def selected(docs: DataFrame, waves: list[int] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Inventory rows to work on: by id or wave; excluded ones never, unverified ones only by id; in order."""
    wanted = F.col("estado") != "excluido"
    if ids:
        wanted = wanted & F.col("doc_id").isin(ids)
    else:
        wanted = wanted & (F.col("estado") != "por_verificar")
        if waves:
            wanted = wanted & F.col("ola").isin(waves)
    return docs.filter(wanted).withColumn("orden", F.coalesce("ola", F.lit(9)))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_valid(candidates: DataFrame, valid: Column, keys: list[str]) -> DataFrame:
    """The first candidate by ``ord`` that is valid, and ``intentos``, how many were tried."""
    ok = candidates.withColumn("_ok", valid)
    first = ok.groupBy(*keys).agg(F.min(F.when(F.col("_ok"), F.col("ord"))).alias("_first"))
    return ok.join(first, keys).filter(F.col("ord") == F.col("_first")).withColumn("intentos", F.col("ord")).drop("_ok", "_first")


def until_gap(space: DataFrame, keys: list[str], number: str, hit: str, misses: int) -> DataFrame:
    """Numbers in order until ``misses`` in a row had no hit."""
    seen = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.coalesce(F.last(F.when(F.col(hit), F.col(number)), ignorenulls=True).over(seen), F.min(number).over(seen) - 1)
    stop = F.max((F.col("_away") >= misses).cast("int")).over(Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1))
    return space.withColumn("_away", F.col(number) - last).withColumn("_stop", F.coalesce(stop, F.lit(0))).filter("_stop = 0").drop("_away", "_stop")


def deduplicated(rows: DataFrame, text: str, key: str) -> DataFrame:
    """The first row by key of each content, with the content's hash and number of copies."""
    return rows.groupBy(F.sha2(text, 256).alias("sha256")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copias"))


def pending(questions: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Questions that no finished log row answers."""
    return questions.join(done.select(key).distinct(), key, "left_anti")


def reconciled(submissions: DataFrame, traces: DataFrame, key: str = "id") -> DataFrame:
    """Submissions whose id is in both logs."""
    return submissions.join(traces.select(key).distinct(), key, "left_semi")


def readable_prefix(lines: DataFrame, keys: list[str], order: str, good: Column) -> DataFrame:
    """Log rows up to the first that cannot be read."""
    bad = F.max((~good).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def waves_report(rows: DataFrame) -> DataFrame:
    """rows(ola, con_url, descargado, peso): counts by wave and the weighted coverage."""
    return rows.groupBy("ola").agg(
        F.count(F.lit(1)).alias("documentos"),
        F.count_if("con_url").alias("con_url"),
        F.count_if("descargado").alias("descargados"),
        F.round(F.try_divide(F.sum(F.when(F.col("descargado"), F.col("peso")).otherwise(0)), F.sum("peso")), 4).alias("cobertura"),
    )


def manifest(fragments: DataFrame, downloads: DataFrame) -> DataFrame:
    """One row per document: fragments, characters and what is known of the download."""
    sums = fragments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fragmentos"), F.sum(F.length("texto")).cast("long").alias("caracteres"))
    return sums.join(downloads, "doc_id", "left")


def inventory_key(kind: Column, number: Column, year: Column) -> Column:
    """Match key of an inventory row: kind, number without leading zeros, year."""
    return F.concat_ws("/", kind, F.regexp_replace(number, "^0+(?=[0-9])", ""), year)


def year_range(spec: Column) -> Column:
    """Years of "2015" or "2015-2020"."""
    first, last = F.regexp_extract(spec, r"^(\d{4})", 1).cast("int"), F.regexp_extract(spec, r"(\d{4})$", 1).cast("int")
    return F.sequence(first, last)


def chained(starts: DataFrame, links: DataFrame, most: int = 400) -> DataFrame:
    """Pages that starts(doc_id, url) reach over links(url, next), with their ``paso``; a page that was seen ends a chain, as do ``most`` pages."""
    edges = stored(links.filter("next IS NOT NULL").select("url", "next"), "links")
    first = starts.select("doc_id", "url", F.lit(0).alias("paso"), F.array("url").alias("seen"))
    levels = [stored(first, "chain")]
    # Each step is one join over the chains that still go on, so no number of pages is a limit.
    while len(levels) < most:
        on = levels[-1].join(edges, "url").filter(~F.array_contains("seen", F.col("next"))).select(
            "doc_id", F.col("next").alias("url"), (F.col("paso") + 1).alias("paso"), F.array_append("seen", F.col("next")).alias("seen"))
        level = stored(on, "chain")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, [level.select("doc_id", "url", "paso") for level in levels])
