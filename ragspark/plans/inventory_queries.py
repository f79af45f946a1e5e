"""Queries of the inventory; its rows are made from ``part`` and ``orders``, the same way in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import inventory as N
from ragspark.plans.registry import query, table



def key():
    return F.col("o_orderkey")


def customer():
    return F.col("o_custkey")


SQL = """o AS (SELECT o_orderkey AS k, o_custkey % 90 + 1 AS n, year(o_orderdate)::varchar AS y, o_orderkey % 4 AS f FROM orders)"""


def ids(spark, d):
    """excel ids of laws, resolutions, rulings and other documents."""
    n, y = (customer() % 90 + 1).cast("string"), F.year("o_orderdate").cast("string")
    out = F.array(F.concat(F.lit("ley_0"), n, F.lit("_"), y), F.concat(F.lit("resolucion_"), n, F.lit("_"), y), F.concat(F.lit("sentencia_su-"), n, F.lit("_"), y), F.concat(F.lit("Guía "), n))
    return table(spark, d, "orders").select(key().alias("k"), n.alias("n"), y.alias("y"), F.get(out, (key() % 4).cast("int")).alias("excel_id"))


@query(f"""WITH {SQL} SELECT k, CASE f WHEN 0 THEN 'Ley ' || n || ' de ' || y WHEN 1 THEN 'Resolución ' || n || ' de ' || y WHEN 2 THEN 'Sentencia SU-' || n || ' de ' || y END AS cita FROM o""")
def cite_of_id(spark, d):
    """H02."""
    return ids(spark, d).select("k", N.cite_of_id(F.col("excel_id")).alias("cita"))


def _rows(spark, d):
    title = F.when(key() % 4 == 3, F.concat(F.lit("Guía del "), F.col("n"), F.lit(" de "), F.col("y"), F.lit(" (anexo)"))).otherwise(F.lit("Título"))
    r = ids(spark, d).withColumnRenamed("k", "o_orderkey").withColumn("titulo", title).withColumn("tipo", F.when(key() % 4 == 3, "doctrina").otherwise("norma"))
    return N.bodies_of_row(r)


@query(f"""WITH {SQL} SELECT k, CASE f WHEN 0 THEN 'ley/' || n || '/' || y WHEN 1 THEN 'resolucion/' || n || '/' || y WHEN 2 THEN 'jurisprudencia/SU-' || n || '/' || y END AS propio FROM o""")
def own_body(spark, d):
    """The row's own body, where its id names one."""
    p = F.col("propio")
    return _rows(spark, d).select(key().alias("k"), F.when(p.isNotNull(), F.concat_ws("/", p["tipo"], p["numero"], p["anio"])).alias("propio"))


@query(f"""WITH {SQL} SELECT k, CASE f WHEN 0 THEN 'ley_' || n || '_' || y WHEN 1 THEN 'resolucion_' || n || '_' || y WHEN 2 THEN 'sentencia_su_' || n || '_' || y ELSE 'guia_' || n END AS doc_id,
CASE f WHEN 0 THEN 'Ley ' || n || ' de ' || y WHEN 1 THEN 'Resolución ' || n || ' de ' || y WHEN 2 THEN 'Sentencia SU-' || lpad(n::varchar, 3, '0') || ' de ' || y ELSE 'Guía del ' || n || ' de ' || y END AS nombre_citable,
CASE f WHEN 2 THEN 'SU-' || n ELSE n::varchar END AS numero, CASE f WHEN 0 THEN 'Congreso de la República' WHEN 2 THEN 'Corte Constitucional' END AS organo_emisor FROM o""")
def new_inventory_rows(spark, d):
    """Rulings, numbered norms and others as inventory rows."""
    return N.new_rows(_rows(spark, d).withColumnRenamed("o_orderkey", "k"), ("k",)).drop("tipo", "anio")


@query(f"""WITH {SQL}, e AS (SELECT min(k) AS doc_id, n, y, f FROM o WHERE k % 3 = 0 GROUP BY n, y, f) SELECT k, e.doc_id FROM o LEFT JOIN e ON o.n = e.n AND o.y = e.y AND o.f = e.f AND o.f <> 3""")
def inventory_match(spark, d):
    """H01 (with its corrections), J04: rows matched by their own body, whatever zeros the number has."""
    rows = _rows(spark, d).select(key().cast("string").alias("excel_id"), "cuerpos", "propio", "n")
    old = rows.filter("excel_id % 3 = 0 AND propio IS NOT NULL").select(F.col("excel_id").cast("long").alias("id"), "propio", "n")
    padded = F.struct(F.col("propio.tipo").alias("tipo"), F.when(F.col("propio.tipo") == "ley", F.concat(F.lit("0"), "propio.numero")).otherwise(F.col("propio.numero")).alias("numero"),
                      F.col("propio.anio").alias("anio"))
    existing = old.groupBy("propio").agg(F.min("id").alias("doc_id")).select("doc_id", padded.alias("canonico"))
    return N.matched(rows, existing).select(F.col("excel_id").cast("long").alias("k"), "doc_id")


@query("""WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'doctrina' ELSE 'ley' END AS tipo, CASE p_partkey % 3 WHEN 0 THEN 'por revisar' ELSE 'identificado' END AS e,
 CASE p_partkey % 7 WHEN 0 THEN 'seed_targets' ELSE 'xlsx' END AS origen, CASE p_partkey % 4 WHEN 0 THEN 'media' END AS p, p_size % 8 AS items, p_partkey % 11 = 0 AS code FROM part),
c AS (SELECT *, coalesce(p, CASE WHEN items >= 5 THEN 'alta' WHEN items >= 2 THEN 'media' ELSE 'baja' END) AS prioridad FROM r)
SELECT k, CASE WHEN tipo = 'doctrina' THEN 'excluido' WHEN e = 'por revisar' THEN 'por_verificar' ELSE 'pendiente' END AS estado, prioridad,
CASE WHEN k = 1 THEN 0 WHEN code OR k = 80 THEN 1 WHEN origen = 'seed_targets' OR prioridad = 'alta' THEN 2 ELSE 3 END::bigint AS ola FROM c""")
def inventory_classes(spark, d):
    """State, priority and wave."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("k"), F.when(k == 1, "constitucion").otherwise(F.concat(F.lit("d"), k.cast("string"))).alias("doc_id"), F.when(k % 5 == 0, "doctrina").otherwise("ley").alias("tipo"),
        F.when(k % 3 == 0, "por revisar").otherwise("identificado").alias("estado"), F.when(k % 7 == 0, "seed_targets").otherwise("xlsx").alias("origen"),
        F.when(k % 4 == 0, "media").alias("prioridad"), (F.col("p_size") % 8).alias("items"), F.when(k == 80, "ley/80/1993").otherwise("ley/1/1900").alias("clave"), (k % 11 == 0).alias("es_codigo"))
    return N.classified(rows).select("k", "estado", "prioridad", "ola")


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'laboral' WHEN p_partkey % 3 = 1 THEN 'civil' ELSE 'transversales' END AS area FROM part""")
def owning_area(spark, d):
    """H07."""
    k = F.col("p_partkey")
    areas = F.when(k % 3 == 0, F.array(F.lit("penal"), F.lit("laboral"))).when(k % 3 == 1, F.array(F.lit("civil"), F.lit("otra"))).otherwise(F.array(F.lit("otra")))
    return table(spark, d, "part").select(k.alias("k"), N.owning_area(areas, {"penal": 123, "civil": 102, "laboral": 87}).alias("area"))


@query("""WITH f AS (SELECT l_orderkey AS carpeta, l_linenumber AS i, CASE l_linenumber WHEN 1 THEN 'SENTENCIA ' ELSE 'anexo ' END || l_linenumber || CASE l_partkey % 3 WHEN 0 THEN '.txt' ELSE '.pdf' END AS a, l_partkey % 3 AS m FROM lineitem),
g AS (SELECT carpeta, count(*) AS n, min(a) AS one, count(*) FILTER (WHERE i = 1) AS c, min(a) FILTER (WHERE i = 1) AS named FROM f WHERE m <> 0 GROUP BY carpeta)
SELECT carpeta, CASE WHEN n = 1 THEN one ELSE named END AS archivo FROM g WHERE n = 1 OR c = 1""")
def folder_document(spark, d):
    """H08."""
    n = F.col("l_linenumber")
    name = F.concat(F.when(n == 1, "SENTENCIA ").otherwise("anexo "), n.cast("string"), F.when(F.col("l_partkey") % 3 == 0, ".txt").otherwise(".pdf"))
    return N.folder_document(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("carpeta"), name.alias("archivo"), F.lit(1).alias("n_fichas")))


@query(f"""WITH {SQL} SELECT k, 0::bigint AS ord, CASE f WHEN 0 THEN 'http://www.secretariasenado.gov.co/senado/basedoc/ley_' || lpad(n::varchar, 4, '0') || '_' || y || '.html'
 WHEN 2 THEN 'https://www.corteconstitucional.gov.co/relatoria/' || y || '/SU' || lpad(n::varchar, 3, '0') || '-' || y[3:] || '.htm'
 ELSE 'https://www.comunidadandina.org/StaticFiles/DocOf/DEC486.pdf' END AS url, CASE f WHEN 0 THEN 'senado' WHEN 2 THEN 'corte_constitucional' ELSE 'pdf' END AS parser FROM o WHERE f <> 1""")
def candidate_urls(spark, d):
    """Where norms may lie."""
    rows = _rows(spark, d).select(
        key().alias("k"), key().cast("string").alias("doc_id"), F.when(key() % 4 == 2, "sentencia").when(key() % 4 == 3, "decision_andina").otherwise("ley").alias("tipo"),
        F.when(key() % 4 == 3, "Decisión 486").otherwise("x").alias("nombre"), F.when(key() % 4 != 3, F.col("propio")).alias("canonico"), F.lit("").alias("url"))
    return N.probe_plan(rows).select(F.col("doc_id").cast("long").alias("k"), "ord", "url", "parser")


@query("""WITH p AS (SELECT page_id, page_id % 6 AS f, length(html) AS n FROM pages)
SELECT page_id, CASE f WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'muy pequeño (100 bytes)' WHEN 2 THEN 'no es PDF' WHEN 3 THEN 'sin marcador de documento' WHEN 4 THEN 'número o año ausentes del contenido' END AS motivo FROM p""")
def validated_answers(spark, d):
    """Status, size, kind, marker and number of what an address answered."""
    f, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    text = F.when(f == 3, "LEY 80 DE 1993").when(f == 4, F.lit("<!--Inicio documento--> LEY 81 DE 1993")).otherwise(F.lit("<!--Inicio documento--> LEY 080 DE 1993"))
    cite = F.struct(F.lit("ley").alias("tipo"), F.lit("80").alias("numero"), F.lit("1993").alias("anio"))
    why = N.rejection(F.when(f == 0, 404).otherwise(200), F.when(f == 1, 100).otherwise(20_000), F.when(f == 2, "<html").otherwise("%PDF-"), F.when(f == 2, "pdf").otherwise("senado"), text, cite)
    return table(spark, d, "pages").select("page_id", why.alias("motivo"))


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, 'u' || l_linenumber AS url, CASE WHEN l_partkey % 5 = 0 THEN 'manual' ELSE 'senado' END AS parser, CASE WHEN l_suppkey % 3 <> 0 THEN 'HTTP 404' END AS m FROM lineitem),
w AS (SELECT doc_id, min(ord) FILTER (WHERE parser <> 'manual' AND m IS NULL) AS win FROM p GROUP BY doc_id),
t AS (SELECT p.*, win, CASE WHEN parser = 'manual' THEN 'fuente sin parser' ELSE coalesce(m, 'ok') END AS why FROM p JOIN w USING (doc_id) WHERE win IS NULL OR ord <= win)
SELECT doc_id, CASE WHEN win IS NULL THEN 'no_encontrado' ELSE 'ok' END AS estado, max(url) FILTER (WHERE ord = win) AS url, string_agg(url || '=' || why, ',' ORDER BY ord, url, why) AS log FROM t GROUP BY doc_id, win""")
def resolved_addresses(spark, d):
    """The first address that holds, and the log of what was tried."""
    probes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("url"),
        F.when(F.col("l_partkey") % 5 == 0, "manual").otherwise("senado").alias("parser"), F.when(F.col("l_suppkey") % 3 != 0, "HTTP 404").alias("motivo"))
    log = F.array_join(F.transform("probadas", lambda x: F.concat(x["url"], F.lit("="), x["motivo"])), ",")
    return N.resolved(probes).select("doc_id", "estado", "url", log.alias("log"))


@query("SELECT o_orderkey AS doc_id, 'u' || (o_custkey % 5) AS url FROM orders WHERE o_orderkey % 4 <> 0 AND NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AND o_custkey % 5 = 1)")
def downloads_left(spark, d):
    """What is complete under the same address is not fetched again."""
    rows = table(spark, d, "orders").select(key().alias("doc_id"), F.concat(F.lit("u"), (customer() % 5).cast("string")).alias("url"), F.when(key() % 4 == 0, "no_encontrado").otherwise("ok").alias("estado"), "o_custkey")
    done = rows.filter("doc_id % 3 = 0").select("doc_id", F.lit("u1").alias("url"), (F.col("o_custkey") % 2 == 0).alias("completo"))
    return N.to_download(rows, done).select("doc_id", "url")


@query("""SELECT o_orderkey AS k, 'sentencia_' || lower(s) || '_' || n || '_' || y AS doc_id, 'https://www.corteconstitucional.gov.co/relatoria/' || y || '/' || s || CASE s WHEN 'SU' THEN '' ELSE '-' END || lpad(n::varchar, greatest(3, len(n::varchar))::int, '0') || '-' || lpad((y % 100)::varchar, 2, '0') || '.htm' AS url
FROM (SELECT o_orderkey, ['C', 'T', 'SU'][o_orderkey % 3 + 1] AS s, o_custkey AS n, year(o_orderdate) + 8 AS y FROM orders)""")
def harvested_rows(spark, d):
    """Rows and addresses of rulings found by number."""
    court = F.get(F.array(F.lit("C"), F.lit("T"), F.lit("SU")), (key() % 3).cast("int"))
    return table(spark, d, "orders").select(key().alias("k"), N.harvested(court, customer(), F.year("o_orderdate") + 8).alias("r")).select("k", "r.doc_id", "r.url")


@query("""SELECT row_number() OVER (ORDER BY y, k % 3, n) AS pos, ['C', 'T', 'SU'][k % 3 + 1] || '-' || n AS numero, y AS anio FROM (SELECT DISTINCT o_custkey % 40 AS n, year(o_orderdate)::varchar AS y, o_orderkey % 3 AS k FROM orders)""")
def natural_order(spark, d):
    """Rulings by year, court and number, numbered without a global window."""
    from ragspark.operators.segment import dense_ids

    court = F.get(F.array(F.lit("C"), F.lit("T"), F.lit("SU")), (key() % 3).cast("int"))
    rows = table(spark, d, "orders").select(F.concat(court, F.lit("-"), (customer() % 40).cast("string")).alias("numero"), F.year("o_orderdate").cast("string").alias("anio")).distinct()
    for name, c in zip(("_y", "_c", "_n"), N.natural_order(F.col("numero"), F.col("anio")), strict=True):
        rows = rows.withColumn(name, c)
    return dense_ids(rows, ["_y", "_c", "_n"], "pos").select((F.col("pos") + 1).alias("pos"), "numero", "anio")


@query("""SELECT o_custkey AS doc_id, arg_max(o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 1000000000 ELSE 0 END + o_orderkey) AS v FROM orders GROUP BY o_custkey""")
def upserted_rows(spark, d):
    """New rows take the place of old ones."""
    rows = table(spark, d, "orders").select(customer().alias("doc_id"), key().alias("v"), key().alias("ord"))
    return N.upserted(rows.filter("v % 2 = 0"), rows.filter("v % 2 = 1")).select("doc_id", "v")
