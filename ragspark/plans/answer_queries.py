"""Queries of citations, verification, answers and scores.

Citation text is written from ``orders``, the same way in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import citations as C
from ragspark.functions import text as T
from ragspark.operators import answers as A
from ragspark.operators import evaluation as E
from ragspark.operators.retrieval import beside
from ragspark.plans import ranking_queries as K
from ragspark.plans import retrieval_queries as V
from ragspark.plans.registry import query, table

CITES_SQL = """cites AS (SELECT o_orderkey, o_custkey, 'Art. ' || (o_orderkey % 90 + 1) || ' de la Ley ' || (o_custkey % 97 + 100) || ' de ' || year(o_orderdate) AS t,
  (o_custkey % 97 + 100) || '/' || year(o_orderdate) AS body FROM orders)"""


def cites(spark, d):
    o = table(spark, d, "orders")
    law, year = (F.col("o_custkey") % 97 + 100).cast("string"), F.year("o_orderdate").cast("string")
    text = F.concat(F.lit("Art. "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" de la Ley "), law, F.lit(" de "), year)
    return o.select("o_orderkey", "o_custkey", text.alias("t"))


@query(f"WITH {CITES_SQL} SELECT o_orderkey, body FROM cites")
def citations_extract_simple(spark, d):
    """C01 (laws), C07: patterns of the JVM."""
    return cites(spark, d).select("o_orderkey", F.array_join(C.simple_law_citations(F.col("t")), ",").alias("body"))


@query(f"""WITH {CITES_SQL} SELECT o_orderkey, 'ley' AS tipo, split_part(body, '/', 1) AS numero, split_part(body, '/', 2) AS anio,
(o_orderkey % 90 + 1)::varchar AS articulo FROM cites""")
def citations_extract_full(spark, d):
    """The whole rule, with the article before its law."""
    found = cites(spark, d).select("o_orderkey", F.explode(C.article_level(C.citations(F.col("t")))).alias("c"))
    return found.select("o_orderkey", "c.tipo", "c.numero", "c.anio", "c.articulo")


FORMS_SQL = """forms AS (SELECT o_orderkey, o_orderkey % 8 AS k, (o_custkey % 97 + 100)::varchar AS n, year(o_orderdate)::varchar AS y, (o_orderkey % 90 + 1)::varchar AS a,
 (o_custkey % 40 + 1)::varchar AS b FROM orders)"""


def forms(spark, d):
    """Texts of eight forms, by order: list of articles, alias, code before and after, ruling with two and four digits, two norms, nothing."""
    o = table(spark, d, "orders")
    n, y = (F.col("o_custkey") % 97 + 100).cast("string"), F.year("o_orderdate").cast("string")
    a, b = (F.col("o_orderkey") % 90 + 1).cast("string"), (F.col("o_custkey") % 40 + 1).cast("string")
    texts = F.array(
        F.concat(F.lit("Artículos "), a, F.lit(", "), b, F.lit(" y 200a de la Ley "), n, F.lit(" de "), y),
        F.concat(F.lit("La Ley 599 de 2000, art. "), a, F.lit(", rige")),
        F.concat(F.lit("el artículo "), a, F.lit(" del Código Penal")),
        F.concat(F.lit("Sentencia C-0"), b, F.lit(" de "), y),
        F.concat(F.lit("según la SU-"), b, F.lit("/"), F.substr(y, F.lit(3), F.lit(2))),
        F.concat(F.lit("DECRETO LEY "), n, F.lit(" DE "), y, F.lit(" y la ley 1437")),
        F.concat(F.lit("Art. "), a, F.lit(". La Resolución N° "), n, F.lit(" de "), y),
        F.concat(F.lit("La ley "), n, F.lit(" rige desde el artículo "), a),
    )
    return o.select("o_orderkey", F.get(texts, (F.col("o_orderkey") % 8).cast("int")).alias("t"))


@query(f"""WITH {FORMS_SQL}, c AS (
SELECT o_orderkey, 'ley' AS tipo, n AS numero, y AS anio, unnest(list_distinct([a, b, '200a'])) AS articulo FROM forms WHERE k = 0
UNION ALL SELECT o_orderkey, 'codigo_penal', NULL, NULL, a FROM forms WHERE k IN (1, 2)
UNION ALL SELECT o_orderkey, 'jurisprudencia', CASE k WHEN 3 THEN 'C-' ELSE 'SU-' END || b, y, NULL FROM forms WHERE k IN (3, 4)
UNION ALL SELECT o_orderkey, 'decreto', n, y, NULL FROM forms WHERE k = 5
UNION ALL SELECT o_orderkey, 'cpaca', NULL, NULL, NULL FROM forms WHERE k = 5
UNION ALL SELECT o_orderkey, 'resolucion', n, y, NULL FROM forms WHERE k = 6)
SELECT * FROM c""")
def citations_extract_codes(spark, d):
    """Lists, aliased laws, codes, rulings with short years, stops between article and norm."""
    found = forms(spark, d).select("o_orderkey", F.explode(C.citations(F.col("t"))).alias("c"))
    return found.select("o_orderkey", "c.tipo", "c.numero", "c.anio", "c.articulo")


@query("""WITH q AS (SELECT o_orderkey AS qid, o_orderkey % 4 AS k, (o_custkey % 97 + 100)::varchar AS n, (o_orderkey % 50 + 1)::varchar AS a, year(o_orderdate)::varchar AS y FROM orders)
SELECT qid, 'ley' AS tipo, n AS numero, y AS anio, a || '-1' AS articulo FROM q WHERE k = 0
UNION ALL SELECT qid, 'ley', n, y, '2.2.' || a FROM q WHERE k = 1
UNION ALL SELECT qid, 'constitucion', NULL, NULL, NULL FROM q WHERE k = 3
UNION ALL SELECT qid, 'ley', n, y, NULL FROM q WHERE k IN (1, 2)""")
def query_citations(spark, d):
    """C18 (compound articles), C19: "constitución" alone is no citation of a question."""
    o = table(spark, d, "orders")
    n, y, a = (F.col("o_custkey") % 97 + 100).cast("string"), F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 50 + 1).cast("string")
    law = F.concat(F.lit("la Ley "), n, F.lit(" de "), y)
    texts = F.array(F.concat(F.lit("artículo "), a, F.lit("-1 de "), law), F.concat(law, F.lit(" en sus normas. El artículo 2.2."), a),
                    F.concat(F.lit("la constitución de la sociedad según "), law), F.lit("la Constitución Política"))
    found = o.select(F.col("o_orderkey").alias("qid"), F.explode(C.query_citations(F.get(texts, (F.col("o_orderkey") % 4).cast("int")))).alias("c"))
    return found.select("qid", "c.tipo", "c.numero", "c.anio", "c.articulo")


@query("""WITH r AS (SELECT DISTINCT 'C-' || (o_custkey % 300 + 1) AS numero, (1992 + o_orderkey % 2 * (o_custkey % 3))::varchar AS anio FROM orders),
one AS (SELECT numero, min(anio) AS anio FROM r GROUP BY numero HAVING count(*) = 1),
q AS (SELECT o_orderkey AS qid, 'C-' || (o_orderkey % 400 + 1) AS numero FROM orders WHERE o_orderkey % 3 <> 0)
SELECT qid, 'jurisprudencia' AS tipo, numero, anio FROM q JOIN one USING (numero)""")
def yearless_rulings(spark, d):
    """Rulings named without a year count where only one has that number."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rulings = o.select(F.concat(F.lit("C-"), (F.col("o_custkey") % 300 + 1).cast("string")).alias("numero"), (F.lit(1992) + k % 2 * (F.col("o_custkey") % 3)).cast("string").alias("anio"))
    number = (k % 400 + 1).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("la C-"), number, F.lit(" de 1992"))).when(k % 3 == 1, F.concat(F.lit("la sentencia c-00"), number, F.lit(" dice"))).otherwise(F.concat(F.lit("C - "), number))
    return C.yearless_rulings(o.select(k.alias("qid"), text.alias("text")), rulings)


@query(f"""WITH {FORMS_SQL}, b AS (SELECT o_orderkey, 'Ley ' || n || ' de ' || y AS nombre FROM forms WHERE k = 0 UNION ALL SELECT o_orderkey, 'Código Penal' FROM forms WHERE k IN (1, 2)
UNION ALL SELECT o_orderkey, 'Sentencia ' || CASE k WHEN 3 THEN 'C-' ELSE 'SU-' END || b || ' de ' || y FROM forms WHERE k IN (3, 4)
UNION ALL SELECT o_orderkey, 'Decreto ' || n || ' de ' || y FROM forms WHERE k = 5
UNION ALL SELECT o_orderkey, 'Código de Procedimiento Administrativo y de lo Contencioso Administrativo' FROM forms WHERE k = 5
UNION ALL SELECT o_orderkey, 'Resolución ' || n || ' de ' || y FROM forms WHERE k = 6) SELECT o_orderkey, nombre FROM b""")
def checked_names(spark, d):
    """The written form of each body, where it is read back as that body alone."""
    found = forms(spark, d).select("o_orderkey", F.explode(C.bodies(C.citations(F.col("t")))).alias("b"))
    return found.select("o_orderkey", C.checked_name(F.col("b.tipo"), F.col("b.numero"), F.col("b.anio")).alias("nombre"))


@query(f"""WITH {FORMS_SQL}, b AS (SELECT o_orderkey, 'Ley ' || n || ' de ' || y || ', art. ' || unnest(list_distinct([a, b, '200a'])) AS nombre FROM forms WHERE k = 0
UNION ALL SELECT o_orderkey, 'Código Penal, art. ' || a FROM forms WHERE k IN (1, 2)
UNION ALL SELECT o_orderkey, 'Sentencia ' || CASE k WHEN 3 THEN 'C-' ELSE 'SU-' END || b || ' de ' || y FROM forms WHERE k IN (3, 4)
UNION ALL SELECT o_orderkey, 'Decreto ' || n || ' de ' || y FROM forms WHERE k = 5
UNION ALL SELECT o_orderkey, 'Código de Procedimiento Administrativo y de lo Contencioso Administrativo' FROM forms WHERE k = 5
UNION ALL SELECT o_orderkey, 'Resolución ' || n || ' de ' || y FROM forms WHERE k = 6) SELECT o_orderkey, nombre FROM b""")
def display_names(spark, d):
    """What a reader is shown for each citation."""
    found = forms(spark, d).select("o_orderkey", F.explode(C.citations(F.col("t"))).alias("c"))
    return found.select("o_orderkey", C.display_name(F.col("c")).alias("nombre"))


@query(f"WITH {CITES_SQL} SELECT o_orderkey, 'Ley ' || split_part(body, '/', 1) || ' de ' || split_part(body, '/', 2) AS nombre FROM cites")
def citation_bodies(spark, d):
    """The written form of each body."""
    found = cites(spark, d).select("o_orderkey", F.explode(C.bodies(C.citations(F.col("t")))).alias("b"))
    return found.select("o_orderkey", C.body_name(F.col("b.tipo"), F.col("b.numero"), F.col("b.anio")).alias("nombre"))


SETS_SQL = """ans AS (SELECT o_custkey % 500 AS id, o_orderkey % 30 AS b FROM orders WHERE o_orderstatus <> 'P'),
ref AS (SELECT l_orderkey % 500 AS id, l_partkey % 30 AS b FROM lineitem),
bk AS (SELECT ps.id, ps.b FROM (SELECT DISTINCT o_custkey % 500 AS id, (o_orderkey + 7) % 30 AS b FROM orders WHERE o_orderkey % 2 = 0) ps),
items AS (SELECT id, r, coalesce(c, []) AS c, coalesce(k, []) AS k FROM (SELECT id, list_sort(list_distinct(list(b))) AS r FROM ref GROUP BY id)
  LEFT JOIN (SELECT id, list_distinct(list(b)) AS c FROM ans GROUP BY id) USING (id) LEFT JOIN (SELECT id, list_distinct(list(b)) AS k FROM bk GROUP BY id) USING (id)),
m AS (SELECT id, len(r) AS n_ref, len(c) AS n_cited, len(list_intersect(r, c)) AS hits, len(list_intersect(list_intersect(r, c), k)) AS backed,
  len(list_filter(c, lambda x: NOT list_contains(k, x))) AS outside FROM items)"""


def items(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    def sets(df, id_, b, name):
        return df.select((id_ % 500).alias("id"), (b % 30).cast("string").alias("b")).groupBy("id").agg(F.collect_set("b").alias(name))
    ref = sets(li, F.col("l_orderkey"), F.col("l_partkey"), "ref")
    cited = sets(o.filter("o_orderstatus <> 'P'"), F.col("o_custkey"), F.col("o_orderkey"), "cited")
    backed = sets(o.filter("o_orderkey % 2 = 0"), F.col("o_custkey"), F.col("o_orderkey") + 7, "backed")
    return ref.join(cited, "id", "left").join(backed, "id", "left")


@query(f"WITH {SETS_SQL} SELECT id, n_ref, n_cited, hits, backed, outside, outside = 0 AS subset FROM m")
def citation_setops(spark, d):
    """C09, U01 to U04."""
    empty = F.array().cast("array<string>")
    c, k = F.coalesce("cited", empty), F.coalesce("backed", empty)
    hits, outside = F.array_intersect("ref", c), F.size(F.array_except(c, k))
    return items(spark, d).select("id", F.size("ref").alias("n_ref"), F.size(c).alias("n_cited"), F.size(hits).alias("hits"),
                                  F.size(F.array_intersect(hits, k)).alias("backed"), outside.alias("outside"), (outside == 0).alias("subset"))


@query(f"""WITH {SETS_SQL}, s AS (SELECT sum(n_ref)::bigint AS n_ref, sum(n_cited)::bigint AS n_citadas, sum(backed)::bigint AS con_respaldo,
sum(hits - backed)::bigint AS sin_respaldo, sum(outside)::bigint AS no_respaldadas FROM m)
SELECT *, round(20 * greatest(0, (con_respaldo + 0.5::double * sin_respaldo) / n_ref - 2 * coalesce(no_respaldadas / n_citadas, 0)), 4) AS puntos FROM s""")
def score_citations(spark, d):
    """E04, A09."""
    return E.citation_score(items(spark, d))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE s.letra = k.correcta) AS aciertos,
round(count(*) FILTER (WHERE s.letra = k.correcta)::double / count(*) * 20, 4) AS puntos
FROM (SELECT o_orderkey AS id, chr((65 + o_custkey % 4)::int) AS correcta FROM orders) k
LEFT JOIN (SELECT o_orderkey AS id, chr((65 + o_orderkey % 4)::int) AS letra FROM orders WHERE o_orderkey % 5 <> 0) s USING (id)""")
def score_closed(spark, d):
    """E03, A08, J10."""
    key, subs = _key(spark, d), _subs(spark, d).select("id", "letra")
    return E.closed_score(key, subs)


def _key(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.chr(65 + F.col("o_custkey") % 4).alias("correcta"))


def _subs(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 5 <> 0")
    return o.select(F.col("o_orderkey").alias("id"), F.chr(65 + F.col("o_orderkey") % 4).alias("letra"), (F.col("o_orderkey") % 7 == 0).alias("abstencion"))


@query("""WITH j AS (SELECT k.id, correcta, letra, coalesce(abstencion, false) AS away, coalesce(letra = correcta, false) AS ok
FROM (SELECT o_orderkey AS id, chr((65 + o_custkey % 4)::int) AS correcta FROM orders) k
LEFT JOIN (SELECT o_orderkey AS id, chr((65 + o_orderkey % 4)::int) AS letra, o_orderkey % 7 = 0 AS abstencion FROM orders WHERE o_orderkey % 5 <> 0) s USING (id)),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT away AND ok) AS tn, count(*) FILTER (WHERE away AND NOT ok) AS tp,
count(*) FILTER (WHERE away AND ok) AS fp, count(*) FILTER (WHERE NOT away AND NOT ok) AS fn FROM j)
SELECT *, round(10 * (tn + 0.5::double * (tp + fp)) / n, 4) AS puntos FROM c""")
def score_abstention(spark, d):
    """E05, A10."""
    return E.abstention_score(_key(spark, d), _subs(spark, d))


@query(f"""WITH {CITES_SQL}, m AS (SELECT o_custkey % 50 AS qid, body, count(*) AS n, min(o_orderkey) AS first FROM cites GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS pos FROM m) SELECT qid, pos, body, n, first FROM r WHERE pos <= 3""")
def mentions_by_frequency(spark, d):
    """C14."""
    from ragspark.operators.ranking import ranked

    found = cites(spark, d).select((F.col("o_custkey") % 50).alias("qid"), "o_orderkey", F.explode(C.simple_law_citations(F.col("t"))).alias("body"))
    m = found.groupBy("qid", "body").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return ranked(m, 3, [F.desc("n"), F.col("first")]).select("qid", "pos", "body", "n", "first")


BACK_SQL = f"""{K.BASE_SQL}, ps AS (SELECT qid, pos, chunk_id % 20 AS body FROM cand),
bk AS (SELECT DISTINCT qid, body FROM ps WHERE pos <= 10), ct AS (SELECT DISTINCT o_custkey AS qid, o_orderkey % 25 AS body FROM orders)"""


def _passages(spark, d):
    return K.cand(spark, d).select("qid", "pos", F.array(F.col("chunk_id") % 20).alias("bodies"))


@query(f"WITH {BACK_SQL} SELECT ct.qid, ct.body, bk.body IS NOT NULL AS respaldada FROM ct LEFT JOIN bk ON ct.qid = bk.qid AND ct.body = bk.body")
def backed_flags(spark, d):
    """C10, C11, H39."""
    backed = A.backing_bodies(_passages(spark, d)).withColumn("respaldada", F.lit(True))
    cited = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 25).alias("body")).distinct()
    return cited.join(backed, ["qid", "body"], "left").withColumn("respaldada", F.coalesce("respaldada", F.lit(False)))


@query(f"""WITH {BACK_SQL}, s AS (SELECT o_custkey AS qid, o_orderkey AS pos, [o_orderkey % 25, o_custkey % 25] AS bodies FROM orders),
x AS (SELECT DISTINCT qid, pos FROM (SELECT qid, pos, unnest(bodies) AS body FROM s) ANTI JOIN bk USING (qid, body))
SELECT s.qid, s.pos, x.qid IS NOT NULL AS removed FROM s LEFT JOIN x USING (qid, pos)""")
def drop_unbacked_sentences(spark, d):
    """V01."""
    s = table(spark, d, "orders").select(
        F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("pos"), F.array(F.col("o_orderkey") % 25, F.col("o_custkey") % 25).alias("bodies"))
    return A.without_unbacked(s, A.backing_bodies(_passages(spark, d))).select("qid", "pos", "removed")


WEAK_SQL = f"""{K.BASE_SQL}, q AS (SELECT c_custkey AS qid, CASE c_custkey % 3 WHEN 0 THEN 'cerrada' WHEN 1 THEN 'semiabierta' ELSE 'abierta' END AS formato FROM customer),
p AS (SELECT qid, score, CASE WHEN chunk_id % 11 = 0 THEN 'lookup' WHEN chunk_id % 7 = 0 THEN 'valores' ELSE 'rerank' END AS fuente FROM cand),
b AS (SELECT qid, max(score) FILTER (WHERE fuente = 'rerank') AS mejor, max((fuente = 'lookup')::int) AS lk FROM p GROUP BY qid),
w AS (SELECT q.qid, formato, mejor, coalesce(formato <> 'cerrada' AND coalesce(lk, 0) = 0 AND mejor < 0.25, false) AS debil FROM q LEFT JOIN b USING (qid))"""


def _weak(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.get(F.array(*map(F.lit, ("cerrada", "semiabierta", "abierta"))), (F.col("c_custkey") % 3).cast("int")).alias("formato"))
    fuente = F.when(F.col("chunk_id") % 11 == 0, "lookup").when(F.col("chunk_id") % 7 == 0, "valores").otherwise("rerank")
    return A.weak_evidence(q, K.cand(spark, d).withColumn("fuente", fuente), 0.25)


@query(f"WITH {WEAK_SQL} SELECT * FROM w")
def weak_evidence(spark, d):
    """R22, V05."""
    return _weak(spark, d).select("qid", "formato", "mejor", "debil")


@query(f"""WITH {WEAK_SQL} SELECT qid, formato <> 'cerrada' AND (debil OR qid % 10 = 0) AS abstencion FROM w""")
def abstention_decision(spark, d):
    """V04, V06."""
    answer = F.when(F.col("qid") % 10 != 0, F.lit("texto")).otherwise(F.lit(" "))
    return A.abstention(_weak(spark, d).withColumn("respuesta", answer).withColumn("insuficiente", F.col("debil"))).select("qid", "abstencion")


@query(f"""WITH {WEAK_SQL} SELECT c.qid, c.pos, c.chunk_id, CASE WHEN debil THEN 2 ELSE 1 END::bigint AS iterations FROM cand c JOIN w USING (qid)
WHERE CASE WHEN debil THEN c.pos <= 3 ELSE c.pos <= 2 END""")
def replan_two_passes(spark, d):
    """V09, V10."""
    c = K.cand(spark, d).select("qid", "pos", "chunk_id")
    return A.two_pass(_weak(spark, d), c.filter("pos <= 2"), c.filter("pos <= 3"))


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey + 1 ELSE o_orderkey END AS id, CASE o_orderkey % 3 WHEN 0 THEN 'cerrada' ELSE 'abierta' END AS formato,
 CASE o_orderkey % 6 WHEN 0 THEN 'E' ELSE 'A' END AS letra, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'x' END AS respuesta, o_orderkey % 18 = 0 AS abst, o_orderkey % 13 AS n FROM orders),
t AS (SELECT *, count(*) OVER (PARTITION BY id) AS times FROM s)
SELECT id, unnest(list_filter([CASE WHEN id % 40 = 0 THEN 'id desconocido' END, CASE WHEN times > 1 THEN 'id repetido' END,
 CASE WHEN formato = 'cerrada' AND letra = 'E' THEN 'letra no valida' END, CASE WHEN NOT abst AND trim(respuesta) = '' THEN 'respuesta vacia' END,
 CASE WHEN n > 10 THEN 'demasiados pasajes' END], lambda x: x IS NOT NULL)) AS error FROM t
UNION ALL SELECT DISTINCT o_orderkey, 'sin entrega' FROM orders WHERE o_orderkey % 40 <> 0 AND o_orderkey NOT IN (SELECT id FROM s)""")
def validate_submission(spark, d):
    """V11 and V12 (ids both ways, letters, empty answers, number of passages, finite scores), J12."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    subs = o.select(F.when(k % 50 == 1, k + 1).otherwise(k).alias("id"), F.when(k % 3 == 0, "cerrada").otherwise("abierta").alias("formato"),
                    F.when(k % 6 == 0, "E").otherwise("A").alias("letra"), F.when(k % 9 == 0, " ").otherwise("x").alias("respuesta"),
                    (k % 18 == 0).alias("abstencion"), (k % 13).alias("n_pasajes"), F.lit(0.5).alias("score"))
    known = subs.select("id").filter("id % 40 <> 0").union(o.select("o_orderkey").filter("o_orderkey % 40 <> 0"))
    return A.submission_errors(subs, known)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'documento desconocido' ELSE 'texto distinto' END AS error FROM documents WHERE doc_id % 11 = 0 OR (doc_id % 7 = 0 AND length(text) > 12)
ORDER BY ALL""")
def validate_passages(spark, d):
    """V11 (literal slices), J13, H38: passages against the texts of the documents they name."""
    docs = table(spark, d, "documents")
    wrong = (F.col("doc_id") % 7 == 0) & (F.length("text") > 12)
    text = F.substr("text", F.lit(4), F.lit(8))
    given = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("pos"), F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"),
                        F.lit(3).alias("inicio"), F.least(F.lit(11), F.length("text")).alias("fin"), F.when(wrong, F.concat(text, F.lit("~"))).otherwise(text).alias("texto"))
    given = given.withColumn("fin", F.greatest("inicio", "fin"))
    return A.passage_errors(given, docs.select("doc_id", F.col("text").alias("completo"))).select("id", "error")


@query(f"""WITH {CITES_SQL}, a AS (SELECT DISTINCT o_custkey AS id, body FROM cites), p AS (SELECT DISTINCT o_custkey AS id, body FROM cites WHERE o_orderkey % 3 = 0)
SELECT id, 'ley' AS tipo, split_part(body, '/', 1) AS numero, split_part(body, '/', 2) AS anio FROM a ANTI JOIN p USING (id, body)""")
def unbacked_citations(spark, d):
    """V11 (unbacked citations), C11: what answers cite and their first passages do not."""
    c = cites(spark, d).select(F.col("o_custkey").alias("id"), F.col("t").alias("texto"), "o_orderkey")
    found = A.unbacked_citations(c, c.filter("o_orderkey % 3 = 0").withColumn("pos", F.lit(1)))
    return found.select("id", "body.tipo", "body.numero", "body.anio")


@query(f"""WITH {SETS_SQL}, x AS (SELECT *, id % 4 AS area, id % 3 AS formato, CASE WHEN id % 5 = 0 THEN NULL ELSE (backed > 1)::int END AS art, n_cited % 9 AS n_docs FROM m)
SELECT area::bigint AS area, formato::bigint AS formato, count(*) AS n, round(avg((hits > 0)::int), 4) AS body_hit, round(sum(hits)::double / sum(n_ref), 4) AS recall,
round(avg(art), 4) AS article_hit, round(avg(n_docs), 4) AS mean_docs FROM x GROUP BY GROUPING SETS ((), (area), (formato))""")
def retrieval_ceiling_rollup(spark, d):
    """A11, A12, E08."""
    empty = F.array().cast("array<string>")
    c, k = F.coalesce("cited", empty), F.coalesce("backed", empty)
    hits = F.array_intersect("ref", c)
    x = items(spark, d).select((F.col("id") % 4).alias("area"), (F.col("id") % 3).alias("formato"), F.size("ref").alias("n_ref"), F.size(hits).alias("n_hit"),
                               F.when(F.col("id") % 5 != 0, F.size(F.array_intersect(hits, k)) > 1).alias("art_hit"), (F.size(c) % 9).alias("n_docs"))
    return E.retrieval_ceiling(x)


@query("""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, round(max(value) FILTER (WHERE place = floor(0.95 * (n - 1))), 6) AS p95, round(max(value), 6) AS max FROM p GROUP BY event_type""")
def latency_percentiles(spark, d):
    """A13."""
    return E.latency(table(spark, d, "events"), "value", ["event_type"])


@query("""WITH m AS (SELECT event_type AS formato, avg(value) AS mean FROM events WHERE user_id % 2 = 0 AND event_type <> 'purchase' GROUP BY ALL),
s AS (SELECT event_type AS formato, count(*) AS n FROM events GROUP BY ALL)
SELECT formato, n, round(coalesce(mean, (SELECT avg(value) FROM events WHERE user_id % 2 = 0 AND event_type <> 'purchase')) * n, 4) AS segundos FROM s LEFT JOIN m USING (formato)""")
def projection_by_format(spark, d):
    """A14."""
    e = table(spark, d, "events")
    done = e.filter("user_id % 2 = 0 AND event_type <> 'purchase'").select(F.col("event_type").alias("formato"), F.col("value").alias("seconds"))
    return E.projection(done, e.groupBy(F.col("event_type").alias("formato")).agg(F.count(F.lit(1)).alias("n")))


@query()
def mmr_select(spark, d):
    """Sentences of each item's best documents under a budget of characters, a mark for each gap."""
    top = V.bm25(spark, d, 3).select("qid", "doc_id")
    pieces = beside(top, table(spark, d, "documents"), "doc_id").select("qid", "doc_id", F.posexplode(T.sentence_pieces(F.col("text"))).alias("pos", "piece"))
    scored = pieces.withColumn("relevance", F.size(F.array_distinct(F.split("piece", " "))).cast("double"))
    return A.compressed(scored, 300, ["qid", "doc_id"]).select("qid", "doc_id", "pos", F.length("piece").alias("chars"), F.length("vista").alias("vista"))


@query("""SELECT o_orderkey, array_to_string(list_filter(['A', 'B', 'C', 'D'], lambda x: x <> chr((65 + o_orderkey % 4)::int)), '') AS letras FROM orders""")
def discard_map(spark, d):
    """Exactly the letters not chosen."""
    m = A.discards(F.array().cast("array<string>"), F.chr(65 + F.col("o_orderkey") % 4))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(m)), "").alias("letras"))


#: Answers of two fields; the second may complete a citation that the first begins.
FIELDS_SQL = """b AS (SELECT item_id AS q, length(text) AS n FROM benchmark),
backed AS (SELECT q AS qid, 'ley/' || (10 + (q + d) % 5) || '/2001' AS body FROM b, (SELECT unnest([0, 1]) AS d)),
said AS (SELECT q AS qid, 'respuesta' AS campo, 0 AS ord, 0 AS pos, 'Rige la Ley ' || (10 + n % 5) || ' de 2001.' AS x FROM b
  UNION ALL SELECT q, 'respuesta', 0, 1, 'Texto ' || n || ' sin norma.' FROM b WHERE n % 3 > 0 UNION ALL SELECT q, 'respuesta', 0, 2, 'Véase la Ley 12' FROM b WHERE q % 4 = 0
  UNION ALL SELECT q, 'referencia', 1, 0, CASE WHEN q % 4 = 0 THEN 'de 2001 y otras.' ELSE 'Ley ' || (10 + q % 7) || ' de 2001.' END FROM b)"""


@query(f"""WITH {FIELDS_SQL},
s AS (SELECT *, CASE WHEN regexp_matches(x, 'Ley \\d+ de 2001') THEN 'ley/' || regexp_extract(x, 'Ley (\\d+) de 2001', 1) || '/2001' END AS body FROM said),
bad AS (SELECT qid, campo, pos, body FROM s WHERE body IS NOT NULL AND (qid, body) NOT IN (SELECT qid, body FROM backed)),
one AS (SELECT qid, campo, ord, coalesce(string_agg(x, ' ' ORDER BY pos) FILTER ((qid, campo, pos) NOT IN (SELECT qid, campo, pos FROM bad)), '') AS texto FROM s GROUP BY ALL),
f1 AS (SELECT qid, campo, ord, CASE WHEN texto = '' THEN 'Relleno ' || qid || '.' ELSE texto END AS texto, texto = '' AS filled FROM one),
whole AS (SELECT qid, string_agg(texto, ' ' ORDER BY ord) AS texto FROM f1 GROUP BY qid),
rest AS (SELECT qid, 'ley/' || unnest(regexp_extract_all(texto, 'Ley (\\d+) de 2001', 1)) || '/2001' AS body FROM whole),
left_ AS (SELECT DISTINCT qid, body FROM rest WHERE (qid, body) NOT IN (SELECT qid, body FROM backed)),
f3 AS (SELECT qid, campo, CASE WHEN qid IN (SELECT qid FROM left_) THEN 'Relleno ' || qid || '.' ELSE texto END AS texto, filled OR qid IN (SELECT qid FROM left_) AS rellenado FROM f1),
gone AS (SELECT qid, string_agg(DISTINCT body, ',' ORDER BY body) AS quitadas FROM (SELECT qid, body FROM bad UNION SELECT * FROM left_) GROUP BY qid)
SELECT qid, campo, f3.texto, rellenado, CASE WHEN quitadas IS NULL THEN 'ok' ELSE 'cita_sin_respaldo' END AS veredicto, coalesce(quitadas, '') AS quitadas FROM f3 LEFT JOIN gone USING (qid)""")
def verified_answers(spark, d):
    """Sentences, fields and whole answers checked by anti joins on bodies, refilled after each step."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.length("text").alias("n"))
    q, n = F.col("qid"), F.col("n")

    def law(x):
        return F.concat(F.lit("Ley "), x.cast("string"), F.lit(" de 2001."))

    first = F.concat_ws(" ", F.concat(F.lit("Rige la "), law(10 + n % 5)), F.when(n % 3 > 0, F.concat(F.lit("Texto "), n.cast("string"), F.lit(" sin norma."))), F.when(q % 4 == 0, "Véase la Ley 12"))
    second = F.when(q % 4 == 0, "de 2001 y otras.").otherwise(law(10 + q % 7))
    fields = b.select("qid", F.explode(F.array(F.struct(F.lit("respuesta").alias("campo"), F.lit(0).alias("ord"), first.alias("texto")), F.struct(F.lit("referencia").alias("campo"), F.lit(1).alias("ord"), second.alias("texto")))).alias("f")).select("qid", "f.*")
    backed = b.select("qid", F.explode(F.array(*[F.concat(F.lit("ley/"), (10 + (q + i) % 5).cast("string"), F.lit("/2001")) for i in (0, 1)])).alias("body"))
    fills = fields.select("qid", "campo", F.concat(F.lit("Relleno "), q.cast("string"), F.lit(".")).alias("texto"))
    found, verdicts = A.verified(fields, backed, fills)
    return found.join(verdicts, "qid").select("qid", "campo", "texto", "rellenado", "veredicto", F.array_join("quitadas", ",").alias("quitadas"))


@query("""WITH p AS (SELECT * FROM (VALUES ('fr', 'ere'), ('fr', 'eau\\w'), ('en', 'th\\w*h'), ('en', 'er e'), ('de', 'u\\w*ch'), ('es', '(?:cion|aci)+')) AS t(lang, patron)),
t AS (SELECT doc_id, d.lang, strip_accents(lower(text)) AS o, patron FROM documents d JOIN p USING (lang)),
m AS (SELECT doc_id, patron, string_split_regex(o, patron) AS ps, regexp_extract_all(o, patron) AS ms FROM t),
l AS (SELECT doc_id, patron, unnest(list_transform(ps[:len(ms)], lambda x: length(x))) AS gap, unnest(list_transform(ms, lambda x: length(x))) AS size, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT doc_id, sum(gap + size) OVER w - size AS a, sum(gap + size) OVER w AS b FROM l WINDOW w AS (PARTITION BY doc_id, patron ORDER BY i)),
g AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM s),
i AS (SELECT *, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT doc_id, min(a)::bigint AS desde, max(b)::bigint AS hasta FROM i GROUP BY doc_id, k""")
def highlighted_spans(spark, d):
    """Spans of patterns for normalised text in the whole texts of ``documents``, mapped back to the original and merged."""
    from ragspark.functions import highlights as H

    wanted = (("fr", "ere"), ("fr", r"eau\w"), ("en", r"th\w*h"), ("en", "er e"), ("de", r"u\w*ch"), ("es", "(?:cion|aci)+"))
    patterns = spark.createDataFrame(list(wanted), "lang string, patron string")
    return H.highlights(table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("texto")), patterns, ["doc_id"], ["lang"])
