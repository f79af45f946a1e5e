"""Queries of the answer chain: from passages to references, verified texts and whole answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import answering as G
from ragspark.operators import chain as H
from ragspark.operators.retrieval import beside
from ragspark.plans import retrieval_queries as V
from ragspark.plans.registry import query, table
from ragspark.sources.storage import stored

PASSAGES_SQL = """ps AS (SELECT o_custkey % 200 AS qid, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS pos,
 'Ley ' || (o_orderkey % 5 + 100) || ' de 2001' AS norma, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 7)::varchar END AS articulo,
 CASE o_orderkey % 9 WHEN 0 THEN 'derogado' WHEN 1 THEN 'inexequible' ELSE 'vigente' END AS vigencia, 'texto ' || o_orderkey AS texto FROM orders QUALIFY pos <= 10)"""


def passages(spark, d):
    """Ten passages of each of 200 questions, from ``orders``."""
    from ragspark.operators.ranking import ranked

    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        (F.col("o_custkey") % 200).alias("qid"), k, F.concat(F.lit("Ley "), (k % 5 + 100).cast("string"), F.lit(" de 2001")).alias("norma"),
        F.when(k % 4 != 0, (k % 7).cast("string")).alias("articulo"),
        F.when(k % 9 == 0, "derogado").when(k % 9 == 1, "inexequible").otherwise("vigente").alias("vigencia"), F.concat(F.lit("texto "), k.cast("string")).alias("texto"))
    return ranked(rows, 10, [F.col("o_orderkey")])


@query(f"""WITH {PASSAGES_SQL}, f AS (SELECT qid, norma, articulo, min(pos) AS pos FROM ps GROUP BY ALL),
g AS (SELECT qid, norma, min(pos) AS pos, coalesce(list(articulo ORDER BY pos) FILTER (WHERE articulo IS NOT NULL), []) AS a FROM f GROUP BY ALL)
SELECT qid, pos, norma || CASE len(a) WHEN 0 THEN '' WHEN 1 THEN ', artículo ' || a[1] ELSE ', artículos ' || array_to_string(a[:-2], ', ') || ' y ' || a[-1] END AS cita FROM g""")
def grouped_cites(spark, d):
    """One citation a norm, its articles together."""
    return G.cites_by_norm(passages(spark, d))


@query(f"""WITH {PASSAGES_SQL} SELECT qid, string_agg('[' || pos || '] ' || norma || coalesce(', artículo ' || articulo, '') ||
 CASE vigencia WHEN 'derogado' THEN ' [DEROGADO]' WHEN 'inexequible' THEN ' [INEXEQUIBLE]' ELSE '' END || chr(10) || texto, chr(10) || chr(10) ORDER BY pos) AS evidencia FROM ps GROUP BY qid""")
def rendered_evidence(spark, d):
    """The evidence as a generator reads it."""
    return G.rendered_evidence(passages(spark, d))


@query("""SELECT o_orderkey AS id, f.away AS abstencion, CASE WHEN f.away THEN '' ELSE 'r' || o_orderkey END AS respuesta, CASE WHEN f.away THEN '' ELSE 'l' END AS referencia_legal
FROM (SELECT *, o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 AS away FROM orders) f""")
def finalise_answers(spark, d):
    """Abstaining answers say nothing."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "multiple_choice").otherwise("semi_open").alias("formato"), F.concat(F.lit("r"), k.cast("string")).alias("respuesta"),
        F.lit("l").alias("referencia_legal"), F.when(k % 5 == 0, G.INSUFFICIENT).otherwise(G.OK).alias("veredicto"))
    return G.finalised_columns(rows).select("id", "abstencion", "respuesta", "referencia_legal")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'j' || o_orderkey WHEN 1 THEN 'r' || o_orderkey || ' ' ELSE 'm  ' || 'x' || o_orderkey || ' ' END AS texto,
CASE o_orderkey % 3 WHEN 1 THEN 'r' || o_orderkey ELSE 'm  x' || o_orderkey || ' ' END AS juez FROM orders""")
def answer_texts(spark, d):
    """The text that citations are read from, and the text that a judge reads."""
    k = F.col("o_orderkey")
    form = F.when(k % 3 == 0, "multiple_choice").when(k % 3 == 1, "semi_open").otherwise("open_ended")
    fields = {"justificacion": F.concat(F.lit("j"), k.cast("string")), "respuesta": F.concat(F.lit("r"), k.cast("string")), "referencia_legal": F.lit(None).cast("string"),
              "marco_normativo": F.lit("m"), "analisis": F.lit(""), "jurisprudencia": F.concat(F.lit("x"), k.cast("string")), "conclusion": F.lit(None).cast("string")}
    return table(spark, d, "orders").select(k.alias("id"), G.answer_text(form, fields.get).alias("texto"), G.judge_text(form, fields.get).alias("juez"))


@query("""WITH s AS (SELECT o_orderkey AS id, 'uno; dos' || o_orderkey AS t FROM orders) SELECT id, 'uno. Dos' || id || '.' AS texto FROM s""")
def semicolon_sentences(spark, d):
    """Semicolons end sentences."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), T.semicolons_to_sentences(F.concat(F.lit("uno; dos"), k.cast("string"))).alias("texto"))


@query("""WITH w AS (SELECT item_id, doc_id, list_distinct(string_split(b.text, ' ')) AS a, list_distinct(string_split(d.text, ' ')) AS c FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, len(list_intersect(a, c)) AS n, round(len(list_intersect(a, c)) / len(a), 9) AS share FROM w""")
def overlap_share(spark, d):
    """Share and number of common terms."""
    b = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("a"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.split("text", " ").alias("c"))
    o = T.overlap(F.col("a"), F.col("c"))
    return b.join(docs, "item_id").select("item_id", o["n"].alias("n"), F.round(o["share"], 9).alias("share"))


def questions(spark, d):
    """The benchmark's items as questions of the three kinds."""
    k = F.col("item_id")
    form = F.when(k % 3 == 0, "multiple_choice").when(k % 3 == 1, "semi_open").otherwise("open_ended")
    words = F.split("text", r"\s+")
    options = F.create_map(*[F.lit(x) if isinstance(x, str) else x for letter, i in zip("ABCD", range(4), strict=True) for x in (letter, F.coalesce(F.get(words, F.lit(i)), F.lit("")))])
    return table(spark, d, "benchmark").select(k.alias("id"), form.alias("formato"), F.col("text").alias("pregunta"), F.when(form == "multiple_choice", options).alias("opciones"))


def evidence(spark, d, k=5):
    """The best documents of each item, as passages of laws; a passage begins with its norm."""
    doc = F.col("doc_id")
    norm = F.concat(F.lit("Ley "), (doc % 900 + 100).cast("string"), F.lit(" de "), (F.lit(1990) + doc % 30).cast("string"))
    docs = table(spark, d, "documents").select(doc, norm.alias("norma"), F.when(doc % 2 == 0, (doc % 50).cast("string")).alias("articulo"),
                                                 F.concat(norm, F.lit(". "), F.coalesce("text", F.lit(""))).alias("texto"))
    return stored(beside(V.bm25(spark, d, k), docs, "doc_id").withColumn("fuente", F.lit("rerank")), "passages")


@query()
def answer_chain(spark, d):
    """From passages to verified answers, errors by item."""
    found = H.answered(questions(spark, d), evidence(spark, d), H.Policy(least_score=0.5, mentions=2))
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("descarte_opciones")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|")
    return found.withColumn("descarte", reasons).withColumn("claves", F.array_join("palabras_clave", "|")).withColumn("fuera", F.array_join("quitadas", "|")).drop(
        "descarte_opciones", "palabras_clave", "quitadas", "rellenados")


@query("""SELECT item_id AS id, 0::bigint AS sin_respaldo, false AS con_error FROM benchmark""")
def answers_are_backed(spark, d):
    """No answer of the chain cites what its passages do not."""
    from ragspark.operators.answers import unbacked_citations

    p = evidence(spark, d)
    found = H.answered(questions(spark, d), p)
    texts = found.select("id", "error", G.answer_text(F.col("formato"), F.col).alias("texto"))
    bad = unbacked_citations(texts, p.select(F.col("qid").alias("id"), "pos", "texto")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return texts.join(bad, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("sin_respaldo"), F.col("error").isNotNull().alias("con_error"))


ANSWER_PASSAGES_SQL = PASSAGES_SQL.replace("'texto ' || o_orderkey AS texto", "o_orderkey AS k").replace("(o_orderkey % 7)", "(o_orderkey % 7 + 1)")


@query(f"""WITH {ANSWER_PASSAGES_SQL}, first AS (SELECT *, norma || coalesce(', artículo ' || articulo, '') AS cite FROM ps WHERE pos = 1),
f AS (SELECT qid, norma, articulo, min(pos) AS pos FROM ps GROUP BY ALL),
g AS (SELECT qid, norma, min(pos) AS pos, coalesce(list(articulo ORDER BY pos) FILTER (WHERE articulo IS NOT NULL), []) AS a FROM f GROUP BY ALL),
c AS (SELECT g.qid, g.pos, g.norma || CASE len(a) WHEN 0 THEN '' WHEN 1 THEN ', artículo ' || a[1] ELSE ', artículos ' || array_to_string(a[:-2], ', ') || ' y ' || a[-1] END AS cita,
  g.norma = first.norma AND a = CASE WHEN first.articulo IS NULL THEN [] ELSE [first.articulo] END AS own FROM g JOIN first USING (qid)),
r AS (SELECT qid, coalesce(string_agg(cita, '; ' ORDER BY pos) FILTER (NOT own), '') AS more FROM c GROUP BY qid),
ld AS (SELECT qid, string_agg(cite, '; ' ORDER BY pos) AS normas FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n
  FROM (SELECT qid, norma, min(pos) AS pos, arg_min(norma || coalesce(', artículo ' || articulo, ''), pos) AS cite FROM ps GROUP BY qid, norma)) WHERE n <= 3 GROUP BY qid)
SELECT qid AS id, CASE WHEN qid % 2 = 0 THEN 'semi_open' ELSE 'open_ended' END AS formato, CASE WHEN qid % 2 = 0 THEN 'Conforme a lo dispuesto en ' || cite || ': Frase uno de ' || k || '. Frase dos sigue.' ELSE '' END AS respuesta,
  CASE WHEN qid % 2 = 0 THEN concat_ws('; ', cite, nullif(more, '')) ELSE '' END AS referencia_legal,
  CASE WHEN qid % 2 = 1 THEN 'Conforme a lo dispuesto en ' || cite || ': Frase uno de ' || k || '. Frase dos sigue.' ELSE '' END AS analisis,
  CASE WHEN qid % 2 = 1 THEN 'La solución del caso se rige por ' || cite || '.' ELSE '' END AS conclusion, CASE WHEN qid % 2 = 1 THEN normas ELSE '' END AS empieza, 'ok' AS veredicto FROM first JOIN r USING (qid) JOIN ld USING (qid)""")
def answer_fields(spark, d):
    """What the evidence says in each field, and the references that are added, without a model."""
    k = F.col("o_orderkey")
    rows = passages(spark, d).select("qid", "pos", k.cast("string").alias("doc_id"), "norma", F.when(k % 4 != 0, (k % 7 + 1).cast("string")).alias("articulo"),
                                     F.concat("norma", F.lit(". Frase uno de "), k.cast("string"), F.lit(". Frase dos sigue.")).alias("texto"), F.lit(1.0).alias("score"), F.lit("rerank").alias("fuente"))
    asked = rows.select(F.col("qid").alias("id")).distinct().select("id", F.when(F.col("id") % 2 == 0, "semi_open").otherwise("open_ended").alias("formato"), F.lit("pregunta").alias("pregunta"), F.lit(None).cast("map<string,string>").alias("opciones"))
    found = H.answered(asked, rows, H.Policy(extend=False))
    starts = F.when(F.col("marco_normativo") != "", F.regexp_extract("marco_normativo", r"^((?:Ley \d+ de 2001(?:, artículo \d+)?(?:; |\.?$)?){0,3})", 1)).otherwise("")
    return found.select("id", "formato", "respuesta", "referencia_legal", "analisis", "conclusion", F.rtrim(starts, F.lit("; .")).alias("empieza"), "veredicto")


@query("""WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, (o_orderkey % 9 + 100)::varchar AS n, (o_orderkey % 7 + 1)::varchar AS a FROM orders),
own AS (SELECT DISTINCT id, n, CASE WHEN k % 3 = 0 THEN NULL ELSE a END AS a FROM o WHERE k % 2 = 0), s AS (SELECT id, n FROM own WHERE a IS NOT NULL),
kept AS (SELECT * FROM own WHERE a IS NOT NULL OR (id, n) NOT IN (SELECT (id, n) FROM s)),
p AS (SELECT id, k % 12 + 1 AS pos, n, a FROM o WHERE k % 2 = 1 AND k % 12 + 1 <= 10), h AS (SELECT id, n, list_sort(list_distinct(list(pos))) AS pasajes, list(a) AS arts FROM p GROUP BY id, n)
SELECT kept.id, 'Ley ' || kept.n || ' de 2001' || coalesce(', art. ' || kept.a, '') AS cita, h.n IS NOT NULL AS respaldada, coalesce(list_contains(h.arts, kept.a), false) AS articulo_en_pasajes,
coalesce(array_to_string(h.pasajes, ','), '') AS pasajes FROM kept LEFT JOIN h ON kept.id = h.id AND kept.n = h.n""")
def shown_citations(spark, d):
    """The citations of an answer as a reader is shown them, and the passages that hold their norms."""
    from ragspark.operators.answers import shown_citations as shown

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    law, article = F.concat(F.lit("la Ley "), (k % 9 + 100).cast("string"), F.lit(" de 2001")), (k % 7 + 1).cast("string")
    cite = F.when((k % 2 == 0) & (k % 3 == 0), law).otherwise(F.concat(F.lit("artículo "), article, F.when(k % 2 == 1, "o").otherwise(""), F.lit(" de "), law))
    rows = o.select(F.col("o_custkey").alias("id"), k, cite.alias("texto"), (k % 12 + 1).cast("int").alias("pos"))
    found = shown(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"))
    return found.select("id", "cita", "respaldada", "articulo_en_pasajes", F.concat_ws(",", F.transform("pasajes", lambda p: p.cast("string"))).alias("pasajes")).distinct()
