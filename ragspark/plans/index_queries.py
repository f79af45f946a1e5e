"""Queries of stored indexes and of the way from questions to answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragspark.operators import ask as Q
from ragspark.operators import index as I
from ragspark.operators import ranking as R
from ragspark.operators import retrieval as V
from ragspark.plans import answering_queries as W
from ragspark.plans.registry import query, table
from ragspark.plans.retrieval_queries import BM25_SQL, WORDS
from ragspark.sources.storage import scratch
from ragspark.streaming import resume


def fragments(spark, d):
    """The documents as fragments of laws and rulings."""
    doc = F.col("doc_id")
    norm = F.concat(F.lit("Ley "), (doc % 900 + 100).cast("string"), F.lit(" de "), (F.lit(1990) + doc % 30).cast("string"))
    return table(spark, d, "documents").select(
        F.concat(F.lit("ley_"), doc.cast("string")).alias("doc_id"), doc.alias("chunk_id"), norm.alias("norma"), F.when(doc % 2 == 0, (doc % 50).cast("string")).alias("articulo"),
        F.concat(norm, F.lit(". "), F.coalesce("text", F.lit(""))).alias("texto"), F.when(doc % 5 == 0, "sentencia").otherwise("norma").alias("clase"),
        F.when(doc % 9 == 0, "derogado").otherwise("vigente").alias("vigencia"))


def _words(c):
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(1))


@query(f"""WITH {BM25_SQL}, r AS (SELECT qid, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) AS pos FROM sc WHERE s > 0)
SELECT qid, pos, doc_id, score FROM r WHERE pos <= 10""")
def bm25_stored(spark, d):
    """An index that is built, stored, checked and loaded gives the flagship's lists."""
    path = scratch(spark, f"index-{uuid.uuid4().hex}")
    I.store_fragments(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("texto")), path)
    I.build_lexical(spark, path, _words)
    asked = V.query_terms(table(spark, d, "benchmark"), _words("text"), "item_id")
    return V.bm25_topk(I.load_lexical(spark, path, V.vocabulary_of(asked)), asked, 10).select("qid", "pos", "doc_id", "score")


@query("SELECT count(*) AS fragmentos, count(*) FILTER (WHERE t IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) AS reused, true AS unitarios FROM (SELECT coalesce(text, '') AS t FROM documents)")
def dense_stored(spark, d):
    """Vectors of a plugged encoder; texts that an older index has are not encoded again."""
    path, model = scratch(spark, f"index-{uuid.uuid4().hex}"), I.hashed_roots(16)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("texto"))
    I.store_fragments(rows.filter("chunk_id % 2 = 0"), path)
    I.build_dense(spark, path, model)
    I.store_fragments(rows, path)
    done = I.build_dense(spark, path, model)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    unit = I.load_dense(spark, path).agg(F.count(F.lit(1)).alias("fragmentos"), F.min((F.abs(length - 1) < 1e-9) | (length == 0)).alias("unitarios"))
    return unit.select("fragmentos", F.lit(done["reused"]).cast("long").alias("reused"), "unitarios")


@query("SELECT item_id AS id, true AS respondida, false AS con_error FROM benchmark")
def ask_questions(spark, d):
    """Questions to verified answers over a stored index."""
    path = scratch(spark, f"index-{uuid.uuid4().hex}")
    I.store_fragments(fragments(spark, d), path)
    I.build_lexical(spark, path)
    I.build_citations(spark, path)
    found = Q.ask(spark, W.questions(spark, d), path)
    said = F.when(F.col("formato") == "multiple_choice", F.col("respuesta_correcta")).when(F.col("formato") == "semi_open", F.col("respuesta")).otherwise(F.col("analisis"))
    return found.select("id", (F.coalesce(said, F.lit("")) != "").alias("respondida"), F.col("error").isNotNull().alias("con_error"))


#: Three fragments a document; odd documents are laws, even ones rulings; a text cites two more norms, told by the row.
CITING_SQL = """f AS (SELECT doc_id AS chunk_id, 'd' || doc_id // 3 AS doc, doc_id // 3 % 2 AS law, doc_id // 3 AS n, (doc_id % 3)::varchar AS article, doc_id,
  coalesce(length(text), 0) % 70 + 10 AS other, coalesce(length(text), 0) % 7 + 2000 AS year FROM documents),
own AS (SELECT DISTINCT doc, n, law, CASE WHEN law = 1 THEN 'ley/' || n || '/' || (1990 + n % 30) ELSE 'jurisprudencia/C-' || n || '/' || (1992 + n % 30) END AS body FROM f)"""


def citing_fragments(spark, d):
    """The documents as fragments that name their norm and cite others."""
    k = F.col("doc_id")
    n = F.floor(k / 3)
    size = F.coalesce(F.length("text"), F.lit(0))
    norm = F.when(n % 2 == 1, F.concat(F.lit("Ley "), n.cast("string"), F.lit(" de "), (1990 + n % 30).cast("string"))).otherwise(
        F.concat(F.lit("Sentencia C-"), n.cast("string"), F.lit(" de "), (1992 + n % 30).cast("string")))
    cites = F.concat(norm, F.lit(". Según la Ley "), (size % 70 + 10).cast("string"), F.lit(" de "), (size % 7 + 2000).cast("string"), F.lit(" y la Sentencia T-"),
                     (size % 70 + 10).cast("string"), F.lit(" de "), (size % 7 + 2000).cast("string"), F.lit("."))
    return table(spark, d, "documents").select(
        F.concat(F.lit("d"), n.cast("string")).alias("doc_id"), k.alias("chunk_id"), norm.alias("norma"), F.when(n % 2 == 1, (k % 3).cast("string")).alias("articulo"),
        F.when((n % 2 == 0) & (k % 3 == 1), "ficha").alias("seccion"), cites.alias("texto"), F.when(n % 2 == 1, "norma").otherwise("sentencia").alias("clase"), F.lit("vigente").alias("vigencia"))


def citing_index(spark, d):
    path = scratch(spark, f"index-{uuid.uuid4().hex}")
    I.store_fragments(citing_fragments(spark, d), path)
    I.build_citations(spark, path)
    return path


@query(f"""WITH {CITING_SQL}, named AS (SELECT DISTINCT doc, 'ley/' || other || '/' || year AS body FROM f UNION SELECT DISTINCT doc, 'jurisprudencia/T-' || other || '/' || year FROM f)
SELECT 'norms' AS part, body, own.doc, NULL AS article, min(chunk_id) AS a, max(chunk_id) + 1 AS b FROM own JOIN f USING (doc) GROUP BY body, own.doc
UNION ALL SELECT 'articles', body, own.doc, article, chunk_id, row_number() OVER (PARTITION BY body, own.doc, article ORDER BY chunk_id) FROM own JOIN f USING (doc) WHERE own.law = 1
UNION ALL SELECT 'cards', body, own.doc, NULL, coalesce(min(chunk_id) FILTER (own.law = 0 AND chunk_id % 3 = 1), min(chunk_id)), NULL FROM own JOIN f USING (doc) GROUP BY body, own.doc
UNION ALL SELECT 'cited', body, doc, NULL, NULL, NULL FROM named ANTI JOIN own USING (doc, body)""")
def citation_tables(spark, d):
    """The stored citation part of an index: norms with their ranges, articles, cards and what documents cite."""
    found = I.load_citations(spark, citing_index(spark, d))
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    parts = (
        ("norms", text, F.col("inicio"), F.col("fin")), ("articles", F.col("article"), F.col("chunk_id"), F.col("part").cast("long")),
        ("cards", text, F.col("chunk_id"), none), ("cited", text, none, none))
    out = [getattr(found, n).select(F.lit(n).alias("part"), "body", F.col("doc_id").alias("doc"), article.alias("article"), a.alias("a"), b.alias("b")) for n, article, a, b in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


LOOKUP_SQL = f"""WITH {CITING_SQL}, q AS (SELECT item_id AS qid, item_id % (SELECT max(n) FROM f) + 1 AS n, item_id % 4 AS article FROM benchmark),
a AS (SELECT qid, q.n, doc, chunk_id, 1 AS rank FROM q JOIN f ON f.n = q.n AND f.law = 1 AND f.article = q.article::varchar),
c AS (SELECT qid, q.n, own.doc, CASE WHEN own.law = 0 THEN coalesce(min(chunk_id) FILTER (chunk_id % 3 = 1), min(chunk_id)) ELSE min(chunk_id) END AS chunk_id, 2 AS rank
  FROM q JOIN own ON own.n = q.n JOIN f USING (doc) WHERE qid NOT IN (SELECT qid FROM a) GROUP BY qid, q.n, own.doc, own.law)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, doc) AS pos, doc, chunk_id FROM (SELECT * FROM a UNION ALL SELECT * FROM c)"""


def naming_questions(spark, d):
    """Questions(qid, text) that name a norm each, by article, whole, or without its year."""
    top = citing_fragments(spark, d).agg(F.max(F.floor(F.col("chunk_id") / 3)).alias("top"))
    n, k = F.col("item_id") % F.col("top") + 1, F.col("item_id")
    law = F.concat(F.lit("el artículo "), (k % 4).cast("string"), F.lit(" de la Ley "), n.cast("string"), F.lit(" de "), (1990 + n % 30).cast("string"))
    return table(spark, d, "benchmark").crossJoin(F.broadcast(top)).select(
        k.alias("qid"), F.concat(F.lit("¿Qué dispone "), F.when(n % 2 == 1, law).otherwise(F.concat(F.lit("la sentencia C-"), n.cast("string"))), F.lit("?")).alias("text"))


@query(LOOKUP_SQL)
def stored_lookup(spark, d):
    """Fragments that questions name by article, by norm, and by rulings without a year, from stored tables."""
    found = Q.named(naming_questions(spark, d), I.load_citations(spark, citing_index(spark, d)), Q.Settings())
    return found.select("qid", "pos", F.col("doc_id").alias("doc"), "chunk_id")


@query(LOOKUP_SQL)
def streamed_lookup(spark, d):
    """Questions stream through the stored index batch by batch, each answered once though they come twice; a second run finds nothing to do."""
    base, path = scratch(spark, f"asked-{uuid.uuid4().hex}"), citing_index(spark, d)
    asked = naming_questions(spark, d).coalesce(1)
    asked.write.parquet(f"{base}/in")
    asked.filter("qid % 2 = 0").write.mode("append").parquet(f"{base}/in")
    index = I.load_citations(spark, path)

    def answer(batch):
        return Q.named(batch, index, Q.Settings())

    for _ in range(2):
        resume.answer_batches(spark, f"{base}/in", asked.schema, answer, f"{base}/out", f"{base}/checkpoint", "qid", files_at_once=1)
    return resume.answers(spark, f"{base}/out").select("qid", "pos", F.col("doc_id").alias("doc"), "chunk_id")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 200 AS body FROM lineitem WHERE l_orderkey % 3 = 0),
l AS (SELECT l_suppkey % 20 AS qid, l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS chunk_id, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos
  FROM lineitem),
mine AS (SELECT * FROM l WHERE doc_id % 3 = 0 AND pos <= 900), best AS (SELECT qid, doc_id, min(pos) AS rango, arg_min(chunk_id, pos) AS chunk_id FROM mine GROUP BY ALL),
prim AS (SELECT qid, doc_id FROM l WHERE doc_id % 3 = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) <= 5),
core AS (SELECT DISTINCT p_size % 20 AS qid, p_partkey % 200 AS body FROM part WHERE p_size < 20 AND p_partkey % 9 = 0 UNION SELECT DISTINCT qid, doc_id % 200 FROM prim),
i AS (SELECT body, ln((SELECT count(DISTINCT doc_id) FROM e)::double / count(*)) AS idf FROM e GROUP BY body),
s AS (SELECT qid, doc_id, chunk_id, rango, round(sum(idf), 9) AS score FROM best JOIN e USING (doc_id) JOIN core USING (qid, body) JOIN i USING (body) GROUP BY ALL),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rango, doc_id) AS pos, doc_id, chunk_id, round(score, 6) AS score FROM s WHERE score > 0)
SELECT * FROM r WHERE pos <= 10""")
def coupled_rulings(spark, d):
    """One best fragment of each document listed, by what it shares with the core of the question, then by its place in the list."""
    items = table(spark, d, "lineitem")
    edges = items.filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 200).alias("body")).distinct()
    lists = R.ranked(items.select((F.col("l_suppkey") % 20).alias("qid"), F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), "l_extendedprice"),
                     None, [F.desc("l_extendedprice"), F.col("doc_id"), F.col("chunk_id")])
    named = table(spark, d, "part").filter("p_size < 20 AND p_partkey % 9 = 0").select((F.col("p_size") % 20).alias("qid"), (F.col("p_partkey") % 200).alias("body"))
    norms = items.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") % 200).alias("body")).distinct()
    core = V.core_bodies(named, lists, norms, 5, F.col("doc_id") % 3 == 1)
    return V.coupled(lists.filter("doc_id % 3 = 0 AND pos <= 900"), edges, core, 10).select("qid", "pos", "doc_id", "chunk_id", R.rounded("score").alias("score"))


ASKED_SQL = BM25_SQL.replace("doc_id, unnest", "chunk AS doc_id, unnest").replace("SELECT doc_id, len(", "SELECT chunk AS doc_id, len(").replace("lower(text)", "lower(texto)").replace("FROM documents", "FROM f").replace(
    "SELECT DISTINCT item_id AS qid", "SELECT DISTINCT qid").replace("FROM benchmark", "FROM q")


@query(f"""WITH f AS (SELECT doc_id AS chunk, 'd' || doc_id // 2 AS doc, doc_id // 2 AS n, CASE doc_id // 2 % 5 WHEN 0 THEN 'sentencia' WHEN 1 THEN 'voto' ELSE 'norma' END AS clase,
  CASE WHEN doc_id % 3 = 0 THEN 0.5::double ELSE 1.0::double END AS factor, doc_id % 2 AS art, 'Ley ' || doc_id // 2 || ' de ' || (1990 + doc_id // 2 % 30) || '. ' || coalesce(text, '') AS texto FROM documents),
q AS (SELECT item_id AS qid, item_id * 3 + 1 AS n, item_id % 2 = 0 AS names, text || CASE WHEN item_id % 2 = 0 THEN ' artículo 1 de la Ley ' || (item_id * 3 + 1) || ' de ' || (1990 + (item_id * 3 + 1) % 30) ELSE '' END AS texto FROM benchmark),
{ASKED_SQL},
cand AS (SELECT qid, chunk, clase, row_number() OVER (PARTITION BY qid, clase = 'voto' ORDER BY round(s, 6) DESC, chunk) AS pos, row_number() OVER (PARTITION BY qid, clase ORDER BY round(s, 6) DESC, chunk) AS own
  FROM sc JOIN f ON chunk = doc_id WHERE s > 0),
c1 AS (SELECT *, row_number() OVER (PARTITION BY qid, clase ORDER BY pos) AS rk FROM cand WHERE clase <> 'voto' AND pos <= 18),
t1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (clase <> 'sentencia' OR rk <= 2) DESC, pos) AS turn FROM c1),
pre AS (SELECT qid, chunk, clase, pos FROM t1 WHERE turn <= 6),
miss AS (SELECT qid, chunk, own AS pos FROM cand WHERE clase = 'norma' AND own <= 2 AND (qid, chunk) NOT IN (SELECT qid, chunk FROM pre)),
size AS (SELECT qid, count(*) + coalesce((SELECT count(*) FROM miss m WHERE m.qid = pre.qid), 0) - 6 AS over FROM pre GROUP BY qid),
kept AS (SELECT *, row_number() OVER (PARTITION BY qid, clase = 'norma' ORDER BY pos DESC) AS back FROM pre),
g AS (SELECT qid, chunk FROM (SELECT qid, chunk, pos, 0 AS part FROM kept JOIN size USING (qid) WHERE clase = 'norma' OR back > over UNION ALL SELECT qid, chunk, pos, 1 FROM miss)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY part, pos) <= 6),
w AS (SELECT qid, list_distinct(regexp_extract_all(lower(texto), '[a-z0-9_]+')) AS t FROM q),
r AS (SELECT qid, g.chunk, doc, clase, round(len(list_intersect(t, regexp_extract_all(lower(texto), '[a-z0-9_]+'))) / len(t), 6) AS score, factor FROM g JOIN w USING (qid) JOIN f ON f.chunk = g.chunk),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score * factor, 6) DESC, doc, chunk) AS pos FROM r),
d1 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY pos) AS rk FROM o),
listed AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY (rk <= 1) DESC, pos) <= 4),
looked AS (SELECT qid, chunk FROM q JOIN f ON f.n = q.n AND names AND (f.art = 1 OR (f.art = 0 AND NOT EXISTS (SELECT 1 FROM f x WHERE x.n = q.n AND x.art = 1)))),
long AS (SELECT qid, chunk, true AS named, 0 AS pos FROM looked UNION ALL SELECT qid, chunk, false, pos FROM listed WHERE (qid, chunk) NOT IN (SELECT qid, chunk FROM looked)),
quota AS (SELECT long.*, clase, sum((NOT named AND clase = 'sentencia')::int) OVER (PARTITION BY qid, clase ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rk FROM long JOIN f USING (chunk)),
cut AS (SELECT * FROM quota QUALIFY row_number() OVER (PARTITION BY qid ORDER BY (named OR clase <> 'sentencia' OR rk <= 1) DESC, pos) <= 4)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS pos, chunk AS chunk_id, CASE WHEN named THEN 'lookup' ELSE 'rerank' END AS fuente FROM cut""")
def ask_passages(spark, d):
    """The passages of questions through the whole way: mask, preselection by class, primaries, reranking, status, document cap, lookup, quota."""
    path, k = scratch(spark, f"index-{uuid.uuid4().hex}"), F.col("doc_id")
    n = F.floor(k / 2)
    norm = F.concat(F.lit("Ley "), n.cast("string"), F.lit(" de "), (1990 + n % 30).cast("string"))
    rows = table(spark, d, "documents").select(
        F.concat(F.lit("d"), n.cast("string")).alias("doc_id"), k.alias("chunk_id"), norm.alias("norma"), (k % 2).cast("string").alias("articulo"),
        F.concat(norm, F.lit(". "), F.coalesce("text", F.lit(""))).alias("texto"), F.when(n % 5 == 0, "sentencia").when(n % 5 == 1, "voto").otherwise("norma").alias("clase"),
        F.when(k % 3 == 0, "derogado").otherwise("vigente").alias("vigencia"))
    I.store_fragments(rows, path)
    I.build_lexical(spark, path, _words)
    I.build_citations(spark, path)
    q, law = F.col("item_id"), F.col("item_id") * 3 + 1
    named = F.concat(F.lit(" artículo 1 de la Ley "), law.cast("string"), F.lit(" de "), (1990 + law % 30).cast("string"))
    asked = table(spark, d, "benchmark").select(q.alias("qid"), F.concat("text", F.when(q % 2 == 0, named).otherwise("")).alias("text"))

    def share(query, passage):
        words = F.array_distinct(_words(query))
        return F.size(F.array_intersect(words, _words(passage))) / F.size(words)

    settings = Q.Settings(candidates=6, passages=4, lookup_hits=2, parts_of_article=1, caps={"sentencia": 1}, factors={"derogado": 0.5}, harvested=("voto",), per_document=1, primaries=2, terms=_words)
    return Q.retrieve(asked, path, settings, scorer=share).select("qid", "pos", "chunk_id", "fuente")
