"""Queries of lexical, dense and hybrid retrieval, lookups and coupling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import models as M
from ragspark.operators import ranking as R
from ragspark.operators import retrieval as V
from ragspark.plans.registry import query, table
from ragspark.plans.text_queries import TOKENS_SQL

WORDS = r"([a-z0-9_]+)"
BM25_SQL = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
fr AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark),
sc AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
  FROM post JOIN qt USING (term) JOIN fr USING (term) JOIN len USING (doc_id), st GROUP BY ALL)"""


def _bm25_sql(where: str = "true", k: int = 10) -> str:
    return f"""WITH {BM25_SQL}, r AS (SELECT qid, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) AS pos
FROM sc JOIN (SELECT doc_id FROM documents WHERE {where}) USING (doc_id) WHERE s > 0) SELECT qid, pos, doc_id, score FROM r WHERE pos <= {k}"""


def terms():
    return F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(1))


def bm25(spark, d, k=10, only=None):
    asked = V.query_terms(table(spark, d, "benchmark"), terms(), "item_id")
    index = V.lexical_index(table(spark, d, "documents"), terms(), vocabulary=V.vocabulary_of(asked))
    return V.bm25_topk(index, asked, k, only=only)


def listed(df):
    return df.select("qid", "pos", "doc_id", "score")


@query(_bm25_sql())
def bm25_topk(spark, d):
    """The flagship."""
    return listed(bm25(spark, d))


@query(_bm25_sql("lang = 'en' AND doc_id % 10 <> 0"))
def bm25_masked_topk(spark, d):
    """Masks after statistics."""
    docs = table(spark, d, "documents")
    return listed(bm25(spark, d, only=V.masked(docs, docs.filter("lang = 'en'"), docs.filter("doc_id % 10 = 0")).select("doc_id")))


@query(_bm25_sql("source = 'src0'", 2))
def bm25_in_doc(spark, d):
    """Within one named source."""
    return listed(bm25(spark, d, 2, table(spark, d, "documents").filter("source = 'src0'").select("doc_id")))


DENSE_SQL = """q AS (SELECT vec_id AS qid, embedding::double[] AS v FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT vec_id AS doc_id, embedding::double[] AS v, label FROM embeddings),
dn AS (SELECT qid, doc_id, label, round(list_inner_product(q.v, x.v), 6) AS score FROM q, x)"""


def vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "v"), e.withColumnRenamed("vec_id", "doc_id")


def _dense_sql(where: str) -> str:
    return f"""WITH {DENSE_SQL}, r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS pos FROM dn WHERE {where})
SELECT qid, pos, doc_id, score FROM r WHERE pos <= 10"""


@query(_dense_sql("true"))
def dense_topk(spark, d):
    """R03, J18."""
    q, x = vectors(spark, d)
    return listed(V.dense_topk(q, x, 10))


@query(_dense_sql("label < 5"))
def dense_masked_topk(spark, d):
    """R03 with a mask: the filter comes before the scores."""
    q, x = vectors(spark, d)
    return listed(V.dense_topk(q, x.filter("label < 5"), 10))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL},
l AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS pos FROM dn
  UNION ALL SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) FROM sc WHERE s > 0),
f AS (SELECT qid, doc_id, sum(1.0::double / (60 + pos)) AS s FROM l WHERE pos <= 40 GROUP BY ALL),
r AS (SELECT qid, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) AS pos FROM f)
SELECT qid, pos, doc_id, score FROM r WHERE pos <= 10""")
def rrf_hybrid(spark, d):
    """R05, R06."""
    q, x = vectors(spark, d)
    cols = ["qid", "doc_id", "chunk_id", "score", "pos"]
    both = V.dense_topk(q, x, 40).select(*cols).withColumn("list_ord", F.lit(0)).unionByName(
        bm25(spark, d, 40).select(*cols).withColumn("list_ord", F.lit(1)))
    return R.rrf(both).filter("pos <= 10").select("qid", "pos", "doc_id", R.rounded("score").alias("score"))


RULES = ((1, "(?i)tion", 7, 1), (2, "(?i)\\bthe\\b", 3, 2), (3, "(?i)que", 9, 1), (4, "(?i)ing\\b", 7, 1))


@query("""WITH rules(ord, patron, doc_id, chunk_id) AS (VALUES (1, '(?i)tion', 7, 1), (2, '(?i)\\bthe\\b', 3, 2), (3, '(?i)que', 9, 1), (4, '(?i)ing\\b', 7, 1)),
h AS (SELECT item_id AS qid, doc_id, chunk_id, min(ord) AS ord FROM benchmark JOIN rules ON regexp_matches(text, patron) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord, doc_id) AS pos FROM h)
SELECT qid, pos, doc_id::bigint AS doc_id, chunk_id::bigint AS chunk_id FROM r WHERE pos <= 2""")
def fixed_values_rules(spark, d):
    """R17, J14, H29."""
    rules = spark.createDataFrame(list(RULES), "ord int, patron string, doc_id long, chunk_id long")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return V.rule_hits(queries, rules, 2).select("qid", "pos", "doc_id", "chunk_id")


@query("""WITH cited AS (SELECT o_custkey AS qid, o_orderkey % 40 AS body, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 5)::varchar END AS article FROM orders),
cd AS (SELECT DISTINCT * FROM cited),
arts AS (SELECT p_partkey % 40 AS body, (p_size % 5)::varchar AS article, p_partkey % 40 AS doc_id, p_partkey AS chunk_id FROM part WHERE p_size % 4 <> 0),
cards AS (SELECT p_partkey AS body, p_partkey AS doc_id, -p_partkey AS chunk_id FROM part WHERE p_partkey < 40),
f AS (SELECT qid, body, article, doc_id, chunk_id, 1 AS rank, row_number() OVER (PARTITION BY qid, body, article ORDER BY chunk_id) AS part FROM cd JOIN arts USING (body, article)),
f2 AS (SELECT * FROM f WHERE part <= 2),
c AS (SELECT DISTINCT qid, body FROM cd ANTI JOIN f2 USING (qid, body)),
u AS (SELECT * FROM f2 UNION ALL SELECT qid, body, NULL, doc_id, chunk_id, 2, 1 FROM c JOIN cards USING (body)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, doc_id, chunk_id ORDER BY rank, body, part) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, body, article, part, doc_id) AS pos FROM o)
SELECT qid, pos, body, article, doc_id, chunk_id FROM r WHERE pos <= 4""")
def lookup_exact(spark, d):
    """R14, R15, R16, J02."""
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    article = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 5).cast("string"))
    cited = o.select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 40).alias("body"), article.alias("article")).distinct()
    arts = p.filter("p_size % 4 <> 0").select((F.col("p_partkey") % 40).alias("body"), (F.col("p_size") % 5).cast("string").alias("article"),
                                             (F.col("p_partkey") % 40).alias("doc_id"), F.col("p_partkey").alias("chunk_id"))
    cards = p.filter("p_partkey < 40").select(F.col("p_partkey").alias("body"), F.col("p_partkey").alias("doc_id"), (-F.col("p_partkey")).alias("chunk_id"))
    return V.lookup_hits(cited, arts, cards, 2, 4).select("qid", "pos", "body", "article", "doc_id", "chunk_id")


EDGES_SQL = "e AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 200 AS body FROM lineitem)"


@query(f"""WITH {EDGES_SQL}, i AS (SELECT body, ln((SELECT count(DISTINCT doc_id) FROM e)::double / count(DISTINCT doc_id)) AS idf FROM e GROUP BY body),
core AS (SELECT DISTINCT p_size AS qid, p_partkey % 200 AS body FROM part),
s AS (SELECT qid, doc_id, sum(idf) AS s FROM core JOIN e USING (body) JOIN i USING (body) GROUP BY ALL),
r AS (SELECT qid, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) AS pos FROM s WHERE s > 0)
SELECT qid::bigint AS qid, pos, doc_id, score FROM r WHERE pos <= 10""")
def citation_coupling_idf(spark, d):
    """R19, A02, J16."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 200).alias("body"))
    core = table(spark, d, "part").select(F.col("p_size").alias("qid"), (F.col("p_partkey") % 200).alias("body"))
    return listed(V.coupling(edges, core, 10))


@query("""WITH old AS (SELECT sha256(text) AS h, min(doc_id) AS from_id FROM documents WHERE doc_id % 2 = 0 GROUP BY h)
SELECT doc_id, from_id, from_id IS NULL AS encode FROM (SELECT * FROM documents WHERE doc_id % 2 = 1) LEFT JOIN old ON h = sha256(text)""")
def incremental_reuse(spark, d):
    """S32, J03, U06."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    old = docs.filter("id % 2 = 0").withColumn("v", F.array(F.col("id").cast("double")))
    found = V.reuse_vectors(docs.filter("id % 2 = 1"), old)
    return found.select(F.col("id").alias("doc_id"), "from_id", F.col("from_id").isNull().alias("encode"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_check(spark, d):
    """Items of any length in documents, by one automaton for a block of items."""
    return V.contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query(f"""WITH {BM25_SQL}, c AS (SELECT qid, doc_id FROM sc WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) <= 20),
q AS (SELECT item_id AS qid, list_distinct({{q}}) AS t FROM benchmark), p AS (SELECT doc_id, {{p}} AS t FROM documents),
r AS (SELECT qid, doc_id, round(len(list_intersect(q.t, p.t)) / len(q.t), 6) AS score FROM c JOIN q USING (qid) JOIN p USING (doc_id))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS pos, doc_id, score FROM r""".replace("{q}", TOKENS_SQL).replace("{p}", TOKENS_SQL))
def rerank_stand_in(spark, d):
    """The reranker's plug with its lexical stand-in."""
    c = bm25(spark, d, 20).select("qid", "doc_id", "chunk_id")
    c = V.beside(c, table(spark, d, "documents").select("doc_id", F.col("text").alias("texto")), "doc_id")
    return listed(M.reranked(c, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")))


@query("""WITH p AS (SELECT item_id AS qid, lower(text) AS q, 0 AS ord, 'first ' || item_id AS s FROM benchmark UNION ALL SELECT item_id, lower(text), 1, 'FIRST ' || item_id FROM benchmark
UNION ALL SELECT item_id, lower(text), 2, 'second' FROM benchmark UNION ALL SELECT item_id, lower(text), 3, ' ' FROM benchmark)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord) AS pos, s AS sub FROM p WHERE ord IN (0, 2)""")
def subquery_cleanup(spark, d):
    """T21, M02."""
    b = table(spark, d, "benchmark")
    first = F.concat(F.lit("first "), F.col("item_id").cast("string"))
    proposals = F.array(first, F.concat(F.lit("FIRST "), F.col("item_id").cast("string")), F.lit("second"), F.lit(" "), F.col("text"))
    return M.subqueries(b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), proposals.alias("proposals")), 2)
