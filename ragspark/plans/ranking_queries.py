"""Queries of operators over ranked lists.

The stand-in list of a customer is its orders by price: document ``o_orderkey
% 7``, chunk ``o_orderkey``, class by priority.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import ranking as R
from ragspark.plans.registry import query, table

BASE_SQL = """base AS (SELECT o_custkey AS qid, o_orderkey % 7 AS doc_id, o_orderkey AS chunk_id, round(o_totalprice / 1e6, 6) AS score,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'sentencia' WHEN '2-HIGH' THEN 'voto' WHEN '3-MEDIUM' THEN 'regulatoria' ELSE 'primaria' END AS clase,
  CASE o_orderstatus WHEN 'F' THEN 'derogado' WHEN 'P' THEN 'inexequible' ELSE 'vigente' END AS vigencia FROM orders),
cand AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_id) AS pos FROM base)"""
CAPS = {"sentencia": 2, "voto": 0, "regulatoria": 1}
CAPS_SQL = "CASE clase WHEN 'sentencia' THEN 2 WHEN 'voto' THEN 0 WHEN 'regulatoria' THEN 1 END"


def base(spark, d):
    o = table(spark, d, "orders")
    clase = F.when(F.col("o_orderpriority") == "1-URGENT", "sentencia").when(F.col("o_orderpriority") == "2-HIGH", "voto").when(
        F.col("o_orderpriority") == "3-MEDIUM", "regulatoria").otherwise("primaria")
    vigencia = F.when(F.col("o_orderstatus") == "F", "derogado").when(F.col("o_orderstatus") == "P", "inexequible").otherwise("vigente")
    return o.select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 7).alias("doc_id"), F.col("o_orderkey").alias("chunk_id"),
                    R.rounded(F.col("o_totalprice") / 1e6).alias("score"), clase.alias("clase"), vigencia.alias("vigencia"))


def cand(spark, d):
    return R.ranked(base(spark, d))


def keys(df):
    return df.select("qid", "pos", "doc_id", "chunk_id")


@query(f"WITH {BASE_SQL} SELECT qid, pos, doc_id, chunk_id FROM cand WHERE pos <= 5")
def canonical_topk(spark, d):
    """W01, W02, W13."""
    return keys(R.ranked(base(spark, d), 5))


@query(f"""WITH {BASE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score * CASE vigencia WHEN 'derogado' THEN 0.85 WHEN 'inexequible' THEN 0.5 ELSE 1 END, 6) DESC, doc_id, chunk_id) AS p FROM base)
SELECT qid, p AS pos, doc_id, chunk_id, score FROM o""")
def validity_penalty(spark, d):
    """R09."""
    return R.penalise(base(spark, d), {"derogado": 0.85, "inexequible": 0.5}).select("qid", "pos", "doc_id", "chunk_id", "score")


def _caps_sql(cls: str, cap: str, exempt: str, limit: int) -> str:
    return f"""WITH {BASE_SQL},
e AS (SELECT *, {exempt} AS free, row_number() OVER (PARTITION BY qid, {cls}, {exempt} ORDER BY pos) AS rk FROM cand),
k AS (SELECT *, free OR rk <= {cap} AS ok FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ok DESC, pos) AS turn FROM k)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS pos, doc_id, chunk_id FROM t WHERE turn <= {limit}"""


@query(_caps_sql("doc_id", "2", "false", 8))
def per_doc_cap(spark, d):
    """R08, A04, W03."""
    return keys(R.per_document_cap(cand(spark, d), 2, 8))


@query(_caps_sql("clase", f"coalesce({CAPS_SQL}, 0)", f"({CAPS_SQL} IS NULL OR doc_id = 3)", 10))
def type_quota(spark, d):
    """Caps by class, document 3 named."""
    return keys(R.type_quota(cand(spark, d), CAPS, 10, F.col("doc_id") == 3))


@query(f"""WITH {BASE_SQL}, c AS (SELECT * FROM cand WHERE pos <= 6),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM cand WHERE clase = 'primaria'),
m AS (SELECT * FROM p WHERE n <= 3 AND pos > 6),
s AS (SELECT c.qid, count(*) + coalesce(max(k.m), 0) - 6 AS over FROM c LEFT JOIN (SELECT qid, count(*) AS m FROM m GROUP BY qid) k USING (qid) GROUP BY c.qid),
b AS (SELECT c.*, row_number() OVER (PARTITION BY qid, clase = 'primaria' ORDER BY pos DESC) AS back, over FROM c JOIN s USING (qid)),
u AS (SELECT qid, 0 AS part, pos, doc_id, chunk_id FROM b WHERE clase = 'primaria' OR back > over
  UNION ALL SELECT qid, 1, pos, doc_id, chunk_id FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, pos) AS p FROM u)
SELECT qid, p AS pos, doc_id, chunk_id FROM r WHERE p <= 6""")
def guarantee_primaries(spark, d):
    """R13."""
    c = cand(spark, d)
    primaries = R.ranked(c.filter("clase = 'primaria'").withColumnRenamed("pos", "_was"), 3, [F.col("_was")]).drop("pos").withColumnRenamed("_was", "pos")
    return keys(R.guarantee(c.filter("pos <= 6"), primaries, 6, F.col("clase") == "primaria"))


LISTS_SQL = """lists AS (SELECT qid, doc_id, chunk_id, score, 0 AS list_ord, pos FROM cand WHERE pos <= 8
  UNION ALL SELECT qid, doc_id, chunk_id, score, 1, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) FROM cand WHERE chunk_id % 3 <> 0 AND qid % 4 <> 0)"""


def lists(spark, d):
    c = cand(spark, d).select("qid", "doc_id", "chunk_id", "score", "pos")
    second = R.ranked(c.filter("chunk_id % 3 <> 0 AND qid % 4 <> 0"), order=[F.col("chunk_id")])
    return c.filter("pos <= 8").withColumn("list_ord", F.lit(0)).unionByName(second.withColumn("list_ord", F.lit(1)))


RRF_SQL = "SELECT qid, doc_id, chunk_id, sum(1.0::double / (60 + pos)) AS s FROM lists GROUP BY ALL"


@query(f"WITH {BASE_SQL}, {LISTS_SQL}, f AS ({RRF_SQL}) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id, chunk_id) AS pos, doc_id, chunk_id, round(s, 6) AS score FROM f")
def rrf_fusion(spark, d):
    """R06, A03."""
    return R.rrf(lists(spark, d)).select("qid", "pos", "doc_id", "chunk_id", R.rounded("score").alias("score"))


@query(f"""WITH {BASE_SQL}, {LISTS_SQL}, f AS ({RRF_SQL}),
r AS (SELECT c.qid, c.doc_id, c.chunk_id, c.score, row_number() OVER (PARTITION BY c.qid ORDER BY round(f.s, 9) DESC, c.doc_id, c.chunk_id) AS pos
  FROM cand c JOIN f USING (qid, doc_id, chunk_id) WHERE c.pos <= 8) SELECT * FROM r""")
def rrf_reorder(spark, d):
    """R07."""
    both = lists(spark, d)
    base_list, other = both.filter("list_ord = 0"), both.filter("list_ord = 1")
    return R.reorder_with(base_list, other).select("qid", "pos", "doc_id", "chunk_id", "score")


@query(f"""WITH {BASE_SQL}, {LISTS_SQL},
lk AS (SELECT qid, doc_id, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS pos FROM cand WHERE doc_id = 5),
fx AS (SELECT qid, doc_id, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY chunk_id DESC) AS pos FROM cand WHERE clase = 'voto'),
n AS (SELECT qid, count(DISTINCT list_ord) AS k FROM lists GROUP BY qid),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id, chunk_id) AS pos FROM (SELECT * FROM ({RRF_SQL}) JOIN n USING (qid) WHERE k > 1)),
body AS (SELECT qid, doc_id, chunk_id, pos FROM lists JOIN n USING (qid) WHERE k = 1 UNION ALL SELECT qid, doc_id, chunk_id, pos FROM f),
w AS (SELECT qid, doc_id, chunk_id, 0 AS part, pos FROM lk UNION ALL SELECT qid, doc_id, chunk_id, 1, pos FROM body),
o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY qid, doc_id, chunk_id ORDER BY part, pos) = 1),
kept AS (SELECT qid, doc_id, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY part, pos) AS pos FROM o QUALIFY pos <= 5),
more AS (SELECT qid, doc_id, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY pos) AS pos FROM fx ANTI JOIN kept USING (qid, doc_id, chunk_id) QUALIFY pos <= 5),
room AS (SELECT qid, count(*) AS m FROM more GROUP BY qid),
u AS (SELECT qid, doc_id, chunk_id, 0 AS part, pos FROM kept LEFT JOIN room USING (qid) WHERE pos <= 5 - coalesce(m, 0)
  UNION ALL SELECT qid, doc_id, chunk_id, 1, pos FROM more)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY part, pos) AS pos, doc_id, chunk_id FROM u""".replace(
    "AS pos FROM o QUALIFY pos <= 5", "AS pos FROM o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY part, pos) <= 5").replace(
    "USING (qid, doc_id, chunk_id) QUALIFY pos <= 5", "USING (qid, doc_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) <= 5"))
def fuse_final(spark, d):
    """R20, R21, W04, U05, U08."""
    c = cand(spark, d).select("qid", "doc_id", "chunk_id", "score", "pos")
    lookup = R.ranked(c.filter("doc_id = 5"), order=[F.col("chunk_id")])
    fixed = R.ranked(cand(spark, d).filter("clase = 'voto'").select("qid", "doc_id", "chunk_id", "score"), order=[F.col("chunk_id").desc()])
    return keys(R.fuse(lookup, lists(spark, d), fixed, 5))
