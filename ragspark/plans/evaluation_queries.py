"""Queries of evaluation: keys, judges, totals, probes, sweeps and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import evaluation as E
from ragspark.plans.registry import query, table


@query("SELECT o_orderkey AS id, chr((65 + o_orderkey % 4)::int) AS correcta, c_name AS pregunta FROM orders JOIN customer ON c_custkey = o_orderkey")
def answer_key(spark, d):
    """A key with its questions."""
    key = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.chr(65 + F.col("o_orderkey") % 4).alias("correcta"))
    return E.answer_key(key, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("pregunta")))


SUBS = "subs AS (SELECT o_orderkey AS id, 't' || o_orderkey AS texto, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS away FROM orders WHERE o_orderkey % 5 <> 0)"


def _subs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select(
        k.alias("id"), F.concat(F.lit("t"), k.cast("string")).alias("texto"), F.when(k % 7 != 0, k % 3 == 0).alias("abstencion"))


@query(f"""WITH {SUBS} SELECT id, texto, 'p' || id AS pregunta, 'e' AS respuesta_esperada FROM subs WHERE NOT coalesce(away, false) AND id % 2 = 0""")
def judge_input(spark, d):
    """Judged items that were answered."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    key = o.select(k.alias("id"), F.concat(F.lit("p"), k.cast("string")).alias("pregunta"), F.lit("e").alias("respuesta_esperada"))
    return E.to_judge(o.filter("o_orderkey % 2 = 0").select(k.alias("id")), _subs(spark, d), key).select("id", "texto", "pregunta", "respuesta_esperada")


@query("""WITH j AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0::double END AS c FROM orders WHERE o_orderkey % 3 <> 0)
SELECT count(*) AS n_juzgados, count(v.id) AS n_respondidos, count(*) FILTER (WHERE v.id IS NOT NULL AND c IS NULL) AS n_fallidos, round(sum(coalesce(c, 0)) / count(*), 4) AS correctness,
round(30 * sum(coalesce(c, 0)) / count(*), 2) AS puntos FROM j LEFT JOIN v USING (id)""")
def judge_score(spark, d):
    """The judge's points, items without a verdict as nothing."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return E.judge_score(o.filter("o_orderkey % 2 = 0").select(k.alias("id")), o.filter("o_orderkey % 3 <> 0").select(k.alias("id"), F.when(k % 11 != 0, (k % 10) / 10.0).alias("correctness")))


@query("SELECT 14.75::double AS obtenidos, 50.0::double AS posibles")
def total_points(spark, d):
    """Points of the parts that were scored (four parts from ``region``)."""
    part = F.get(F.array(*map(F.lit, ("cerradas", "ragas", "citas", "abstencion"))), F.col("r_regionkey").cast("int"))
    points = F.when(F.col("r_regionkey") != 1, F.col("r_regionkey") * 2.75 + 0.333333)
    rows = table(spark, d, "region").filter("r_regionkey < 4").select(part.alias("parte"), points.alias("puntos"))
    return E.total(rows)


@query("SELECT r_regionkey AS config, n_nationkey AS item, r_regionkey * n_nationkey AS v FROM region, nation")
def config_sweep(spark, d):
    """Every item under every configuration."""
    out = E.sweep(table(spark, d, "region").select(F.col("r_regionkey").alias("config")), table(spark, d, "nation").select(F.col("n_nationkey").alias("item")))
    return out.select("config", "item", (F.col("config") * F.col("item")).alias("v"))


@query("SELECT least(100, count(*)) AS n, true AS distintos FROM customer")
def seeded_sample(spark, d):
    """A sample without replacement (which rows is a matter of the hash, see the tests)."""
    s = E.seeded_sample(table(spark, d, "customer"), 100, "c_custkey")
    return s.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.countDistinct("c_custkey")).alias("distintos"))


LISTS = """p AS (SELECT o_custkey % 60 AS id, o_orderkey % 50 AS doc_id, o_orderkey % 8 AS body, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY o_orderkey) AS pos FROM orders QUALIFY pos <= 12),
a AS (SELECT range AS id, (range * 7) % 50 AS doc_id, range % 8 AS body FROM range(0, 60))"""


def _lists(spark, d):
    from ragspark.operators.ranking import ranked

    o = table(spark, d, "orders").select((F.col("o_custkey") % 60).alias("qid"), (F.col("o_orderkey") % 50).alias("doc_id"), (F.col("o_orderkey") % 8).alias("body"), "o_orderkey")
    p = ranked(o, 12, [F.col("o_orderkey")]).withColumnRenamed("qid", "id")
    return spark.range(60).select("id", (F.col("id") * 7 % 50).alias("doc_id"), (F.col("id") % 8).alias("body")), p


@query(f"""WITH {LISTS}, r AS (SELECT a.id, bool_or(coalesce(p.doc_id = a.doc_id, false)) AS h, bool_or(coalesce(p.doc_id = a.doc_id AND pos = 1, false)) AS f, bool_or(coalesce(p.body = a.body, false)) AS b
 FROM a LEFT JOIN (SELECT * FROM p WHERE pos <= 10) p USING (id) GROUP BY a.id)
SELECT count(*) AS n, round(avg(h::int), 3) AS hit10, round(avg(f::int), 3) AS primero, round(avg(b::int), 3) AS respaldada FROM r""")
def named_probe(spark, d):
    """Does the named document reach the evidence?"""
    a, p = _lists(spark, d)
    return E.named_probe(a, p.withColumn("bodies", F.array("body")).drop("body"))


@query(f"""WITH {LISTS}, e AS (SELECT DISTINCT doc_id, (doc_id + k) % 8 AS body FROM (SELECT DISTINCT doc_id FROM p WHERE doc_id % 3 = 0), (SELECT unnest([0, 3]) AS k)),
f AS (SELECT DISTINCT a.id, a.body, p.doc_id FROM a JOIN p USING (id) WHERE pos <= 10 AND p.doc_id IN (SELECT doc_id FROM e))
SELECT 60::bigint AS n, round(count(*) / 60, 2) AS por_pregunta, round(count(*) FILTER (WHERE (doc_id, body) IN (SELECT (doc_id, body) FROM e)) / count(*), 3) AS citan_la_norma FROM f""")
def topic_probe(spark, d):
    """Harvested documents a question, and the share that cites the norm asked for."""
    a, p = _lists(spark, d)
    docs = p.filter("doc_id % 3 = 0").select("doc_id").distinct()
    edges = docs.select("doc_id", F.explode(F.array((F.col("doc_id") % 8), (F.col("doc_id") + 3) % 8)).alias("body"))
    return E.topic_probe(a.select("id", "body"), p.select("id", "pos", "doc_id"), edges)


@query("""WITH i AS (SELECT o_custkey AS id, list_distinct(list(o_orderkey % 9)) AS r, list_distinct(list((o_orderkey + 1) % 9) FILTER (WHERE o_orderkey % 2 = 0)) AS b, list_distinct(list(o_orderkey % 4)) AS o FROM orders GROUP BY o_custkey)
SELECT count(*) AS n, round(avg((len(list_intersect(r, coalesce(b, []))) > 0)::int), 4) AS body_hit, round(sum(len(list_intersect(r, coalesce(b, []))))::double / sum(len(r)), 4) AS recall, round(avg((len(list_intersect(r, o)) > 0)::int), 4) AS own FROM i""")
def dense_report(spark, d):
    """Hit, recall and own norm of a list, whatever encoder or reranker made it."""
    k = F.col("o_orderkey")
    items = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(k % 9).alias("refs"), F.collect_set(F.when(k % 2 == 0, (k + 1) % 9)).alias("backed"), F.collect_set(k % 4).alias("own"))
    return E.dense_report(items)


@query("""SELECT count(*) AS n, sum(p_size) AS fragmentos, median(p_size)::double AS mediana, max(p_size) AS maximo, round(avg((p_partkey % 3 = 0)::int), 4) AS ponente, round(avg((p_partkey % 4 <> 0)::int), 4) AS decision,
round(sum(p_size % 5)::double / sum(p_size * 10), 4) AS peso_votos FROM part""")
def harvest_report(spark, d):
    """Shares with a flag, median and weight of a harvest."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return E.harvest_report(table(spark, d, "part").select(s.alias("n_fragmentos"), (s * 10).alias("caracteres"), (k % 3 == 0).alias("ponente"), (k % 4 != 0).alias("decision"), (s % 5).alias("votos")))


@query("SELECT lang, source, sum(length(text))::bigint AS caracteres FROM documents GROUP BY ALL")
def characters_by_section(spark, d):
    """Characters by section."""
    return E.characters_by(table(spark, d, "documents"), ["lang", "source"], "text")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def counters_by_kind(spark, d):
    """Counts by kind."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS id, event_type AS etapa, round(sum(value), 6) AS segundos FROM events GROUP BY ALL")
def stage_seconds(spark, d):
    """Seconds by stage."""
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("etapa"), F.col("value").alias("segundos"))
    return E.stage_seconds(e)


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 'o' || (p_partkey % 3) END AS correcta FROM part")
def correct_option(spark, d):
    """The right option of a bank's item."""
    k = F.col("p_partkey") % 3
    options = F.array(*[F.struct(F.lit(f"o{i}").alias("text"), (k == i).alias("is_correct")) for i in range(2)])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), E.correct_option(options).alias("correcta"))


@query("SELECT s_suppkey, '| ' || s_suppkey || ' | ' || s_name || ' | a/b |' AS line FROM supplier")
def markdown_rows(spark, d):
    """A report's rows as Markdown."""
    return E.markdown(table(spark, d, "supplier").withColumn("x", F.lit("a|b")), ["s_suppkey", "s_name", "x"], ["s_suppkey"])
