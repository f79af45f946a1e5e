"""Queries of ingest, resume, manifest and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragspark.operators import ingest as I
from ragspark.operators import segment as S
from ragspark.plans.registry import query, table
from ragspark.plans.text_queries import PARAGRAPHS_SQL
from ragspark.sources.storage import scratch
from ragspark.streaming import resume


@query("""WITH o AS (SELECT o_custkey % 10 AS g, o_orderkey AS n, o_totalprice > 250000 AS hit FROM orders),
l AS (SELECT *, coalesce(max(CASE WHEN hit THEN n END) OVER (PARTITION BY g ORDER BY n), min(n) OVER (PARTITION BY g ORDER BY n) - 1) AS last FROM o),
s AS (SELECT *, coalesce(max((n - last >= 300)::int) OVER (PARTITION BY g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM l)
SELECT g, count(*) AS n, max(n) AS last FROM s WHERE stop = 0 GROUP BY g""")
def gap_terminated_scan(spark, d):
    """S20, W10."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("g"), F.col("o_orderkey").alias("n"), (F.col("o_totalprice") > 250000).alias("hit"))
    return I.until_gap(o, ["g"], "n", "hit", 300).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("last"))


INV_SQL = """inv AS (SELECT s_suppkey AS doc_id, (s_nationkey % 5)::bigint AS ola, CASE s_suppkey % 7 WHEN 0 THEN 'excluido' WHEN 1 THEN 'por_verificar' ELSE 'pendiente' END AS estado,
s_acctbal > 2000 AS con_url, s_acctbal > 5000 AS descargado, s_nationkey + 1 AS peso FROM supplier)"""


def inventory(spark, d):
    k = F.col("s_suppkey") % 7
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_nationkey") % 5).alias("ola"),
        F.when(k == 0, "excluido").when(k == 1, "por_verificar").otherwise("pendiente").alias("estado"),
        (F.col("s_acctbal") > 2000).alias("con_url"), (F.col("s_acctbal") > 5000).alias("descargado"), (F.col("s_nationkey") + 1).alias("peso"))


@query(f"WITH {INV_SQL} SELECT doc_id, ola, coalesce(ola, 9)::bigint AS orden FROM inv WHERE estado NOT IN ('excluido', 'por_verificar') AND ola IN (0, 2, 3)")
def inventory_selection(spark, d):
    """S09."""
    return I.selected(inventory(spark, d), [0, 2, 3]).select("doc_id", "ola", "orden")


@query(f"""WITH {INV_SQL} SELECT ola, count(*) AS documentos, count(*) FILTER (WHERE con_url) AS con_url, count(*) FILTER (WHERE descargado) AS descargados,
round(sum(CASE WHEN descargado THEN peso ELSE 0 END)::double / sum(peso), 4) AS cobertura FROM inv GROUP BY ola""")
def waves_report(spark, d):
    """A06, A07."""
    return I.waves_report(inventory(spark, d))


@query("""WITH c AS (SELECT o_custkey AS id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_totalprice > 150000 AS ok FROM orders)
SELECT id, k, ord AS intentos FROM c WHERE ok QUALIFY ord = min(ord) OVER (PARTITION BY id)""")
def first_valid_candidate(spark, d):
    """S13, S15, S16."""
    c = S.repeat_suffix(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("veces").alias("ord"), "o_totalprice")
    return I.first_valid(c, F.col("o_totalprice") > 150000, ["id"]).select("id", "k", "intentos")


@query(f"""WITH f AS ({PARAGRAPHS_SQL}) SELECT doc_id, count(*) AS fragmentos, sum(length(texto))::bigint AS caracteres, any_value(quality)::bigint AS quality
FROM f LEFT JOIN labels USING (doc_id) GROUP BY doc_id""")
def manifest_build(spark, d):
    """S41, J05, J06."""
    return I.manifest(S.paragraphs(table(spark, d, "documents")), table(spark, d, "labels").select("doc_id", "quality"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copias FROM documents GROUP BY 1")
def dedupe_by_hash(spark, d):
    """S22, T19."""
    return I.deduplicated(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 3 = 0)")
def resume_anti_join(spark, d):
    """J08, S40."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    return I.pending(e, e.filter("user_id % 3 = 0")).select("id")


@query("""WITH a AS (SELECT event_id AS id, user_id FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id AS id FROM events WHERE event_id % 4 <> 0),
l AS (SELECT *, max((id % 997 = 996)::int) OVER (PARTITION BY user_id ORDER BY id) AS bad FROM a SEMI JOIN b USING (id))
SELECT id, user_id FROM l WHERE bad = 0""")
def log_reconcile(spark, d):
    """Both logs, up to the first broken line."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    both = I.reconciled(e.filter("id % 3 <> 0"), e.filter("id % 4 <> 0"))
    return I.readable_prefix(both, ["user_id"], "id", F.col("id") % 997 != 996)


@query("""SELECT year(o_orderdate)::bigint AS anio, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def pivot_counts(spark, d):
    """A19, S45."""
    o = table(spark, d, "orders").withColumn("anio", F.year("o_orderdate"))
    return o.groupBy("anio").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("SELECT n_nationkey::bigint AS n_nationkey, unnest(range(1990 + n_nationkey, 1993 + n_nationkey)) AS anio FROM nation")
def year_range_expansion(spark, d):
    """H10."""
    spec = F.concat_ws("-", (F.col("n_nationkey") + 1990).cast("string"), (F.col("n_nationkey") + 1992).cast("string"))
    return table(spark, d, "nation").select("n_nationkey", F.explode(I.year_range(spec)).alias("anio"))


@query("""SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_event_counts(spark, d):
    """Windows of an hour over the events, with a watermark where they stream."""
    counts = resume.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "10 minutes")
    return counts.select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("SELECT event_id AS id, user_id % 7 AS answer FROM events WHERE event_id % 2 = 0")
def stream_resume(spark, d):
    """The stream answers what has come, and a second run answers nothing again."""
    base = scratch(spark, f"stream-{uuid.uuid4().hex}")
    events = table(spark, d, "events")
    def answer(df):
        return df.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("answer"))
    for _ in range(2):
        resume.answer_stream(spark, f"{d}/events*.parquet", events.schema, answer, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("""WITH b AS (SELECT event_id % 3 AS k, ts FROM events), w AS (SELECT max(ts) FILTER (k = 0) - INTERVAL 10 MINUTE AS one, max(ts) - INTERVAL 10 MINUTE AS two FROM b),
e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type FROM events, w WHERE event_id % 3 < 2 OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > one)
SELECT epoch_ms(start) // 1000 AS start, event_type, count(*) AS n FROM e, w WHERE start + INTERVAL 1 HOUR <= two GROUP BY ALL""")
def streamed_event_counts(spark, d):
    """Windows of a real stream of three batches: events of the third that come behind the watermark of the first are left out, and open windows are not told."""
    base, events = scratch(spark, f"late-{uuid.uuid4().hex}"), table(spark, d, "events")
    source, out = f"{base}/in", f"{base}/out"
    for k in (0, 1, 2):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = resume.windowed_counts(stream, "ts", ["event_type"], "1 hour", "10 minutes").select(F.unix_seconds("start").alias("start"), "event_type", "n")
    query = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)
