"""Queries of text functions and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import ingest as I
from ragspark.operators import fragments as P
from ragspark.operators import segment as S
from ragspark.plans.registry import query, table
from ragspark.sources import html as H

TOKEN_TEXT_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(strip_accents(replace(lower(text), 'ñ', chr(1))), chr(1), 'ñ'),
  '(\\d)[oº°ª]\\b', '\\1', 'g'), '\\b(su|stc|stl|sl|sp|sc|ac|au|c|t)\\s*-\\s*(\\d+)\\b', '\\1_\\2', 'g'),
  '(\\d)[.\\-](\\d)', '\\1_\\2', 'g'), '(\\d)[.\\-](\\d)', '\\1_\\2', 'g')"""
TOKENS_SQL = f"regexp_extract_all({TOKEN_TEXT_SQL}, '[\\p{{L}}\\p{{N}}_]+')"
PIECES_SQL = "list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda p: p <> '')"
PARAGRAPHS_SQL = """SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS texto
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS parts FROM documents)"""


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS norm_sha FROM documents")
def text_norm_accents(spark, d):
    """T01, T02."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.norm(F.col("text")), 256).alias("norm_sha"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)")
def tokens_per_doc(spark, d):
    """T03, T04."""
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def doc_frequency(spark, d):
    """The distinct terms of a document are taken within its row, so one count is shuffled."""
    return table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, len(p) AS n_sentences, sha256(p[1]) AS first_sha FROM (SELECT doc_id, {PIECES_SQL} AS p FROM documents)")
def sentence_split(spark, d):
    """T06, the cut."""
    p = table(spark, d, "documents").select("doc_id", T.sentence_pieces(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_sentences"), F.sha2(F.get("p", F.lit(0)), 256).alias("first_sha"))


@query()
def sentence_rejoin(spark, d):
    """T06 with cuts after abbreviations undone."""
    p = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_sentences"))


@query(f"""WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS piece FROM (SELECT doc_id, {PIECES_SQL} AS p FROM documents)),
c AS (SELECT *, sum(len(regexp_extract_all(piece, '\\S+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM s)
SELECT doc_id, count(*) AS n, sha256(string_agg(piece, ' ' ORDER BY pos)) AS kept_sha FROM c WHERE pos = 1 OR (pos <= 3 AND cum <= 40) GROUP BY doc_id""")
def cap_sentences_words(spark, d):
    """T09."""
    p = table(spark, d, "documents").select("doc_id", T.capped(T.sentence_pieces(F.col("text")), 3, 40).alias("p")).filter(F.size("p") > 0)
    return p.select("doc_id", F.size("p").alias("n"), F.sha2(F.array_join("p", " "), 256).alias("kept_sha"))


@query("""WITH t AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id),
o AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM t a JOIN t b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM o JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE c / (x.n + y.n - c) >= 0.02""")
def jaccard_items(spark, d):
    """Shared words by an equi join, sizes by a second."""
    t = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    n = t.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    x, y = t.toDF("a", "w"), t.toDF("b", "w")
    o = x.join(y, "w").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    j = o.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
    return j.filter("jaccard >= 0.02").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT page_id, length(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g')) AS n_chars FROM pages")
def html_strip_scripts(spark, d):
    """P02."""
    return table(spark, d, "pages").select("page_id", F.length(T.strip_scripts(F.col("html"))).alias("n_chars"))


@query("SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY host")
def page_hosts(spark, d):
    """S42, J17."""
    return table(spark, d, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, CASE WHEN ends_with(h, '.com') THEN 'com' WHEN ends_with(h, '.org') THEN 'org' ELSE 'none' END AS source
FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1) AS h FROM pages)""")
def source_by_host_suffix(spark, d):
    """The first ending that fits."""
    return table(spark, d, "pages").select("page_id", I.source_of(F.col("url"), F.lit("none"), ((".com", "com"), (".org", "org"))).alias("source"))


@query("""SELECT page_id, CASE WHEN contains(url, 'corteconstitucional.gov.co') THEN 'corte_constitucional'
WHEN ends_with(lower(url), '.pdf') THEN 'pdf' ELSE 'manual' END AS parser FROM pages""")
def parser_routing(spark, d):
    """S14, P01."""
    return table(spark, d, "pages").select("page_id", I.parser_of(F.col("url")).alias("parser"))


@query("SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def html_links(spark, d):
    """Links of a page."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).alias("n_links"), F.array_join(links, " ").alias("links"))


@query()
def html_to_blocks(spark, d):
    """Blocks with their kind and heading path, by one generic reader."""
    return H.blocks(table(spark, d, "pages"))


@query(f"""WITH f AS ({PARAGRAPHS_SQL})
SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id,
  coalesce(sum(length(texto) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS inicio,
  (coalesce(sum(length(texto) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(texto))::bigint AS fin,
  sha256(texto) AS sha FROM f""")
def paragraph_fragments(spark, d):
    """S28, S29, W05, W11."""
    f = S.dense_ids(S.offsets(S.paragraphs(table(spark, d, "documents"))), ["doc_id", "pos"])
    return f.select("doc_id", "pos", "chunk_id", "inicio", "fin", F.sha2("texto", 256).alias("sha"))


@query(f"""WITH f AS (SELECT *, length(texto) % 3 AS k FROM ({PARAGRAPHS_SQL}))
SELECT doc_id, pos, k, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) - 1 AS parte, count(*) OVER (PARTITION BY doc_id, k) AS n_partes FROM f""")
def fragment_parts(spark, d):
    """W07."""
    f = S.paragraphs(table(spark, d, "documents")).withColumn("k", F.length("texto") % 3)
    return S.parts_of(f, ["doc_id", "k"]).select("doc_id", "pos", "k", "parte", "n_partes")


@query(r"""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, true AS entero, true AS cabe FROM p WHERE len(l) > 0""")
def greedy_pack_parts(spark, d):
    """Packed parts hold every paragraph, in order, within the limit."""
    lines = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    docs = table(spark, d, "documents").select("doc_id", lines.alias("l")).filter(F.size("l") > 0).withColumn("p", P.parts(F.col("l")))
    whole = F.regexp_replace(F.array_join("p", ""), r"\s+", "") == F.regexp_replace(F.array_join("l", ""), r"\s+", "")
    return docs.select("doc_id", whole.alias("entero"), F.forall("p", lambda x: F.length(x) <= P.MAX_CHARS).alias("cabe"))


@query(f"SELECT doc_id, pos, true AS entero, true AS cabe FROM ({PARAGRAPHS_SQL})")
def split_long_paragraphs(spark, d):
    """Pieces of a long paragraph hold all of it, within the limit."""
    rows = S.paragraphs(table(spark, d, "documents")).withColumn("p", P.parts(F.array("texto"), 400))
    whole = F.regexp_replace(F.array_join("p", ""), r"\s+", "") == F.regexp_replace("texto", r"\s+", "")
    return rows.select("doc_id", "pos", whole.alias("entero"), F.forall("p", lambda x: F.length(x) <= 400).alias("cabe"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS veces,
CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1
 THEN '~' || row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) ELSE '' END AS sufijo FROM orders""")
def repeated_key_suffix(spark, d):
    """W06."""
    return S.repeat_suffix(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "veces", "sufijo")


@query("""SELECT * FROM (SELECT o_orderkey, o_orderkey % 97 AS n, lag(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS anterior FROM orders)
WHERE n > anterior + 1 OR n < anterior""")
def numbering_gaps(spark, d):
    """P15, W08."""
    rows = table(spark, d, "orders").withColumn("n", F.col("o_orderkey") % 97)
    return S.numbering_gaps(rows, ["o_custkey"], ["o_orderkey"], "n").select("o_orderkey", "n", "anterior")


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY sha HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """A17."""
    return I.duplicate_keys(table(spark, d, "documents").select(F.sha2("text", 256).alias("sha")), "sha")


@query("""WITH l AS (SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT source, line FROM l GROUP BY ALL HAVING count(DISTINCT page) >= 3 AND length(line) < 120)
SELECT source, count(*) AS n_lines, sum(length(line))::bigint AS n_chars FROM l ANTI JOIN h USING (source, line) GROUP BY source""")
def running_headers_removed(spark, d):
    """P12, A18."""
    lines = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    return S.without_running_headers(lines).groupBy(F.col("doc_id").alias("source")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS pregunta
FROM conversations""")
def carry_forward_header(spark, d):
    """W09."""
    rows = table(spark, d, "conversations")
    return S.carried_forward(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "pregunta").select("conv_id", "turn", "pregunta")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'inexequible' WHEN quality = 0 THEN 'derogado' WHEN quality = 1 THEN 'modificado' ELSE 'vigente' END AS vigencia
FROM documents LEFT JOIN labels USING (doc_id)""")
def vigencia_status(spark, d):
    """P21."""
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    marks = F.when(F.col("toxic") == 1, F.lit("INEXEQUIBLE"))
    notes = F.when(F.col("quality") == 0, F.lit("Artículo derogado")).when(F.col("quality") == 1, F.lit("Artículo modificado"))
    return joined.select("doc_id", S.validity(marks, notes).alias("vigencia"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + floor(value * 10)::bigint + 60 AS b FROM events),
m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS s FROM e),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, g""")
def merge_intervals(spark, d):
    """W15, T24."""
    e = table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("a"), F.floor(F.col("value") * 10).alias("w"))
    return S.merged_intervals(e.select("user_id", "a", (F.col("a") + F.col("w") + 60).alias("b")), ["user_id"], "a", "b")


@query("SELECT part, regexp_replace(part, '^0+([0-9])', '\\1') AS clave FROM (SELECT lpad(p_partkey::varchar, 8, '0') AS part FROM part)")
def inventory_match_key(spark, d):
    """H01."""
    part = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return table(spark, d, "part").select(part.alias("part"), I.inventory_key(F.lit(None), part, F.lit(None)).alias("clave"))


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugs(spark, d):
    """P26."""
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))
