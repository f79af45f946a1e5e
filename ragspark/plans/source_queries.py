"""Queries of sources and sinks, of readers, and of the text functions that have no query elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import text as T
from ragspark.operators import fragments as S
from ragspark.plans.registry import query, table
from ragspark.sources import lines as L
from ragspark.sources import norms as N
from ragspark.sources import pages as P
from ragspark.sources import records as R
from ragspark.sources import rulings as G
from ragspark.sources.storage import scratch, stored


@query("SELECT o_orderkey AS id, 'x' || o_custkey AS t, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice::double END AS v, (SELECT count(*) FROM orders) AS n FROM orders")
def jsonl_roundtrip(spark, d):
    """JSON lines out, with their number, and in again."""
    path, k = scratch(spark, f"jsonl-{uuid.uuid4().hex}"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("t"), F.when(k % 3 != 0, F.col("o_totalprice").cast("double")).alias("v"))
    n = R.write_jsonl(rows, path, ["id"])
    return R.read_jsonl(spark, path, rows.schema).withColumn("n", F.lit(n).cast("long"))


@query("SELECT o_orderkey AS id, 'a' || o_orderkey AS a FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def run_log(spark, d):
    """A run of two appends, finished items in both logs, sorted."""
    path, k = scratch(spark, f"run-{uuid.uuid4().hex}"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("a"), k.cast("string")).alias("a"))
    for part in (0, 1):
        own = rows.filter(F.col("id") % 2 == part)
        R.append_run(own.filter("id % 3 <> 0"), own.filter("id % 5 <> 0").withColumnRenamed("a", "t"), path)
    trace = rows.withColumnRenamed("a", "t").schema
    R.finalise_run(spark, path, rows.schema, trace)
    return R.finished(spark, path, rows.schema, trace)[0]


@query("""SELECT p_partkey // 10 AS doc, p_partkey AS n, 'ARTÍCULO ' || p_partkey || '. ' || p_name AS texto FROM part""")
def senate_articles(spark, d):
    """Pages of ten rows of ``part`` as articles, in order."""
    k = F.col("p_partkey")
    line = F.concat(F.lit('<p><a class="bookmarkaj">ARTÍCULO '), k.cast("string"), F.lit("o.</a> "), F.col("p_name"), F.lit("</p>"))
    pages = table(spark, d, "part").groupBy(F.floor(k / 10).alias("doc")).agg(F.array_sort(F.collect_list(F.struct(k, line.alias("h")))).alias("l")).select(
        F.col("doc").cast("string").alias("doc_id"), F.lit(0).alias("ord"),
        F.concat(F.lit("<!--Inicio documento-->"), F.array_join(F.transform("l", lambda x: x["h"]), ""), F.lit("<!--Fin documento-->")).alias("contenido"), F.lit(None).cast("string").alias("notas_js"))
    found = N.senate(pages)
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.col("articulo").cast("long").alias("n"), F.regexp_replace("texto", r"^(ARTÍCULO \d+)o", "$1").alias("texto"))


@query("SELECT o_orderkey AS id, 'Sala: X' AS x, o_custkey::varchar AS tipo, 't ' || o_orderkey AS resto FROM orders")
def card_fields(spark, d):
    """The labelled fields of a card, and its title."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("Ponente: Sala: X  Tipo: "), c, F.lit(" Estado: Sala Tipo: y Titulación t "), k)
    m = R.card_fields(text, ["Ponente", "Tipo", "Estado"], "Titulación")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), m["Ponente"].alias("x"), m["Tipo"].alias("tipo"), m["Titulación"].alias("resto"))


@query("SELECT o_orderkey AS id, 'Rige el Código Sustantivo del Trabajo y el Estatuto Tributario. Dos.' AS limpio, len(string_split('Rige el Código Sustantivo del Trabajo y el Estatuto Tributario. Dos.', ' ')) AS palabras, make_date(2000 + o_orderkey % 20, 1 + o_orderkey % 12, 1 + o_orderkey % 28)::varchar AS fecha FROM orders")
def text_helpers(spark, d):
    """Cleaned text, words and long dates."""
    months = F.array(*map(F.lit, T.MONTHS))
    k = F.col("o_orderkey")
    date = F.concat(F.lit("Bogotá, "), (k % 28 + 1).cast("string"), F.lit(" de "), F.get(months, (k % 12).cast("int")), F.lit(" de "), (k % 20 + 2000).cast("string"))
    said = F.lit("según la evidencia, rige el CST y el E.T. (pasaje 3). dos.")
    clean = T.clean(said)
    return table(spark, d, "orders").select(k.alias("id"), clean.alias("limpio"), T.word_count(clean).alias("palabras"), T.spanish_date(date).cast("string").alias("fecha"))


@query("SELECT o_orderkey AS id, 'q' || o_orderkey || chr(10) || 'uno' || chr(10) || 'dos' AS busqueda, 'a > ' || repeat('x', 80) || '…' AS ruta, 'a b' AS limpio, 'a+b' AS simbolos, 'Años' AS codigo FROM orders")
def text_repairs(spark, d):
    """Search text, paths, white space, symbols and double encoding."""
    k = F.col("o_orderkey").cast("string")
    options = F.create_map(F.lit("B"), F.lit("dos"), F.lit("A"), F.lit("uno"))
    level = F.concat(F.repeat(F.lit("x"), F.lit(80)), F.lit(" "), F.repeat(F.lit("y"), F.lit(30)))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), R.search_text(F.concat(F.lit("q"), k), options).alias("busqueda"), S.path(F.array(F.lit("a"), level)).alias("ruta"),
        T.clean_spaces(F.lit(" a ​ b ")).alias("limpio"), T.repaired_symbols(F.lit("ab")).alias("simbolos"), T.repaired_encoding(F.lit("AÃ±os")).alias("codigo"))


@query("SELECT o_orderkey AS id, 'contrat' AS raiz, 'nacional' AS adverbio FROM orders")
def stems(spark, d):
    """Tokens of an index, without stop words, as stems."""
    terms = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.index_terms(F.concat(F.lit("Los contratos nacionalmente de la "), F.substring("o_orderstatus", 1, 0))).alias("t"))
    return terms.select("id", F.get("t", F.lit(0)).alias("raiz"), F.get("t", F.lit(1)).alias("adverbio"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 10 = 9 THEN o_orderkey - 9 ELSE o_orderkey + 1 END AS nxt FROM orders),
c AS (SELECT o_orderkey AS doc_id, o_orderkey AS url, 0 AS paso, [o_orderkey] AS seen FROM orders WHERE o_orderkey % 10 = 5
 UNION ALL SELECT c.doc_id, o.nxt, c.paso + 1, list_append(c.seen, o.nxt) FROM c JOIN o USING (url) WHERE o.nxt IS NOT NULL AND NOT list_contains(c.seen, o.nxt) AND c.paso + 1 < 8)
SELECT doc_id, url, paso::bigint AS paso FROM c""")
def chained_pages(spark, d):
    """Pages by their links to the next, rings cut, no more than the cap."""
    from ragspark.operators.ingest import chained

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    links = o.select(k.alias("url"), F.when(k % 11 == 0, None).when(k % 10 == 9, k - 9).otherwise(k + 1).alias("next"))
    return chained(o.filter("o_orderkey % 10 = 5").select(k.alias("doc_id"), k.alias("url")), links, 8)


@query("""WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS chunk_id FROM orders) SELECT chunk_id, doc_id FROM o""")
def chunks_in_ranges(spark, d):
    """The document whose range of chunks holds a chunk."""
    from ragspark.operators import retrieval as V
    from ragspark.operators.segment import dense_ids

    rows = stored(dense_ids(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "chunk_id"), "chunks")
    ranges = V.document_ranges(rows.select(F.col("o_custkey").alias("doc_id"), "chunk_id"))
    return V.rows_in_ranges(rows.select("chunk_id"), ranges).select("chunk_id", "doc_id")


@query("""SELECT p_partkey AS id, u.s AS seccion, CASE u.s WHEN 'antecedentes' THEN 'I. ANTECEDENTES|hecho ' || p_name || '.' WHEN 'consideraciones' THEN 'II. CONSIDERACIONES|razón.|3. ANTECEDENTES' ELSE 'III. DECISIÓN|Declarar ' || p_partkey || '.' END AS texto
FROM part, (SELECT unnest(['antecedentes', 'consideraciones', 'decision']) AS s) u""")
def ruling_sections(spark, d):
    """Pages of rulings by sections that only go forward."""
    k = F.col("p_partkey")
    lines = F.array(F.lit("Magistrado Ponente: Juan Pérez"), F.lit("SENTENCIA"), F.lit("I. ANTECEDENTES"), F.concat(F.lit("hecho "), F.col("p_name"), F.lit(".")), F.lit("I. ANTECEDENTES.......... 3"),
                    F.lit("II. CONSIDERACIONES"), F.lit("razón."), F.lit("3. ANTECEDENTES"), F.lit("III. DECISIÓN"), F.concat(F.lit("Declarar "), k.cast("string"), F.lit(".")))
    page = F.concat(F.lit("<body><p>"), F.array_join(lines, "</p><p>"), F.lit("</p></body>"))
    found = G.sections_of(table(spark, d, "part").select(k.alias("id"), page.alias("pagina")), "id", "pagina")
    return found.select("id", "seccion", "texto")


@query("""SELECT p_partkey AS id, 'cap num. 1.1' AS articulo, '1.1. ' || p_name || '|más' AS texto FROM part UNION ALL SELECT p_partkey, 'cap num. 1.2', '1.2. fin ' || p_partkey FROM part""")
def circular_numerals(spark, d):
    """Numerals of a circular, its table of contents left out."""
    k = F.col("p_partkey").cast("string")
    text = F.concat_ws("\n", F.lit("CAPÍTULO II"), F.lit("CONTENIDO"), F.lit("1. OBJETO ....."), F.lit("CAPÍTULO II"), F.lit("1. OBJETO GENERAL"), F.concat(F.lit("1.1. "), F.col("p_name")), F.lit("más"), F.concat(F.lit("1.2. fin "), k))
    return _articles(table(spark, d, "part"), k, "sfc_cbj", "cap.docx", text)


@query("""SELECT p_partkey AS id, '1A' AS articulo, 'Artículo 1 A. ' || p_name || '|dos' AS texto FROM part UNION ALL SELECT p_partkey, 'TRANSITORIO 2', 'Artículo transitorio 2|tres ' || p_partkey FROM part""")
def markdown_articles(spark, d):
    """Laws in Markdown with a head, signatures left out."""
    k = F.col("p_partkey").cast("string")
    text = F.concat_ws("\n", F.lit("---"), F.lit("source: x"), F.lit("---"), F.lit("## LIBRO I"), F.concat(F.lit("##### Artículo 1 A. **"), F.col("p_name"), F.lit("**")), F.lit("- dos"),
                       F.lit("##### Artículo transitorio 2"), F.concat(F.lit("tres "), k), F.lit("Dado en Bogotá"), F.lit("El ministro"))
    return _articles(table(spark, d, "part"), k, "legalize", "x.md", text)


def _articles(rows, key, parser, name, text):
    pages = rows.select(key.alias("doc_id"), F.lit(0).alias("ord"), F.lit(name).alias("nombre"), text.alias("contenido"))
    found = N.documents(N.READERS[parser](pages)).select(F.col("doc_id").cast("long").alias("id"), F.explode("articulos").alias("a"))
    return found.select("id", "a.articulo", F.array_join("a.parrafos", "|").alias("texto"))


#: Lines of a document, each under a title that its length chooses.
TITLES = ("I. ANTECEDENTES", "II. PRUEBAS", "III. CONSIDERACIONES", "2. ANTECEDENTES", "IV. DECISIÓN", "SALVAMENTO DE VOTO", "ANEXO 1", "3.1 El caso")
TITLE_OF = ("antecedentes", "pruebas", "consideraciones", "antecedentes", "decision", "salvamento_voto", "anexo", None)
LINES_SQL = """l AS (SELECT doc_id, i, length(x) AS size, (length(x) + doc_id) % 8 AS k FROM (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def document_lines(spark, d):
    """(doc_id, i, size, k) of the lines of ``documents``, ``i`` from 1."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    size = F.length("x")
    return rows.select("doc_id", (F.col("i") + 1).alias("i"), size.alias("size"), ((size + F.col("doc_id")) % 8).cast("int").alias("k"))


@query(f"""WITH {LINES_SQL},
r AS (SELECT doc_id, 2 * i AS pos, ['{"', '".join(TITLES)}'][k + 1] AS texto, ['{"', '".join(x or "-" for x in TITLE_OF)}'][k + 1] AS s FROM l
  UNION ALL SELECT doc_id, 2 * i + 1, CASE WHEN size % 11 = 0 THEN 'Notifíquese y cúmplase.' WHEN size % 13 = 0 THEN 'EL SUSCRITO SECRETARIO' ELSE 'línea de ' || size || ' letras.' END, NULL FROM l),
o AS (SELECT *, CASE s WHEN 'antecedentes' THEN 2 WHEN 'pruebas' THEN 7 WHEN 'consideraciones' THEN 8 WHEN 'decision' THEN 9 WHEN 'salvamento_voto' THEN 10 WHEN 'anexo' THEN 11 END AS o FROM r),
m AS (SELECT *, coalesce(max(CASE WHEN o < 11 THEN o END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM o),
b AS (SELECT *, coalesce(CASE o WHEN 11 THEN far >= 9 WHEN 10 THEN true ELSE o > far END, false) AS opens FROM m),
n AS (SELECT *, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM b),
c AS (SELECT *, coalesce(max(CASE WHEN opens THEN s END) OVER (PARTITION BY doc_id, n), 'cuerpo') AS seccion FROM n),
e AS (SELECT *, min(CASE WHEN NOT opens AND (texto = 'EL SUSCRITO SECRETARIO' OR (seccion = 'decision' AND texto LIKE 'Notif%')) THEN pos END) OVER (PARTITION BY doc_id, n) AS stop FROM c),
kept AS (SELECT *, CASE WHEN NOT opens AND seccion <> 'decision' AND (texto IN ('2. ANTECEDENTES', '3.1 El caso', 'I. ANTECEDENTES', 'II. PRUEBAS', 'III. CONSIDERACIONES', 'IV. DECISIÓN')) THEN texto END AS sub
  FROM e WHERE opens OR ((stop IS NULL OR pos <= stop) AND texto <> 'EL SUSCRITO SECRETARIO'))
SELECT doc_id AS id, n::bigint AS n, seccion, count(*) AS parrafos, md5(string_agg(texto, '|' ORDER BY pos)) AS hash, count(DISTINCT sub) AS subtitulos FROM kept GROUP BY doc_id, n, seccion""")
def rulings_by_section(spark, d):
    """Pages made of the lines of ``documents``, with notes at the foot, by sections that only go forward."""
    title = F.element_at(F.array(*[F.lit(x) for x in TITLES]), F.col("k") + 1)
    said = F.when(F.col("size") % 11 == 0, "Notifíquese y cúmplase.").when(F.col("size") % 13 == 0, "EL SUSCRITO SECRETARIO").otherwise(
        F.concat(F.lit("l&iacute;nea&nbsp;de "), F.col("size").cast("string"), F.lit(' letras.<a href="#_ftn1" name="_ftnref1">[1]</a>')))
    html = F.concat(F.lit("<p class=MsoNormal>"), title, F.lit("</p>\n<p>"), said, F.lit("</p>"))
    pages = document_lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", html.alias("h")))).alias("l")).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("<html><head><style>p {}</style></head><body><p>SENTENCIA</p>"), F.array_join(F.transform("l", lambda x: x["h"]), "\n"),
                                              F.lit("<div id=ftn1><p>[1] Nota al pie.</p></div></body></html>")).alias("html"))
    rows = G.sections(G.paragraphs(pages, "id", "html"), "id")
    listed = F.array_sort(F.collect_list(F.struct("pos", "texto")))
    return rows.groupBy("id", "n", "seccion").agg(F.count(F.lit(1)).alias("parrafos"), F.md5(F.array_join(F.transform(listed, lambda x: x["texto"]), "|")).alias("hash"), F.countDistinct("sub").alias("subtitulos"))


@query("""WITH h AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 4 AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN 'Ana Gil|Luz de la Paz' WHEN 1 THEN 'Eva Mar' ELSE '' END AS ponentes, CASE WHEN k = 3 THEN 'fallo de mayo de ' || (1990 + c % 30) ELSE 'Bogotá, D.C., ' || (1 + c % 28) || ' de mayo de 2010' END AS fecha,
  CASE WHEN k <> 2 THEN 'Expediente D-' || c END AS referencia, CASE WHEN k = 2 THEN 'Actor: X' ELSE 'Actor: X|otra línea ' || c END AS otros,
  CASE WHEN k = 3 THEN 'fallo de mayo de ' || (1990 + c % 30) || '|' ELSE '' END || 'DERECHO-' || c || CASE WHEN k = 2 THEN '|otra línea ' || c ELSE '' END AS descriptores FROM h""")
def ruling_cards(spark, d):
    """Judges, date, reference, the rest and the descriptors of pages made of ``orders``."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    judges = F.when(k == 0, "<p>Magistrada ponente:</p><p>Dra. Ana Gil</p><p>Luz de la Paz</p>").when(k == 1, "<p>Magistrado sustanciador: Eva Mar.</p>").otherwise("")
    reference = F.when(k != 2, F.concat(F.lit("<p>Expediente D-"), c, F.lit("</p>"))).otherwise("")
    date = F.when(k == 3, "").otherwise(F.concat(F.lit("<p>Bogotá, D.C., "), (1 + F.col("o_custkey") % 28).cast("string"), F.lit(" de mayo de 2010.</p>")))
    old = F.when(k == 3, F.concat(F.lit("<p>fallo de mayo de "), (1990 + F.col("o_custkey") % 30).cast("string"), F.lit("</p>"))).otherwise("")
    html = F.concat(F.lit("<body><p>CORTE CONSTITUCIONAL</p><p>DERECHO-"), c, F.lit("</p>"), F.lit("<p>Sentencia C-1/20</p>"), reference, judges, date,
                    F.lit("<p>Actor: X</p><p>La Sala ha proferido</p><p>otra línea "), c, F.lit("</p><p>SENTENCIA</p><p>texto</p></body>"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 3, F.replace(html, F.lit("<p>CORTE CONSTITUCIONAL</p>"), old)).otherwise(html).alias("html"))
    found = G.cards(G.paragraphs(rows, "id", "html"), "id")
    return found.select("id", *[F.array_join(x, "|").alias(x) if x in ("ponentes", "otros", "descriptores") else F.col(x) for x in ("ponentes", "fecha", "referencia", "otros", "descriptores")])


@query(r"""WITH cut AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style|head\b.*?</head)\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
    '(?i)<(p|h[1-6]|li|ol|ul|table|tr|td|th|div|blockquote|center|body|/table|/ol|/ul|/div)\b', chr(1) || '<\1', 'g'), chr(1)) AS ps FROM pages),
piece AS (SELECT page_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS piece FROM cut),
shut AS (SELECT page_id, k, lower(regexp_extract(piece, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag,
  regexp_replace(regexp_replace(regexp_replace(piece, '(?is)^(<p\b.*?</p\s*>).*$', '\1'), '(?is)^(<h1\b.*?</h1\s*>).*$', '\1'), '(?is)^(<li\b.*?</li\s*>).*$', '\1') AS piece FROM piece),
said AS (SELECT page_id, k, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(piece, '<[^>]*>?', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x0B\x{00A0}]+', ' ', 'g')) AS texto FROM shut),
rows AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS pos, length(texto) % 6 AS rango FROM said WHERE texto <> ''),
seen AS (SELECT a.page_id, a.pos, b.rango, left(b.texto, 12) AS label FROM rows a JOIN rows b ON a.page_id = b.page_id AND b.pos <= a.pos AND b.rango < 5
  WHERE NOT EXISTS (SELECT 1 FROM rows c WHERE c.page_id = b.page_id AND c.pos > b.pos AND c.pos <= a.pos AND c.rango <= b.rango))
SELECT r.page_id, r.pos, r.tag, md5(r.texto) AS hash, coalesce(string_agg(label, ' > ' ORDER BY s.rango), '') AS ruta
FROM rows r LEFT JOIN seen s ON s.page_id = r.page_id AND s.pos = r.pos GROUP BY r.page_id, r.pos, r.tag, r.texto""")
def page_heading_paths(spark, d):
    """Blocks of ``pages`` by column functions, and the path of headings at each, where the length of a block makes its rank."""
    rows = P.blocks(table(spark, d, "pages"), ["page_id"], P.without(F.col("html"), *P.NOISE[:3]))
    rank = F.length("texto") % 6
    rows = rows.withColumns({"rango": F.when(rank < 5, rank.cast("double")), "etiqueta": F.substring("texto", 1, 12)})
    found = P.paths(rows, (0.0, 1.0, 2.0, 3.0, 4.0), ["page_id"])
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return found.select("page_id", pos.alias("_pos"), "tag", F.md5("texto").alias("hash"), F.array_join("ruta", " > ").alias("ruta")).withColumnRenamed("_pos", "pos")


DOTTED_SQL = """n AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 3 + 1 AS a, o_orderkey % 12 + 1 AS b, o_orderkey % 7 = 0 AS colon,
  o_orderkey % 29 = 0 AS ancla FROM orders), q AS (SELECT *, [2, 2, a, b] AS clave, coalesce(lag(colon) OVER (PARTITION BY doc ORDER BY i), false) AS quoted FROM n)"""


@query(f"""WITH RECURSIVE {DOTTED_SQL},
f(doc, i, last, taken) AS (
  SELECT doc, 0, NULL::BIGINT[], false FROM (SELECT DISTINCT doc FROM q)
  UNION ALL
  SELECT g.doc, g.i, CASE WHEN ok THEN clave ELSE last END, ok
  FROM (SELECT q.doc, q.i, q.clave, f.last, q.ancla OR (NOT q.quoted AND (f.last IS NULL OR q.clave > f.last)) AS ok FROM f JOIN q ON q.doc = f.doc AND q.i = f.i + 1) g
)
SELECT q.doc, '2.2.' || a || '.' || b AS articulo, q.i AS lugar FROM f JOIN q ON q.doc = f.doc AND q.i = f.i WHERE taken""")
def dotted_articles(spark, d):
    """Articles with dotted numbers, in pages made of ``orders``; quoted ones (behind a colon) and those that step back stay text."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    number = F.concat_ws(".", F.lit("2.2"), (k % 3 + 1).cast("string"), (k % 12 + 1).cast("string"))
    tail = F.when(k % 7 == 0, "Este artículo quedará así:").otherwise("Texto del artículo que rige.")
    line = F.concat(F.lit("<p>"), F.when(k % 29 == 0, '<a id="x"></a>').otherwise(""), F.lit("ARTÍCULO "), number, F.lit(". "), tail, F.lit("</p>"))
    pages = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(k, line.alias("h")))).alias("l")).select(
        F.col("doc").cast("string").alias("doc_id"), F.lit(0).alias("ord"),
        F.concat(F.lit('<div class="descripcion-contenido">'), F.array_join(F.transform("l", lambda x: x["h"]), ""), F.lit("</div>")).alias("contenido"))
    rows = N.manager(pages)
    place = rows.withColumns({"lugar": F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")), "_first": F.row_number().over(Window.partitionBy("doc_id", "n").orderBy("pos"))})
    return place.filter("n > 0 AND _first = 1").select(F.col("doc_id").cast("long").alias("doc"), "articulo", "lugar")


@query(f"""WITH {LINES_SQL},
t AS (SELECT doc_id, i, CASE k WHEN 0 THEN '' WHEN 1 THEN 'a)' WHEN 2 THEN '- ' || size % 100 || ' -' WHEN 3 THEN 'Artículo ' || i || '.- De ' || size WHEN 4 THEN 'palabra parti-' WHEN 5 THEN 'da y ' || size ELSE 'texto ' || size || '.' END AS x FROM l),
u AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM t WHERE x NOT LIKE '- %'),
g AS (SELECT *, sum((x <> '' AND (x LIKE 'Art%' OR x = 'a)' OR coalesce(b, '') IN ('', 'a)')))::int) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u),
p AS (SELECT doc_id, k, regexp_replace(string_agg(x, ' ' ORDER BY i), '([a-záéíóúñ])- ([a-záéíóúñ])', '\\1\\2', 'g') AS x FROM g WHERE x <> '' GROUP BY doc_id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM p),
m AS (SELECT *, n - coalesce(max(CASE WHEN x <> 'a)' THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM r),
q AS (SELECT *, sum((before % 2 = 0)::int) OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM m)
SELECT doc_id, pos::bigint AS pos, string_agg(x, ' ' ORDER BY n) AS texto FROM q GROUP BY doc_id, pos""")
def law_lines(spark, d):
    """Paragraphs of a line table made of ``documents``: page numbers out, broken words joined, lone markers glued to what follows."""
    size, k = F.col("size").cast("string"), F.col("k")
    text = (F.when(k == 0, "").when(k == 1, "a)").when(k == 2, F.concat(F.lit("- "), (F.col("size") % 100).cast("string"), F.lit(" -"))).when(k == 3, F.concat(F.lit("Artículo "), F.col("i").cast("string"), F.lit(".- De "), size))
            .when(k == 4, "palabra parti-").when(k == 5, F.concat(F.lit("da y "), size)).otherwise(F.concat(F.lit("texto "), size, F.lit("."))))
    return L.law_paragraphs(document_lines(spark, d).select("doc_id", F.floor(F.col("i") / 10).alias("pagina"), F.col("i").alias("linea"), text.alias("texto")))


@query(f"""WITH {LINES_SQL},
t AS (SELECT doc_id, i // 5 AS pagina, 2 * i AS linea, CASE WHEN k < 2 THEN 'sigue en la línea ' || size WHEN k < 6 THEN 'termina ' || size || '.' ELSE 'cierra (SC' || size % 1000 || '-2018; 1/2/2019)' END AS x FROM l
  UNION ALL SELECT doc_id, i // 5, 2 * i + 1, CASE WHEN doc_id % 2 = 0 THEN 'Cabecera de la relatoría' ELSE 'Pie.' END FROM l WHERE i % 5 = 1 OR (i % 5 = 2 AND k = 0)),
n AS (SELECT doc_id, count(DISTINCT pagina) AS pages FROM t GROUP BY doc_id),
h AS (SELECT doc_id, x FROM t JOIN n USING (doc_id) GROUP BY doc_id, x, pages HAVING count(DISTINCT pagina) >= 0.6 * pages),
u AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY linea) AS b FROM t ANTI JOIN h USING (doc_id, x)),
g AS (SELECT *, sum((b IS NULL OR b LIKE '%.' OR b LIKE '%)')::int) OVER (PARTITION BY doc_id ORDER BY linea) AS pos FROM u),
p AS (SELECT doc_id, pos, string_agg(x, ' ' ORDER BY linea) AS x FROM g GROUP BY doc_id, pos),
c AS (SELECT *, coalesce(sum((x LIKE '%2019)')::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS e, sum((x LIKE '%2019)')::int) OVER (PARTITION BY doc_id) AS total FROM p),
f AS (SELECT *, least(e, total) AS n FROM c WHERE total > 0)
SELECT doc_id, n::bigint AS n, max(regexp_extract(x, '\\((SC\\d+-2018); 1/2/2019\\)$', 1)) AS titulo, count(*) AS parrafos, md5(string_agg(x, '|' ORDER BY pos)) AS hash FROM f GROUP BY doc_id, n""")
def digest_extracts(spark, d):
    """Extracts of a digest made of the lines of ``documents``: headers by their share of the pages, extracts over page ends, the tail with the last."""
    rows, size, k = document_lines(spark, d), F.col("size").cast("string"), F.col("k")
    said = F.when(k < 2, F.concat(F.lit("sigue en la línea "), size)).when(k < 6, F.concat(F.lit("termina "), size, F.lit("."))).otherwise(
        F.concat(F.lit("cierra (SC"), (F.col("size") % 1000).cast("string"), F.lit("-2018; 1/2/2019)")))
    page = F.floor(F.col("i") / 5)
    text = rows.select("doc_id", page.alias("pagina"), (2 * F.col("i")).alias("linea"), said.alias("texto"))
    head = F.when(F.col("doc_id") % 2 == 0, "Cabecera de la relatoría").otherwise("Pie.")
    more = rows.filter("i % 5 = 1 OR (i % 5 = 2 AND k = 0)").select("doc_id", page.alias("pagina"), (2 * F.col("i") + 1).alias("linea"), head.alias("texto"))
    found = L.digest_sections(text.union(more))
    listed = F.array_sort(F.collect_list(F.struct("pos", "texto")))
    return found.groupBy("doc_id", "n").agg(F.max("titulo").alias("titulo"), F.count(F.lit(1)).alias("parrafos"), F.md5(F.array_join(F.transform(listed, lambda x: x["texto"]), "|")).alias("hash"))
