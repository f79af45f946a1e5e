"""Queries of fragments: laws and rulings are made from ``orders`` and ``documents``, the same way in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import fragments as S
from ragspark.plans.registry import query, table


def laws(spark, d):
    """A law for each document: articles of 20 words under a path of two levels, notes on every fourth."""
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "")
    n = F.ceil(F.size("w") / 20).cast("int")
    docs = table(spark, d, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    notes = F.create_map(F.lit("notas de vigencia"), F.array(F.lit("- Artículo modificado  por la Ley 1 de 2000"), F.lit("Artículo modificado por la Ley 1 de 2000")))
    empty = F.create_map().cast("map<string,array<string>>")
    articles = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        (i + 1).cast("string").alias("articulo"), F.array(F.lit("LIBRO I"), F.concat(F.lit("TÍTULO "), (i % 5).cast("string"))).alias("ruta"),
        F.array(F.array_join(F.slice("w", i * 20 + 1, F.lit(20)), " ")).alias("parrafos"), F.when(i % 4 == 0, notes).otherwise(empty).alias("notas")))
    return docs.select(
        F.concat(F.lit("ley_"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("Ley "), (F.col("doc_id") % 900 + 3000).cast("string"), F.lit(" de 2001")).alias("nombre"),
        F.array().cast("array<string>").alias("alias"), F.array(F.lit("EL CONGRESO"), F.lit(" "), F.lit("DECRETA")).alias("preambulo"), empty.alias("notas_preambulo"),
        articles.alias("articulos"), F.lit("senado").alias("parser"))


LAW_SQL = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, 'Ley ' || (doc_id % 900 + 3000) || ' de 2001' AS nombre, w, unnest(range(0, ((len(w) + 19) // 20)::bigint)) AS i FROM w WHERE len(w) > 0),
f AS (SELECT 'ley_' || doc_id || ':art_' || (i + 1) || ':0' AS frag_id, nombre || '. LIBRO I > TÍTULO ' || (i % 5) || '. ' || array_to_string(w[i * 20 + 1 : i * 20 + 20], ' ') ||
 CASE WHEN i % 4 = 0 THEN chr(10) || 'Notas de vigencia: Artículo modificado por la Ley 1 de 2000' ELSE '' END AS texto, CASE WHEN i % 4 = 0 THEN 'modificado' ELSE 'vigente' END AS vigencia,
 doc_id, i FROM a
UNION ALL SELECT 'ley_' || doc_id || ':encabezado:0', 'Ley ' || (doc_id % 900 + 3000) || ' de 2001. Encabezado. EL CONGRESO' || chr(10) || 'DECRETA', 'desconocida', doc_id, -1 FROM w WHERE len(w) > 0)"""


@query(f"WITH {LAW_SQL} SELECT frag_id, vigencia, texto FROM f WHERE length(texto) < 1900")
def law_fragments(spark, d):
    """A law's preamble and articles with path, notes and status; longer ones are cut (see the tests)."""
    return S.law_fragments(laws(spark, d)).filter("n_partes = 1 AND length(texto) < 1900").select("frag_id", "vigencia", "texto")


@query("SELECT 0::bigint AS malos")
def wrong_heads(spark, d):
    """No fragment has a head that is not read as its own norm."""
    docs = laws(spark, d)
    own = F.struct(F.lit("ley").alias("tipo"), F.regexp_extract("nombre", r"(\d+)", 1).alias("numero"), F.lit("2001").alias("anio"))
    return S.wrong_heads(S.law_fragments(docs), docs.withColumn("canonico", own)).agg(F.count(F.lit(1)).alias("malos"))


@query(f"""WITH {LAW_SQL}, o AS (SELECT frag_id, coalesce(sum(length(texto) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS inicio, length(texto) AS n FROM f)
SELECT frag_id, inicio, inicio + n AS fin FROM o WHERE (SELECT max(length(texto)) FROM f) < 1900""")
def placed_fragments(spark, d):
    """Fragments by their parser's family, with their places in the document's text."""
    own = F.struct(F.lit("ley").alias("tipo"), F.regexp_extract("nombre", r"(\d+)", 1).alias("numero"), F.lit("2001").alias("anio"))
    nothing = {"organo": "string", "ficha": "array<string>", "descriptores": "array<string>", "secciones": "array<struct<seccion:string,parrafos:array<struct<texto:string,sub:string>>>>"}
    docs = laws(spark, d).withColumns({"canonico": own, **{c: F.lit(None).cast(t) for c, t in nothing.items()}})
    placed = S.placed(S.dispatched(docs))
    return placed.select("frag_id", "inicio", "fin")


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT 'sentencia_' || doc_id || ':ficha:0' AS frag_id, 'Sentencia C-' || (doc_id % 900 + 1) || ' de 2003, Corte Constitucional. Ficha. Magistrado ponente: A. B.; C. D..' || chr(10) || 'Fecha: 2003-01-02.' || chr(10) || 'Decisión: Declarar' AS texto
FROM s WHERE len(l) > 0""")
def ruling_cards(spark, d):
    """The cards of rulings; their sections are held against a plain version in the tests."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    docs = table(spark, d, "documents").select("doc_id", lines.alias("l")).filter(F.size("l") > 0)
    card = S.card_lines(F.array(F.lit("A. B."), F.lit("C. D.")), F.lit("2003-01-02"), F.lit(""), F.array().cast("array<string>"), F.array(F.lit("RESUELVE:"), F.lit("Declarar")))
    paragraphs = F.transform("l", lambda x: F.struct(x.alias("texto"), F.lit(None).cast("string").alias("sub")))
    rulings = docs.select(
        F.concat(F.lit("sentencia_"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("Sentencia C-"), (F.col("doc_id") % 900 + 1).cast("string"), F.lit(" de 2003")).alias("nombre"),
        F.array().cast("array<string>").alias("alias"), F.lit(None).cast("string").alias("organo"), card.alias("ficha"), F.array().cast("array<string>").alias("descriptores"),
        F.array(F.struct(F.lit("consideraciones").alias("seccion"), paragraphs.alias("parrafos"))).alias("secciones"))
    return S.ruling_fragments(rulings).filter("seccion = 'ficha'").select("frag_id", "texto")
