import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import fragments
from ragspark.operators import segment as S
from ragspark.sources.html import decode, read_blocks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    def toks(t):
        return value(spark, T.tokens(F.lit(t)))
    assert toks("ARTICULO 3o. ") == toks("artículo 3") == toks("Artículo 3º") == ["articulo", "3"]
    assert toks("Año") == ["año"]
    assert "c_355" in toks("Sentencia C-355 de 2006") and toks("SU - 016") == ["su_016"]
    assert toks("2.2.1.1.1.1") == ["2_2_1_1_1_1"] and toks("240-1") == ["240_1"]
    assert value(spark, T.tokens(F.lit("los contratos de la sociedad"), ["los", "de", "la"])) == ["contratos", "sociedad"]


def test_norm(spark):
    assert value(spark, T.norm(F.lit("  Ñandú \n  ÁRBOL "))) == "nandu arbol" and value(spark, T.norm(F.lit(None).cast("string"))) == ""


def test_sentences(spark):
    text = "El Art. 5 dice algo. La Ley No. 1072 rige desde 1993. Y otra cosa."
    got = value(spark, T.sentences(F.lit(text)))
    assert len(got) == 3 and got[1].endswith("1993.")
    assert value(spark, T.sentences(F.lit(""))) == [] and value(spark, T.sentences(F.lit(None).cast("string"))) == []


def test_caps(spark):
    parts = F.array(*[F.lit(f"uno dos tres cuatro cinco {i}.") for i in range(10)])
    assert len(value(spark, T.capped(parts, 5, 1000))) == 5
    assert len(" ".join(value(spark, T.capped(parts, 10, 12))).split()) == 12
    assert len(value(spark, T.capped(parts, 3, 1))) == 1


def test_abbreviations(spark):
    got = value(spark, T.expand_abbreviations(F.lit("El CST y el C.G.P. rigen; XCST no")))
    assert got == "El Código Sustantivo del Trabajo y el Código General del Proceso rigen; XCST no"


def test_meta_phrases(spark):
    assert value(spark, T.without_meta_phrases(F.lit("Según la evidencia recuperada, el plazo es de 4 meses [2]."))) == "El plazo es de 4 meses."


def test_dates_and_slugs(spark):
    assert str(value(spark, T.spanish_date(F.lit("Bogotá, 12 de mayo de 2020.")))) == "2020-05-12"
    assert value(spark, T.spanish_date(F.lit("sin fecha"))) is None
    assert value(spark, T.slug(F.lit("Código  Civil (nº 1)"))) == "codigo_civil_n_1"


def test_stems(spark):
    assert T.stem("contratos") == T.stem("contrato") == "contrat" and T.stem("240") == "240"
    words = spark.createDataFrame([("contratos",), ("c_355",), ("contrato",), ("contratos",)], "term string")
    got = {r["term"]: r["stem"] for r in T.stemmed(words, "term").collect()}
    assert got["contratos"] == got["contrato"] and got["c_355"] == "c_355"


def test_packing_and_offsets(spark):
    parts = value(spark, fragments.parts(F.array(*map(F.lit, ("aaaa", "bbb", "cccccccccccc", "d"))), 10))
    assert parts == ["aaaa\nbbb", "cccccccccc", "cc\nd"]
    rows = spark.createDataFrame([(1, "uno\n\ndos tres\ncuatro")], "doc_id long, text string")
    frags = S.offsets(S.paragraphs(rows)).orderBy("pos").collect()
    whole = "\n\n".join(r["texto"] for r in frags)
    assert all(whole[r["inicio"] : r["fin"]] == r["texto"] for r in frags)


def test_long_paragraphs_are_cut():
    text = "Una frase corta. " * 300
    pieces = fragments.split_paragraph(text.strip(), 200)
    assert all(len(p) <= 200 for p in pieces) and " ".join(pieces) == text.strip()
    assert fragments.split_paragraph("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_dense_ids_are_global_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("doc_id"), F.col("id").alias("pos")).repartition(7)
    got = S.dense_ids(rows, ["doc_id", "pos"]).orderBy("doc_id", "pos").collect()
    assert [r["chunk_id"] for r in got] == list(range(1000))


def test_running_headers(spark):
    rows = [("d", p, n, t) for p in range(1, 5) for n, t in enumerate(("REPUBLICA", f"page {p}"))] + [("d", 1, 9, "REPUBLICA DOS")]
    got = S.without_running_headers(spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string")).collect()
    assert "REPUBLICA" not in {r["line"] for r in got} and len(got) == 5


def test_html_blocks_and_charsets():
    page = "<html><script>x()</script><h1>Title</h1><p>One &amp; two</p><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table></html>"
    got = read_blocks(page)
    assert [b[1] for b in got] == ["Title", "One & two", "a", "b", "1 | 2"] and got[1][2] == ["Title"]
    assert read_blocks(None) == []
    assert decode("año".encode()) == "año" and decode("año".encode("latin1"), "latin1") == "año" and decode(b"\x93x\x94", "latin-1") == "“x”"


@pytest.mark.parametrize(("marks", "notes", "want"), [
    ("<INEXEQUIBLE>", "", "inexequible"), ("", "Artículo derogado por", "derogado"), ("<Artículo modificado>", "", "modificado"), ("", "", "vigente")])
def test_validity(spark, marks, notes, want):
    assert value(spark, S.validity(F.lit(marks), F.lit(notes))) == want
