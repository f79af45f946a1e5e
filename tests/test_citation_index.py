import pytest
from pyspark.sql import functions as F

from ragspark.operators import ask as Q
from ragspark.operators import index as I
from ragspark.operators import retrieval as V

SCHEMA = "doc_id string, chunk_id long, norma string, articulo string, seccion string, texto string, clase string, vigencia string"
ROWS = [
    ("a", 0, "Ley 100 de 1993", "1", None, "Ley 100 de 1993. Seguridad social, según la Ley 50 de 1990.", "norma", "vigente"),
    ("a", 1, "Ley 100 de 1993", "1", None, "Ley 100 de 1993. Seguridad social, continúa.", "norma", "vigente"),
    ("a", 2, "Ley 100 de 1993", "2A", None, "Ley 100 de 1993. Pensiones.", "norma", "vigente"),
    ("b", 3, "Sentencia C-12 de 2001", None, "antecedentes", "Sentencia C-12 de 2001. La Ley 100 de 1993 fue demandada por pensiones.", "sentencia", "vigente"),
    ("b", 4, "Sentencia C-12 de 2001", None, "ficha", "Sentencia C-12 de 2001. Ficha.", "sentencia", "vigente"),
    ("c", 5, "Sentencia T-12 de 2001", None, "ficha", "Sentencia T-12 de 2001. Pensiones sin norma.", "sentencia", "vigente"),
    ("e", 6, "Ley 50 de 1990", None, None, "Ley 50 de 1990. Trabajo.", "norma", "vigente"),
    ("g", 8, "Sentencia T-99 de 2003", None, "ficha", "Sentencia T-99 de 2003. Pensiones de la Ley 3 de 1980.", "sentencia", "vigente"),
    (None, 7, None, None, None, None, "norma", None),
]


@pytest.fixture(scope="module")
def path(spark):
    from ragspark.sources.storage import scratch

    place = scratch(spark, "citation-index")
    I.store_fragments(spark.createDataFrame(ROWS, SCHEMA), place)
    I.build_lexical(spark, place)
    I.build_citations(spark, place)
    return place


def test_tables(spark, path):
    found = I.load_citations(spark, path)
    assert {(r.body, r.doc_id, r.inicio, r.fin) for r in found.norms.collect()} == {
        ("ley/100/1993", "a", 0, 3), ("jurisprudencia/C-12/2001", "b", 3, 5), ("jurisprudencia/T-12/2001", "c", 5, 6), ("ley/50/1990", "e", 6, 7), ("jurisprudencia/T-99/2003", "g", 8, 9)}
    assert {(r.article, r.chunk_id, r.part) for r in found.articles.collect()} == {("1", 0, 1), ("1", 1, 2), ("2a", 2, 1)}
    assert {(r.doc_id, r.chunk_id) for r in found.cards.collect()} == {("a", 0), ("b", 4), ("c", 5), ("e", 6), ("g", 8)}
    assert {(r.doc_id, r.body) for r in found.cited.collect()} == {("a", "ley/50/1990"), ("b", "ley/100/1993"), ("g", "ley/3/1980")}


def test_only_directories_of_the_bodies_asked_are_read(spark, path, monkeypatch, tmp_path):
    monkeypatch.setattr(I, "BUCKET_ROWS", 1)
    place = str(tmp_path / "index")
    I.store_fragments(spark.createDataFrame(ROWS, SCHEMA), place)
    I.build_citations(spark, place)
    found = I.load_citations(spark, place)
    assert found.buckets["articles"] == 4
    rows = found.of("articles", spark.createDataFrame([("ley/100/1993",), ("ley/7/1900",)], "body string"))
    assert rows.count() == 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_questions_by_article_by_norm_and_without_a_year(spark, path):
    asked = spark.createDataFrame([
        (1, "¿Qué dice el artículo 1 de la Ley 100 de 1993?"), (2, "¿Qué dice la Ley 100 de 1993?"), (3, "la sentencia C-12"), (4, "la sentencia T-12 de 2001"),
        (5, "el artículo 77 de la Ley 50 de 1990"), (6, "nada"), (7, None)], "qid long, text string")
    rows = Q.named(asked, I.load_citations(spark, path), Q.Settings()).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.qid, r.pos)):
        found.setdefault(r.qid, []).append(r.chunk_id)
    assert found == {1: [0, 1], 2: [0], 3: [4], 4: [5], 5: [6]}


def test_stale_and_foreign_parts_are_errors(spark, path, tmp_path):
    place = str(tmp_path / "index")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    I.store_fragments(rows, place)
    with pytest.raises(FileNotFoundError):
        I.load_citations(spark, place)
    I.build_citations(spark, place)
    assert I.stale_parts(spark, place) == []
    I.store_fragments(rows.filter("chunk_id <> 2"), place)
    assert I.stale_parts(spark, place) == ["citations"]
    with pytest.raises(ValueError, match="rebuild"):
        I.load_citations(spark, place)
    I.store_fragments(rows.limit(0), place)
    I.build_citations(spark, place)
    assert I.load_citations(spark, place).articles.count() == 0


def test_coupling_takes_one_fragment_and_breaks_ties_by_place(spark):
    listed = spark.createDataFrame([(1, 1, "x", 10), (1, 2, "x", 11), (1, 3, "z", 30), (1, 4, "y", 20), (1, 5, "w", 40)], "qid long, pos int, doc_id string, chunk_id long")
    edges = spark.createDataFrame([("x", "n1"), ("y", "n2"), ("z", "n2"), ("w", "n1"), ("w", "n2"), ("v", "n3"), ("u", "n4")], "doc_id string, body string")
    core = spark.createDataFrame([(1, "n1"), (1, "n2"), (1, "n9")], "qid long, body string")
    rows = V.coupled(listed, edges, core, 3).orderBy("pos").collect()
    assert [(r.doc_id, r.chunk_id) for r in rows] == [("w", 40), ("x", 10), ("z", 30)]


def test_rulings_come_by_coupling_only_where_case_law_is_asked_for(spark, path):
    settings = Q.Settings(harvested=("sentencia",), coupled=2, candidates=5, passages=5)
    asked = spark.createDataFrame([(1, "¿Qué dice la jurisprudencia sobre pensiones de la Ley 100 de 1993?"), (2, "pensiones de la Ley 100 de 1993"), (3, "sentencia C-12 de 2001 sobre pensiones")], "qid long, text string")
    rows = Q.retrieve(asked, path, settings).collect()
    docs = {q: {(r.doc_id, r.fuente) for r in rows if r.qid == q} for q in (1, 2, 3)}
    assert ("b", "rerank") in docs[1] and not any(d == "c" for d, _ in docs[1])
    assert not any(d in ("b", "c") for d, _ in docs[2])
    assert ("b", "lookup") in docs[3]


def test_documents_for_lookup_only_and_caps_by_document(spark, path):
    asked = spark.createDataFrame([(1, "seguridad social y pensiones"), (2, "trabajo según la Ley 50 de 1990")], "qid long, text string")
    rows = Q.retrieve(asked, path, Q.Settings(lookup_only=("e",), per_document=1, candidates=5, passages=2)).collect()
    first = [r.doc_id for r in sorted(rows, key=lambda r: r.pos) if r.qid == 1]
    assert first.count("a") == 1 and "e" not in first
    assert [(r.doc_id, r.fuente) for r in rows if r.qid == 2 and r.doc_id == "e"] == [("e", "lookup")]
