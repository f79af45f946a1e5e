import pytest

from ragspark.operators import index as I
from ragspark.operators import inventory as N


def test_files_round_trip(spark, tmp_path):
    rows = [{"ola": 1, "doc_id": "b", "zeta": None, "areas": ["civil"], "_archivo": "x"}, {"doc_id": "a", "nombre_citable": "Ley 1: «ñ»"}]
    text = N.emitted("# head\narea: civil\n", rows)
    assert text == '# head\narea: civil\ndocumentos:\n  - doc_id: "b"\n    areas: ["civil"]\n    ola: 1\n    zeta: null\n  - doc_id: "a"\n    nombre_citable: "Ley 1: «ñ»"\n'
    head, back = N.parsed(text)
    assert N.emitted(head, back) == text and back[1] == rows[1]
    (tmp_path / "one.yaml").write_text(text)
    assert sorted((r["archivo"], r["doc_id"]) for r in N.read_inventory(spark, str(tmp_path)).collect()) == [("one", "a"), ("one", "b")]
    (tmp_path / "two.yaml").write_text(N.emitted("x", rows[:1]))
    with pytest.raises(Exception, match="duplicate b"):
        N.read_inventory(spark, str(tmp_path)).collect()


def test_index_guards_and_reuse(spark, tmp_path):
    from pyspark.sql import functions as F

    path, rows = f"{tmp_path}/index", spark.createDataFrame([(i, f"contratos {i % 3} nacionales") for i in range(6)], "chunk_id long, texto string")
    I.store_fragments(rows, path)
    with pytest.raises(FileNotFoundError):
        I.load_lexical(spark, path)
    I.build_lexical(spark, path)
    model = I.hashed_roots(8)
    assert I.build_dense(spark, path, model) == {"reused": 0, "encoded": 6} and I.stale_parts(spark, path) == []
    assert {r["term"] for r in I.load_lexical(spark, path).postings.select("term").distinct().collect()} == {"contrat", "nacional", "0", "1", "2"}
    I.store_fragments(rows.withColumn("texto", F.when(F.col("chunk_id") == 5, "otro texto").otherwise(F.col("texto"))), path)
    assert I.stale_parts(spark, path) == ["lexical", "dense"]
    for load in (I.load_lexical, I.load_dense):
        with pytest.raises(ValueError, match="rebuild"):
            load(spark, path)
    assert I.build_dense(spark, path, model) == {"reused": 5, "encoded": 1}
    assert I.load_dense(spark, path).count() == 6 and I.prefixes("intfloat/e5-large")["query"] == "query: "


def test_literal_items_of_any_length(spark):
    from ragspark.operators import retrieval as V

    docs = spark.createDataFrame([(1, "the answer is 42."), (2, None), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "is 42"), (8, "42."), (9, "the answer is 42. "), (10, None), (11, "x"), (12, "x")], "item_id long, text string")
    for at_once in (1, 5000):
        assert sorted(map(tuple, V.contained_items(docs, items, at_once).collect())) == [(1, 7), (1, 8), (3, 11), (3, 12)]
