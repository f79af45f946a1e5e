import pytest
from pyspark.sql import functions as F

from ragspark.operators import models as M
from ragspark.sources import records as R


def test_jsonl_round_trip_and_rejects_nan(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 0.5), (1, None, None)], "id long, t string, score double")
    R.write_jsonl(df, f"{tmp_path}/out", ["id"])
    assert sorted(map(tuple, R.read_jsonl(spark, f"{tmp_path}/out", df.schema).collect()), key=lambda r: r[0]) == [(1, None, None), (2, "b", 0.5)]
    with pytest.raises(Exception, match="finite"):
        R.write_jsonl(spark.createDataFrame([(1, float("nan"))], "id long, score double"), f"{tmp_path}/bad")


def test_torn_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"id": 2}\n\n{"id": 1}\n{"id": 3, "te')
    schema = spark.createDataFrame([], "id long").schema
    assert sorted(r["id"] for r in R.read_log(spark, str(path), schema).collect()) == [1, 2]


def test_bank_and_choice(spark):
    closed = spark.createDataFrame([(2, "approved"), (1, "draft")], "id long, state string")
    open_ = spark.createDataFrame([(3, "approved", "semiabierta"), (4, "approved", None)], "id long, state string, formato string")
    bank = R.load_bank(closed, open_)
    assert [(r["formato"], r["id"]) for r in bank.collect()] == [("abierta", 4), ("cerrada", 2), ("semiabierta", 3)]
    assert R.chosen_questions(bank, [4]).count() == 1
    with pytest.raises(ValueError, match="9"):
        R.chosen_questions(bank, [4, 9])


def test_search_text_and_subqueries(spark):
    q = spark.createDataFrame([("q", {"B": "dos", "A": "uno"})], "p string, o map<string,string>")
    assert q.select(R.search_text(F.col("p"), F.col("o")).alias("t")).first()["t"] == "q\nuno\ndos"
    plans = spark.createDataFrame([(1, "La pregunta", ["uno", "UNO", " ", "la pregunta", "x " * 40, "dos", "tres"])], "qid long, question string, proposals array<string>")
    got = [r["sub"] for r in M.subqueries(plans).orderBy("pos").collect()]
    assert got[0] == "uno" and len(got[1].split()) == 25 and got[2] == "dos" and len(got) == 3


def test_row_counts_json_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a{i}") for i in range(7)], "id long, a string")
    assert R.write_jsonl(df, f"{tmp_path}/n") == 7
    R.write_json(spark, {"a": ["ñ", 1.5]}, f"{tmp_path}/x.json")
    assert R.read_json(spark, f"{tmp_path}/x.json") == {"a": ["ñ", 1.5]}
    with pytest.raises(ValueError):
        R.write_json(spark, float("inf"), f"{tmp_path}/y.json")
    run, trace = f"{tmp_path}/run", df.withColumnRenamed("a", "t")
    R.append_run(df.filter("id in (5, 1, 2)"), trace.filter("id in (1, 2, 6)"), run)
    R.append_run(df.filter("id = 6"), trace.filter("id = 5"), run)
    (tmp_path / "run/answers/torn.json").write_text('{"id": 3, "a": "a3"}\n{"id": 4, "a')
    assert R.finalise_run(spark, run, df.schema, trace.schema) == 4
    left = [[r["id"] for r in part.orderBy("id").collect()] for part in R.finished(spark, run, df.schema, trace.schema)]
    assert left == [[1, 2, 5, 6], [1, 2, 5, 6]]
    runs = spark.createDataFrame([("2020_a", "test", False, None), ("2021_a", "test", True, None), ("2022_a", "sample", False, None), ("2023_a", "test", False, "1")], "nombre string, split string, terminada boolean, ids string")
    assert [r["nombre"] for r in R.latest_unfinished(runs, "test").collect()] == ["2020_a"]


def test_packages(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("Cap II/a.pdf", b"one")
        z.writestr("Cap II/a.docx", b"two")
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("Cap II/b.DOC", b"two")
        z.writestr("Cap IX/Anexo 3.pdf", b"three")
        z.writestr("Cap IX/t.pdf", b"four")
    files = R.read_packages(spark, str(tmp_path / "*.zip"))
    assert sorted((r["ruta"], r["contenido"]) for r in files.collect()) == sorted([
        ("p.zip/in.zip/Cap II/a.pdf", b"one"), ("p.zip/in.zip/Cap II/a.docx", b"two"), ("p.zip/Cap II/b.DOC", b"two"), ("p.zip/Cap IX/Anexo 3.pdf", b"three"), ("p.zip/Cap IX/t.pdf", b"four")])
    kept = R.preferred(files)
    assert sorted(r["ruta"] for r in kept.collect()) == ["p.zip/Cap II/b.DOC", "p.zip/Cap IX/Anexo 3.pdf", "p.zip/Cap IX/t.pdf", "p.zip/in.zip/Cap II/a.docx"]
    ids = {r["ruta"]: r["doc_id"] for r in R.distinct_contents(files, F.lit("d")).collect()}
    assert len(ids) == 4 and "p.zip/in.zip/Cap II/a.docx" not in ids and sorted(ids.values()) == ["d", "d_2", "d_3", "d_4"]
    order = [r["ruta"] for r in R.in_chapter_order(kept).orderBy("orden").collect()]
    assert order[-2:] == ["p.zip/Cap IX/t.pdf", "p.zip/Cap IX/Anexo 3.pdf"]
    assert [R.roman(x) for x in ("IV", "IX", "XIV", "XL", "LXXXIX")] == [4, 9, 14, 40, 89]
