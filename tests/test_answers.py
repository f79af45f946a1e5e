import numpy as np
from pyspark.sql import functions as F

from ragspark.operators import answers as A
from ragspark.operators import evaluation as E
from ragspark.operators import ingest as I
from ragspark.streaming import resume


def test_diverse_choice():
    three = [["uno", "dos", "tres"], ["cuatro"], ["seis"]]
    sizes, relevance = np.array([12, 6, 4]), np.array([0.2, 1.0, 0.9])
    assert A.choose_diverse(three, sizes, relevance, 6).tolist() == [1]
    assert A.choose_diverse(three, sizes, relevance, 100).tolist() == [0, 1, 2]
    assert A.choose_diverse([["x"]], np.array([50]), np.array([1.0]), 10).tolist() == [0]
    assert A.choose_diverse([], np.array([]), np.array([]), 10).tolist() == []


def test_unbacked_sentences_go_whole(spark):
    s = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["a", "b"]), (1, 3, [])], "qid long, pos int, bodies array<string>")
    backed = spark.createDataFrame([(1, "a")], "qid long, body string")
    assert [r["removed"] for r in A.without_unbacked(s, backed).orderBy("pos").collect()] == [False, True, False]


def test_backing_counts_the_first_ten(spark):
    p = spark.createDataFrame([(1, i, [f"b{i}"]) for i in range(1, 13)], "qid long, pos int, bodies array<string>")
    assert A.backing_bodies(p).count() == 10


def test_weak_evidence_and_abstention(spark):
    q = spark.createDataFrame([(i, "cerrada" if i == 3 else "abierta") for i in range(1, 6)], "qid long, formato string")
    p = spark.createDataFrame([(1, 0.3, "r"), (2, 0.9, "r"), (3, 0.1, "r"), (4, 0.1, "r"), (4, 1.0, "lookup")], "qid long, score double, fuente string")
    weak = {r["qid"]: r["debil"] for r in A.weak_evidence(q, p, 0.75).collect()}
    assert weak == {1: True, 2: False, 3: False, 4: False, 5: False}
    a = spark.createDataFrame([(1, "abierta", "", False), (2, "cerrada", "", True), (3, "abierta", "x", True), (4, "abierta", "x", None)], "id long, formato string, respuesta string, insuficiente boolean")
    assert [r["abstencion"] for r in A.abstention(a).orderBy("id").collect()] == [True, False, True, False]


def test_submission_rules(spark):
    ok = (1, "cerrada", "A", "x", False, 3, 0.5)
    rows = [ok, (2, "cerrada", "E", "x", False, 3, 0.5), (3, "abierta", None, " ", False, 3, 0.5), (4, "abierta", None, "x", False, 11, 0.5),
            (5, "abierta", None, "x", False, 1, float("nan")), (9, "abierta", None, "x", False, 1, 0.1), (6, "abierta", None, "x", False, 1, 0.1), (6, "abierta", None, "x", False, 1, 0.1)]
    subs = spark.createDataFrame(rows, "id long, formato string, letra string, respuesta string, abstencion boolean, n_pasajes int, score double")
    known = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    got = sorted((r["id"], r["error"]) for r in A.submission_errors(subs, known).distinct().collect())
    assert got == [(2, "letra no valida"), (3, "respuesta vacia"), (4, "demasiados pasajes"), (5, "numero no finito"), (6, "id repetido"), (9, "id desconocido")]


def test_scores(spark):
    key = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "id long, correcta string")
    subs = spark.createDataFrame([(1, "A", False), (2, "A", False), (3, "C", True)], "id long, letra string, abstencion boolean")
    assert E.closed_score(key, subs.select("id", "letra")).first()["puntos"] == 10.0
    r = E.abstention_score(key, subs).first()
    assert (r["tn"], r["tp"], r["fp"], r["fn"]) == (1, 0, 1, 2) and r["puntos"] == 3.75
    items = spark.createDataFrame([(["a", "b"], ["a", "c"], ["a"]), (["d"], None, None)], "ref array<string>, cited array<string>, backed array<string>")
    r = E.citation_score(items).first()
    assert (r["n_ref"], r["con_respaldo"], r["no_respaldadas"]) == (3, 1, 1) and r["puntos"] == 0.0


def test_percentile_is_the_lower_element(spark):
    df = spark.range(1, 21).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    r = E.latency(df, "v", ["k"]).first()
    assert (r["p50"], r["p95"], r["max"]) == (10.5, 19.0, 20.0)


def test_harvest_gap_and_torn_log(spark):
    space = spark.createDataFrame([("c", n, n in (1, 2, 6)) for n in range(1, 15)], "g string, n int, hit boolean")
    assert [r["n"] for r in I.until_gap(space, ["g"], "n", "hit", 4).orderBy("n").collect()] == list(range(1, 11))
    log = spark.createDataFrame([("f", 1, "{}"), ("f", 2, "{}"), ("f", 3, "{cut")], "f string, n int, line string")
    assert I.readable_prefix(log, ["f"], "n", F.col("line") == "{}").count() == 2


def test_discards_name_the_other_letters(spark):
    m = spark.range(1).select(A.discards(F.array(F.lit("a"), F.lit(None), F.lit("c"), F.lit("d")), F.lit("C")).alias("m")).first()["m"]
    assert m == {"A": "a", "B": "No corresponde.", "D": "d"}


def test_stream_answers_each_question_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df = spark.range(5)
    df.write.parquet(src)
    for more in (None, spark.range(5, 8)):
        if more is not None:
            more.write.mode("append").parquet(src)
        resume.answer_stream(spark, src, df.schema, lambda q: q.withColumn("a", F.col("id") * 2), out, check)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))
