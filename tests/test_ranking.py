import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import ranking as R

SCHEMA = "qid long, doc_id string, chunk_id long, score double, pos int, clase string, vigencia string"


def ranked_list(spark, keys, scores=None, classes=None, status=None, qid=1):
    rows = []
    for i, k in enumerate(keys):
        doc, chunk = k.split(":")
        rows.append((qid, doc, int(chunk), float(scores[i]) if scores else 0.5, i + 1, classes[i] if classes else None, status[i] if status else None))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def keys(df):
    return [f"{r['doc_id']}:{r['chunk_id']}" for r in df.orderBy("qid", "pos").collect()]


def test_canonical_order(spark):
    assert keys(R.ranked(ranked_list(spark, ["b:2", "a:9", "b:1", "a:3"]))) == ["a:3", "a:9", "b:1", "b:2"]


@pytest.mark.parametrize("flip", [0, 1])
def test_rrf_ties_do_not_depend_on_the_lists(spark, flip):
    a = ranked_list(spark, ["b:1", "a:2"]).withColumn("list_ord", F.lit(flip))
    b = ranked_list(spark, ["a:2", "b:1"]).withColumn("list_ord", F.lit(1 - flip))
    assert keys(R.rrf(a.unionByName(b))) == ["a:2", "b:1"]


def test_rrf_sums(spark):
    a = ranked_list(spark, ["a:1", "b:1"]).withColumn("list_ord", F.lit(0))
    b = ranked_list(spark, ["c:1", "b:1"]).withColumn("list_ord", F.lit(1))
    first = R.rrf(a.unionByName(b)).filter("pos = 1").first()
    assert first["doc_id"] == "b" and first["score"] == pytest.approx(2 / 62)


def test_per_document_cap(spark):
    base = ranked_list(spark, [f"L:{i}" for i in range(8)] + ["b:1", "c:1", "b:2"])
    assert keys(R.per_document_cap(base, 2, 5)) == ["L:0", "L:1", "b:1", "c:1", "b:2"]
    assert keys(R.per_document_cap(base, 2, 3)) == ["L:0", "L:1", "b:1"]
    assert keys(R.per_document_cap(ranked_list(spark, [f"a:{i}" for i in range(6)] + ["b:1"]), 2, 5)) == ["a:0", "a:1", "a:2", "a:3", "b:1"]


def test_reorder_keeps_scores(spark):
    base = ranked_list(spark, ["a:0", "b:0", "c:0", "ley:0"], [0.9, 0.8, 0.7, 0.2])
    other = ranked_list(spark, ["ley:0", "a:0", "b:0", "c:0"])
    got = R.reorder_with(base, other)
    assert keys(got) == ["a:0", "ley:0", "b:0", "c:0"] and got.filter("doc_id = 'ley'").first()["score"] == 0.2


def test_penalty(spark):
    base = ranked_list(spark, ["A:0", "B:0", "C:0", "D:0", "E:0"], [0.92, 0.90, 0.95, 0.5, 0.85], status=["inexequible", "vigente", "derogado", "vigente", None])
    got = R.penalise(base, {"inexequible": 0.85, "derogado": 0.85})
    assert keys(got) == ["B:0", "E:0", "C:0", "A:0", "D:0"] and got.filter("doc_id = 'C'").first()["score"] == 0.95


QUOTA = [f"r{i}:{i}" for i in range(15)]
CLASSES = ["sentencia"] * 6 + ["voto"] * 2 + ["regulatoria"] * 3 + ["primaria"] * 4


def test_quota(spark):
    caps = {"sentencia": 3, "voto": 0, "regulatoria": 2}
    got = keys(R.type_quota(ranked_list(spark, QUOTA, classes=CLASSES), caps, 10))
    assert [int(k.split(":")[1]) for k in got] == [0, 1, 2, 3, 8, 9, 11, 12, 13, 14]
    named = R.type_quota(ranked_list(spark, QUOTA[:8], classes=CLASSES[:8]), caps, 8, F.lit(True))
    assert len(keys(named)) == 8
    wide = R.type_quota(ranked_list(spark, QUOTA[:6] + [QUOTA[11]], classes=CLASSES[:6] + ["primaria"]), caps | {"sentencia": 6}, 7)
    assert len(keys(wide)) == 7


def test_guarantee(spark):
    cand = ranked_list(spark, ["d:0", "d:1", "d:11", "d:2", "d:3"], classes=["s", "s", "p", "s", "s"])
    prim = ranked_list(spark, ["d:11", "d:12", "d:13"], classes=["p"] * 3)
    assert keys(R.guarantee(cand, prim, 5, F.col("clase") == "p")) == ["d:0", "d:1", "d:11", "d:12", "d:13"]
    few = R.guarantee(ranked_list(spark, ["d:0", "d:1"], classes=["s", "s"]), ranked_list(spark, ["d:12"], classes=["p"]), 5, F.col("clase") == "p")
    assert keys(few) == ["d:0", "d:1", "d:12"]


def listed(spark, *lists):
    out = None
    for i, ks in enumerate(lists):
        one = ranked_list(spark, ks).withColumn("list_ord", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def test_fuse_puts_lookup_first_without_repeats(spark):
    got = R.fuse(ranked_list(spark, ["L:7"]), listed(spark, ["x:1", "L:7", "x:2"]), ranked_list(spark, ["z:1"]).limit(0))
    assert keys(got) == ["L:7", "x:1", "x:2"]


def test_fuse_cap_and_fixed_rows(spark):
    none = ranked_list(spark, ["z:1"]).limit(0)
    long = [f"d{i:02d}:0" for i in range(20)]
    assert len(keys(R.fuse(none, listed(spark, long, long[::-1]), none))) == 10
    fixed = keys(R.fuse(none, listed(spark, long), ranked_list(spark, ["F:1"])))
    assert fixed == long[:9] + ["F:1"]
    assert keys(R.fuse(none, listed(spark, long), ranked_list(spark, ["d03:0"]))) == long[:10]
    assert keys(R.fuse(none, listed(spark, long[:4]), ranked_list(spark, ["F:1"]))) == long[:4] + ["F:1"]


def test_windows_are_partitioned_by_query(spark):
    both = ranked_list(spark, ["a:1", "b:1"]).unionByName(ranked_list(spark, ["a:1"], qid=2))
    plan = R.ranked(both, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "WindowGroupLimit" in plan


def test_rounding_is_that_of_sql_at_halves(spark):
    prices = [64645.5, 258481.5, 252678.5, 51239.25, -64645.5]
    found = spark.createDataFrame([(p / 1e6,) for p in prices], "x double").select("x", R.rounded("x").alias("r")).collect()
    assert [r["r"] for r in found] == [0.064645, 0.258481, 0.252678, 0.051239, -0.064645]
