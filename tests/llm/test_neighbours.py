import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import neighbours


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in vectors], "vec_id long, embedding array<float>, ids int, score double")


def found(spark, vectors, every=10, **kw):
    out = neighbours.search(table_of(spark, vectors), F.col("id") % every == 0, "vec_id", "embedding", **kw)
    lists = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return lists


def brute(vectors, q, k=10):
    own = next(v for i, v in vectors if i == q)
    near = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(own)) ** 2).sum())), i) for i, v in vectors if i != q)
    return [i for _, i in near[:k]]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype("float32")
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(spark, vectors, 100)
    hits = sum(len({i for i, _ in got[q]} & set(brute(vectors, q))) for q in range(0, 3000, 100))
    assert hits / 300 >= 0.9


def test_exact_where_all_are_measured(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    got = found(spark, vectors, share=1.0)
    for q in range(0, 200, 10):
        assert [i for i, _ in got[q]] == brute(vectors, q)


def test_copies_ties_and_few_candidates(spark):
    vectors = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [1.0, 2.5]), (110, [1.0, 1.5])]
    got = found(spark, vectors)
    assert [i for i, _ in got[0]] == list(range(1, 11)) and [i for i, _ in got[50]] == list(range(10))
    assert [i for i, _ in got[100]] == list(range(10)) and got[100][0][1] == 0.5
    assert [i for i, _ in found(spark, [(0, [1.0]), (1, [2.0]), (2, [3.0])])[0]] == [1, 2]


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 1.0]), (10, None), (20, [0.0, 0.0]), (30, [nan, 1.0]), (40, [1.0, inf]), (50, [1.0, None]), (1, [2.0, 2.0]), (None, [1.0, 1.0]), (60, [1.0]), (70, [])]
    got = found(spark, vectors)
    assert got == {0: [(1, pytest.approx(2**0.5))]}


def test_recall_of_several_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 1000)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 5000)] + 0.5 * rng.standard_normal((5000, 32))).astype("float32")
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(spark, vectors, 250)
    hits = sum(len({i for i, _ in got[q]} & set(brute(vectors, q))) for q in range(0, 5000, 250))
    assert hits / 200 >= 0.9


def test_an_id_with_several_vectors_asks_with_the_smallest_and_is_found_by_each(spark):
    got = found(spark, [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 3.0]), (2, [5.0, 0.0]), (2, [9.0, 0.0])])
    assert got == {0: [(1, 3.0), (2, 4.0), (2, 8.0)]}


def test_vectors_of_each_length_are_searched_among_their_own(spark):
    got = found(spark, [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [4.0]), (3, [6.0]), (10, [5.5]), (20, [3.0, 3.0, 3.0])])
    assert got == {0: [(1, 1.0)], 10: [(3, 0.5), (2, 1.5)]}


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_footrule_is_that_of_the_orders():
    order = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5]])
    files = neighbours.inverted_files(order, 6)
    scores = neighbours.footrule_scores(order[0], files, 3, 3)
    assert scores.tolist() == [3 + 2 + 1, 1 + 2 + 1, 0]
