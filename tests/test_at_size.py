"""Steps whose intermediate rows must not outgrow what they read and return."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ragspark.functions import highlights as H
from ragspark.functions import text as T
from ragspark.operators import fragments as S
from ragspark.operators import ingest as E
from ragspark.operators import retrieval as V
from ragspark.sources import rulings as G


def test_chains_pass_the_row_limit_of_recursive_sql(spark):
    links = spark.range(40).select(F.col("id").alias("url"), F.when(F.col("id") % 10 == 9, F.col("id") - 9).otherwise(F.col("id") + 1).alias("next"))
    was = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        found = {tuple(r) for r in E.chained(links.select(F.col("url").alias("doc_id"), "url"), links, 12).collect()}
        cut = E.chained(links.select(F.col("url").alias("doc_id"), "url"), links, 3).count()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", was)
    assert found == {(u, u // 10 * 10 + (u + p) % 10, p) for u in range(40) for p in range(10)} and cut == 120


def test_rows_meet_their_range_without_a_join(spark):
    step = 1 << 16
    ranges = spark.createDataFrame([("a", 0, 3), ("b", 3, 5), ("c", 7, 2 * step + 4), ("d", 2 * step + 4, 2 * step + 6), ("e", 9, 9)], "doc_id string, inicio long, fin long")
    asked = [0, 2, 2, 3, 4, 5, 6, 7, 9, step - 1, step, 2 * step + 3, 2 * step + 4, 2 * step + 5, 2 * step + 6]
    found = V.rows_in_ranges(spark.createDataFrame([(i, f"x{i}") for i in asked], "chunk_id long, x string"), ranges)
    want = [(0, "x0", "a"), (2, "x2", "a"), (2, "x2", "a"), (3, "x3", "b"), (4, "x4", "b")] + [(i, f"x{i}", "c") for i in (7, 9, step - 1, step, 2 * step + 3)]
    assert sorted(tuple(r) for r in found.collect()) == want + [(2 * step + 4, f"x{2 * step + 4}", "d"), (2 * step + 5, f"x{2 * step + 5}", "d")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_articles_are_cut_before_they_meet_their_questions(spark):
    cited = spark.createDataFrame([(q, "b", a) for q in (1, 1, 2) for a in ("1", None)] + [(3, "c", "9")], "qid long, body string, article string")
    articles = spark.createDataFrame([("b", "1", "d", c) for c in (12, 10, 11)], "body string, article string, doc_id string, chunk_id long")
    cards = spark.createDataFrame([("c", "e", 7)], "body string, doc_id string, chunk_id long")
    found = V.lookup_hits(cited, articles, cards, 2, 4)
    assert sorted((r.qid, r.pos, r.chunk_id) for r in found.collect()) == [(1, 1, 10), (1, 2, 11), (2, 1, 10), (2, 2, 11), (3, 1, 7)]


def test_pages_of_rulings_are_dealt_once(spark):
    pages = spark.range(3).select(F.col("id"), F.lit("<p>Actor: X</p><p>SENTENCIA</p><p>I. ANTECEDENTES</p><p>uno</p>").alias("html"))
    rows = G.paragraphs(pages, "id", "html")
    for found in (G.cards(rows, "id"), G.sections(rows, "id")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_arrays_of_articles_and_pieces_are_built_once(spark):
    none = F.create_map().cast("map<string,array<string>>")
    article = lambda i: F.struct(i.cast("string").alias("articulo"), F.array().cast("array<string>").alias("ruta"), F.array(F.concat(F.lit("built-here "), i.cast("string"))).alias("parrafos"), none.alias("notas"))
    laws = spark.range(2).select(
        F.concat(F.lit("l"), F.col("id").cast("string")).alias("doc_id"), F.lit("Ley 1 de 2000").alias("nombre"), F.array().cast("array<string>").alias("alias"), F.array(F.lit("x")).alias("preambulo"),
        none.alias("notas_preambulo"), F.transform(F.sequence(F.lit(1).cast("long"), F.col("id") + 1), article).alias("articulos"))
    found = S.law_fragments(laws)
    assert found.count() == 5 and found._jdf.queryExecution().optimizedPlan().toString().count("built-here") == 1


def plainly(texts, asked, k, only=None):
    """BM25 of all pairs, one by one."""
    split = {d: t.split() for d, t in texts}
    mean, df = sum(map(len, split.values())) / len(split), Counter(w for words in split.values() for w in set(words))
    out = []
    for q in sorted({q for q, _ in asked}):
        scores = {}
        for d, words in split.items():
            n = Counter(words)
            for w in {w for x, w in asked if x == q} & n.keys():
                idf = math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5))
                scores[d] = scores.get(d, 0) + idf * n[w] / (n[w] + 1.5 * (0.25 + 0.75 * len(words) / mean))
        best = sorted((-round(s, 6), d) for d, s in scores.items() if only is None or d in only)[:k]
        out += [(q, pos, d, -s) for pos, (s, d) in enumerate(best, 1)]
    return out


def test_pairs_of_query_and_document_are_scored_where_their_block_is(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    texts = [(d, " ".join(["common"] + [f"w{d % 5}"] * (d % 4) + [f"v{d % 3}"] + (["rare"] if d in (3, 30) else []))) for d in range(50)] + [(50, "")]
    asked = [(q, w) for q in range(9) for w in ("common", f"w{q % 5}", "rare" if q == 4 else f"v{q % 3}", "absent")]
    docs, terms = spark.createDataFrame([*texts, (51, None)], "doc_id long, text string").repartition(3), F.filter(F.split("text", " "), lambda w: w != "")
    wanted = spark.createDataFrame(asked, "qid long, term string")
    all_of, some = [*texts, (51, "")], {d for d in range(50) if d % 2}
    for vocabulary in (None, V.vocabulary_of(wanted)):
        index = V.lexical_index(docs, terms, vocabulary=vocabulary)
        found = V.bm25_topk(index, wanted, 4)
        assert sorted((r.qid, r.pos, r.doc_id, r.score) for r in found.collect()) == plainly(all_of, asked, 4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any("hashpartitioning(qid" in line and "doc_id" in line for line in plan.splitlines())
        only = spark.createDataFrame([(d,) for d in some], "doc_id long")
        assert sorted((r.qid, r.pos, r.doc_id, r.score) for r in V.bm25_topk(index, wanted, 4, only=only).collect()) == plainly(all_of, asked, 4, some)


def test_best_rows_are_kept_over_blocks_with_ties_by_document():
    best, rng = V.Best(3), np.random.default_rng(1)
    scores, docs = rng.integers(-3, 4, (5, 60)) / 1e3, rng.permutation(60)
    scores[4] = -np.inf
    for at in range(0, 60, 11):
        best.add(np.arange(5), scores[:, at:at + 11], docs[at:at + 11])
    want = {q: sorted(zip(-scores[q], docs.tolist()))[:3] for q in range(4)}
    assert {q: list(zip(-s, d.tolist())) for q, (s, d) in best.held.items()} == want


def test_vectors_are_read_once_for_many_queries(spark):
    q = spark.range(1500).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double") % 7 - 3, F.lit(1.0)).alias("v"))
    x = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("double") % 5, -F.col("id").cast("double") % 3).alias("v"))
    found = V.dense_topk(q, x, 2)
    want = [(i, sorted((-((i % 7 - 3) * (d % 5) - d % 3), d) for d in range(40))[:2]) for i in range(1500)]
    assert sorted((r.qid, r.pos, r.doc_id, -r.score) for r in found.collect()) == [(i, n, d, s) for i, best in want for n, (s, d) in enumerate(best, 1)]
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()


def test_coupled_documents_are_scored_where_their_block_is(spark):
    edges = spark.range(60).select((F.col("id") % 20).alias("doc_id"), (F.col("id") % 12).alias("body"))
    edges = edges.union(edges).union(spark.range(20).select("id", F.lit(99).cast("long")))
    core = spark.createDataFrame([(q, b) for q in (1, 2) for b in (q, 4, 5, 99)] * 2, "qid long, body long")
    found = V.coupling(edges, core, 5)
    own = {d: {i % 12 for i in range(60) if i % 20 == d} for d in range(20)}
    df = Counter(b for bodies in own.values() for b in bodies)
    best = {q: sorted((-round(s, 6), d) for d, bodies in own.items() if (s := sum(math.log(20 / df[b]) for b in bodies & {q, 4, 5})) > 0)[:5] for q in (1, 2)}
    assert sorted((r.qid, r.pos, r.doc_id, -r.score) for r in found.collect()) == [(q, n, d, s) for q in (1, 2) for n, (s, d) in enumerate(best[q], 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(qid" in line and "doc_id" in line for line in plan.splitlines())


def test_texts_are_normalised_once_for_their_patterns(spark):
    rows = spark.createDataFrame([(1, "es", "la ley 100")], "id int, lang string, texto string")
    found = H.highlights(rows, spark.createDataFrame([("es", "ley"), ("es", "100")], "lang string, patron string"), ["id"], ["lang"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("İ") == 1


def test_a_word_is_stemmed_once_for_many_texts(monkeypatch):
    stemmed = []
    monkeypatch.setattr(T, "stem", lambda w: stemmed.append(w) or w[:3])
    stems = {}
    assert [T.roots(t, stems) for t in ("leyes nuevas leyes", "nuevas", None)] == [["ley", "nue", "ley"], ["nue"], []]
    assert stemmed == ["leyes", "nuevas"]


def test_few_rows_meet_a_large_table_that_is_not_shuffled(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = V.beside(spark.range(3).withColumnRenamed("id", "doc_id"), spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("texto")), "doc_id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 3 and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
