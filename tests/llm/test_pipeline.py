import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ITEM = "the quick brown fox jumps over the lazy dog and then runs away from here"
WORDS = "the of and to in that with this from which".split() + [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory, clashes):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = [(i, "\n".join(" ".join(rng.choices(WORDS, k=20)) for _ in range(6))) for i in range(40)]
    near = rows[3][1].replace(" ", "  ").split("\n")
    rows += [(100, rows[0][1]), (101, None), (102, "1234 !!"), (103, rows[5][1] + f"\n{ITEM.upper()}"), (104, "\n".join(near))]
    rows += [(105, " ".join(rng.choices(WORDS, k=20)) + " " + ITEM), (None, " ".join(rng.choices(WORDS, k=30)))]
    d = str(tmp_path_factory.mktemp("sf"))
    docs(rows, extra=clashes).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit("en"))).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_follow_one_another(spark, sf_dir):
    frame, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.materialise(stage(spark, frame, sf_dir), "test")
        if name != "packing":
            assert frame.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = {r["doc_id"] for r in frame.select("doc_id").collect()}
    clean = set(range(40)) | {None}
    assert seen["language_id"] == clean | {100, 103, 104, 105}
    assert seen["line_dedup"] == clean | {103, 105}
    assert seen["near_dedup"] == clean | {103, 105}
    assert seen["decontamination"] == clean == seen["packing"]


def test_near_dedup_keeps_the_smallest_of_each_group(spark, docs, sf_dir):
    body = " ".join(random.Random(2).choices(WORDS, k=200))
    df = docs([(5, body), (3, body.upper()), (9, body), (9, body), (1, "something else entirely in here"), (2, "")])
    kept = corpus_pipeline.near_dedup(spark, df, sf_dir).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3]


def test_near_dedup_matches_brute_force_jaccard(spark, docs, sf_dir):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(60, 200)))) for i in range(25)]
    for i in range(25, 90):
        t = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    rows += [(200, "One two"), (201, "one  TWO"), (202, "one three")]
    rng.shuffle(rows)

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    low = [i for i, _ in rows]
    for _ in rows:
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(rows), sf_dir).collect()}
    assert got == set(low) and len(pairs) > 30


def test_near_dedup_finds_copies_by_fingerprints_and_verifies_them(spark, docs, sf_dir, monkeypatch):
    from ragspark.llm import copies, simhash

    def apart(batches):
        for batch in batches:
            rows = [(n, [n ^ k for k in range(copies.BANDS)]) for n in batch["_node"]]
            yield type(batch)(rows, columns=["_node", "keys"])

    monkeypatch.setattr(copies, "_band_keys", apart)
    rng = random.Random(8)
    body = rng.choices(WORDS, k=2000)
    phrase = "again and once more then " * 2000
    rows = [(1, " ".join(body)), (2, " ".join([*body[:-1], "changed"])), (3, phrase + " ".join(body[:40])), (4, phrase + " ".join(body[50:90])), (5, " \n"), (6, None)]
    prints = [simhash.fingerprint(t, copies.SHINGLE) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and (prints[2] ^ prints[3]).bit_count() <= 4
    kept = corpus_pipeline.near_dedup(spark, docs(rows), sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5]


def test_near_dedup_keeps_unlike_rows_of_one_id(spark, docs, sf_dir):
    rng = random.Random(3)
    one, two, three = (" ".join(rng.choices(WORDS, k=80)) for _ in range(3))
    rows = [(None, one), (None, two), (None, three), (7, two.upper()), (8, one + " x"), (8, three + " x"), (8, "quite another text"), (8, "quite another text")]
    kept = corpus_pipeline.near_dedup(spark, docs(rows), sf_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(7, two.upper()), (8, one + " x"), (8, three + " x"), (8, "quite another text")])
    nulls = corpus_pipeline.near_dedup(spark, docs([(None, one), (None, two), (None, two)]), sf_dir).collect()
    assert sorted(r["text"] for r in nulls) == sorted([one, two])


def test_run_and_empty_tables(spark, sf_dir, docs, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == 41
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
