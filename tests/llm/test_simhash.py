import random

import numpy as np
import pytest
import xxhash

from ragspark.llm import simhash


def plain(text, k=4):
    words = []
    word = b""
    for b in (text or "").encode():
        if b in b"\x20\x09\x0a\x0b\x0c\x0d":
            words += [word] * bool(word)
            word = b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    words += [word] * bool(word)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def groups(rows):
    prints = [plain(t) for _, t in rows]
    low = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4 and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    ids = [min(rows[j][0] for j in range(len(rows)) if low[j] == low[i]) for i in range(len(rows))]
    return prints, ids


def test_fingerprints_and_components_match_brute_force(spark, docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 90))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 90):
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = "CHANGED"
        rows.append((i, " ".join(t)))
    rows += [(200, ""), (201, None), (202, " \n"), (203, "One"), (204, "one"), (205, "a b c"), (206, "É é x"), (207, "long " * 50000)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    prints, ids = groups(rows)
    for (i, _), fp, low in zip(rows, prints, ids, strict=True):
        assert got[i]["fp"] & (2**64 - 1) == fp and got[i]["component_id"] == low
    assert got[201]["component_id"] == 200 and got[204]["component_id"] == 203


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_choice_of_bits(radius):
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(radius)]
    rng = random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        spot = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(not m & spot for m in masks)


def test_large_bucket_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    chain = [0]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << i))
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in chain], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 1)).collect()}
    assert len(roots) == 40 and set(roots.values()) == {0}


def test_empty_table_repeated_rows_null_keys_and_clashes(spark, docs, clashes):
    assert simhash.near_duplicates(docs([])).count() == 0
    got = simhash.near_duplicates(docs([(1, "a b c d e")] * 3 + [(None, "q r s t u"), (None, "a b c d e"), (2**60 + 1, "zz")], extra=clashes)).collect()
    assert sorted(r["component_id"] for r in got if r["doc_id"] == 1) == [1, 1, 1]
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["1", "None"]
    assert [r["component_id"] for r in got if r["doc_id"] == 2**60 + 1] == [2**60 + 1]


def test_forest_connects_what_links_connect():
    codes = np.array([0, 1, 3, 7 << 40, (7 << 40) | 1, 7 << 50], dtype=np.int64)
    edges = simhash._forest(codes, 1)
    assert sorted(edges) == [(1, 0), (3, 0), ((7 << 40) | 1, 7 << 40)]


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    spark.range(50_000).selectExpr("xxhash64(id) fp").write.parquet(f"{tmp_path}/prints")
    df = simhash.links(spark.read.parquet(f"{tmp_path}/prints"), 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
