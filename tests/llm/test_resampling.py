import hashlib
import math
import random
import re
import zlib

import numpy as np

from ragspark.llm import resampling as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, f):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, f.longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % f.buckets for r in runs]


def plain(docs, target, percent, least, seed, f):
    """Rows (doc_id, n_words, n_features, weight, score, rank) of a plain computation, sorted."""
    def counts(texts):
        out = [0] * f.buckets
        for text in texts:
            for b in features(text, f)[1]:
                out[b] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + f.buckets) / ((s[b] + 1) * (sum(t) + f.buckets)))) for b in range(f.buckets)]
    rows = []
    for key, text in docs:
        n, found = features(text, f)
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1], r[2], r[3]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


def made(spark, docs, target, percent=50, least=3, seed=5, f=S.Features()):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in S.resample(d, t, percent, least, seed, f).collect()), key=repr)


def corpus(seed=3, n=60):
    draw = random.Random(seed)
    words = ["the", "Of", "año", "x1", "İstanbul", "ß" * 40, "z" * 70, "a-b", "C.D", "\x00q", "kK"]
    texts = [draw.choice(["", "  "]) + draw.choice([" ", "_", "\n", "--"]).join(draw.choices(words, k=draw.randint(0, 25))) for _ in range(n)]
    return [(i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(texts)] + [(None, None), (None, None), (90, None), (91, "")]


def test_equals_a_plain_computation(spark):
    docs = corpus()
    target = ["the the x1", None, "año of z", ""]
    assert made(spark, docs, target) == plain(docs, target, 50, 3, 5, S.Features())


def test_longer_runs_and_few_buckets_tie(spark):
    docs = corpus(4) + corpus(4)
    f = S.Features(longest=3, buckets=7)
    assert made(spark, docs, ["the of x1 c d"], 37, 2, 9, f) == plain(docs, ["the of x1 c d"], 37, 2, 9, f)


def test_repeated_rows_take_neighbouring_ranks(spark):
    docs = [(1, "a b c d")] * 5 + [(2, "a b c")] * 4 + [(None, "q r s")] * 3
    rows = made(spark, docs, ["a b"], 100, 3)
    assert sorted(r[5] for r in rows) == list(range(1, 13))
    for key in (1, 2, None):
        got = sorted(r[5] for r in rows if r[0] == key)
        assert got == list(range(got[0], got[0] + len(got)))


def test_empty_tables_and_nothing_to_draw(spark):
    assert made(spark, [], ["a"]) == []
    rows = made(spark, [(1, "a b c d"), (2, "x")], [], 10, 3)
    assert [r[5] for r in rows] == [None, None]


def test_clashing_columns_and_text_keys(spark):
    d = spark.createDataFrame([("k", "a b c", 1, 2, 3)], "doc_id string, text string, score int, _key int, weight int")
    row = S.resample(d, d, 100, 1).first()
    assert (row["doc_id"], row["n_words"], row["rank"]) == ("k", 3, 1)


def test_crc_of_runs_of_bytes():
    data = np.frombuffer(bytes(range(256)) * 2, dtype=np.uint8)
    starts, sizes = np.array([0, 5, 10, 100, 7]), np.array([1, 64, 65, 300, 0])
    assert S.crc32_runs(data, starts, sizes).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]


def test_long_text(spark):
    text = "the year " * 400_000
    row = made(spark, [(1, text)], ["the"], 100)[0]
    assert row[1] == row[2] == 800_000 and row[5] == 1
