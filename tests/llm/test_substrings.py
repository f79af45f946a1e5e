import random
from collections import Counter

import numpy as np

from ragspark.llm import substrings
from ragspark.llm.words import hashed_text, window_hashes


def brute(rows, size=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def corpus():
    rng = random.Random(4)
    words = ["a", "b", "the", "ñu", "X,"] + [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    shared = [make(n) for n in (34, 35, 36, 53, 120)]
    rows = [(i, make(rng.randint(0, 150))) for i in range(60)]
    for i in range(60, 120):
        rows.append((i, " ".join([make(rng.randint(0, 40)), rng.choice(shared), make(rng.randint(0, 40)), rng.choice(shared)])))
    rows += [(200 + i, "copy " + shared[4]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "  \t\n"), (303, "loop " * 200), (304, make(20) + "\n\r\x0b\x0c" + shared[3].replace(" ", "\n")), (305, make(40000))]
    return rows + [(306, rows[5][1]), (306, rows[5][1]), (None, "k " * 3 + shared[2]), (None, make(50)), (2**60 + 1, shared[1])]


def test_matches_brute_force(spark, docs, clashes):
    rows = corpus()
    got = substrings.remove_repeats(docs(rows, extra=clashes)).collect()
    want = sorted((str(i), *b) for (i, _), b in zip(rows, brute(rows), strict=True))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == want


def test_empty_table(docs):
    assert substrings.remove_repeats(docs([])).count() == 0


def test_small_batches_and_segments_do_not_matter(spark, docs, monkeypatch):
    text = (" ".join(f"word{i % 97}" for i in range(5000))).encode()
    assert (hashed_text(text) == hashed_text(text, step=1000)).all()
    assert (window_hashes(hashed_text(text), 35)[:97] == window_hashes(hashed_text(text), 35)[97:194]).all()


def test_packing_of_probes_round_trips():
    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(10**6, 500, replace=False))
    for places in (at, at * 1000):
        marks, h = rng.random(500) < 0.3, rng.integers(0, 2**32, 500).astype("<u4")
        a, m, x = substrings.unpack(substrings.pack(places, marks, h), 500, "<u4")
        assert (a == places).all() and (m == marks).all() and (x == h).all()


def test_one_passage_in_every_document_and_rows_of_unknown_size(spark, docs):
    rng = random.Random(11)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join(rng.choices("abcdefghij", k=20)) + " " + shared + " tail" + str(i)) for i in range(300)]
    want = sorted((str(i), *b) for (i, _), b in zip(rows, brute(rows), strict=True))
    made = spark.sparkContext.parallelize(rows, 3).toDF("doc_id long, text string")
    for given in (docs(rows), made, docs(rows).join(docs(rows).select("doc_id"), "doc_id").select("doc_id", "text")):
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(given).collect()) == want


def test_word_hashes_tell_words_apart():
    from ragspark.llm.words import word_hashes, word_spans

    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abAB\x00é", k=rng.randint(1, 90))) for _ in range(3000)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    h, low = (word_hashes(data, *word_spans(data), lower=x) for x in (False, True))
    assert len(set(h.tolist())) == len(words) and len(set(low.tolist())) == len({w.encode().lower() for w in words})
    again = np.frombuffer(b"x " + " ".join(words[::-1]).encode(), np.uint8)
    assert word_hashes(again, *word_spans(again)).tolist()[:0:-1] == h.tolist()
