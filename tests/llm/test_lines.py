import random

import numpy as np
from pyspark.sql import functions as F

from ragspark.llm import lines


def brute(rows):
    order = sorted({(-(2**63) if i is None else i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    seen, gone = [], {}
    for i, t in order:
        out, own = set(), []
        for n, line in enumerate(t.split("\n")):
            words = frozenset(line.encode().lower().split())
            if words:
                if any(5 * len(words & s) >= 4 * len(words | s) for s in seen + own):
                    out.add(n)
                own.append(words)
        seen += own
        gone[i, t] = sorted(out)
    return [[] if t is None else gone[-(2**63) if i is None else i, t] for i, t in rows]


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a"] * 3 + [f"w{i}" for i in range(80)]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(25)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool).split()
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    return rows + [(1000, None), (1001, "\n\n \n"), (1002, "w1 w2\n\nw1 w2"), (1003, pool[0].upper()), (1004, pool[0]), (None, "w1 w2 w3 w4 w5"), (2**60 + 1, "w1  w2\tw3 w4 w5")]


def test_matches_brute_force(spark, docs, clashes):
    rows = corpus()
    got = {(r["doc_id"]): r for r in lines.remove_similar_lines(docs(rows, extra=clashes)).collect()}
    for (i, t), want in zip(rows, brute(rows), strict=True):
        r = got[i]
        assert r["removed"] == want and r["n_removed"] == len(want), (i, t)
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want)
        assert r["kept"] == kept and r["n_lines"] == (0 if t is None else t.count("\n") + 1)
        assert r["text"] == t and r["_row"] == 1


def test_small_cells_and_parts_do_not_matter(spark, docs, monkeypatch):
    rows = corpus(8, 40)
    monkeypatch.setattr(lines, "CELL", 3)
    got = {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(docs(rows)).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_a_family_of_near_copies(spark, docs):
    base = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.remove_similar_lines(docs(rows)).collect()}
    assert got[0] == 0 and all(got[i] == 1 for i in range(1, 300))


def test_repeated_rows_are_one_document_and_empty_table(docs):
    got = lines.remove_similar_lines(docs([(4, "a b c\nd e f")] * 3 + [(5, "a b c")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(4, 0), (4, 0), (4, 0), (5, 1)]
    assert lines.remove_similar_lines(docs([])).count() == 0


def test_order_of_rows_does_not_matter(spark, docs):
    rows = corpus(9, 60)
    long = [f"t{i}" for i in range(19)]
    rows += [(2000, " ".join(long)), (2001, " ".join(long)), (2002, " ".join(long[:-1] + ["x"])), (2003, " ".join(long[:-1] + ["y"]))]
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    mixed = random.Random(10).sample(rows, len(rows))
    for given in (rows[::-1], mixed):
        got = {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(docs(given).coalesce(1)).collect()}
        assert got == want
        again = docs(given).coalesce(1).orderBy(F.monotonically_increasing_id().desc())
        assert {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(again).collect()} == want


def test_repeated_rows_with_similar_lines(docs, monkeypatch):
    written = lines.materialise

    def emptiest_first(df, label):
        return written(df.coalesce(1).sortWithinPartitions(F.length("active")) if label == "line-marks" else df, label)

    monkeypatch.setattr(lines, "materialise", emptiest_first)
    one, other = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    first = "an equal line\n" + " ".join(one)
    twice = "an equal line\n" + " ".join(one[:-1] + ["x"]) + "\n" + " ".join(other)
    rows = [(1, first), (2, twice), (3, " ".join(other[:-1] + ["y"]))]
    want = {1: [], 2: [0, 1], 3: [0]}
    for given in ([rows[0], *[rows[1]] * 3, rows[2]], [*[rows[1]] * 2, rows[2], rows[0], rows[1]]):
        for parts in (1, 5):
            got = lines.remove_similar_lines(docs(given).repartition(parts)).collect()
            assert sorted((r["doc_id"], r["removed"]) for r in got) == sorted((i, want[i]) for i, _ in given)


def test_marks_of_repeated_rows_are_merged(spark):
    blank = bytearray()
    rows = [(1, 2, bytearray(b"e" * 4), blank, blank), (1, 2, bytearray(b"e" * 4), bytearray(b"a" * 4), bytearray(b"w" * 8)), (1, 2, blank, bytearray(b"c" * 4), bytearray(b"v" * 8)), (3, 2, blank, blank, blank)]
    got = {r["_row"]: r for r in lines.merged(spark.createDataFrame(rows, lines.MARKS)).collect()}
    assert got[1]["equal"] == b"eeee" and {(got[1]["active"][i : i + 4], got[1]["words"][2 * i : 2 * i + 8]) == x for i in (0, 4) for x in [(b"aaaa", b"w" * 8)]} == {True, False}
    assert len(got[1]["active"]) == 8 and not got[3]["equal"] and not got[3]["active"]


def test_segments_cover_the_text():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choices("ab \n", k=rng.randint(0, 60))).encode()
        parts = list(lines.segments(text, 7))
        assert b"\n".join(parts) == text


def test_long_document(spark, docs):
    text = "\n".join(f"line {i} of many words {i % 5000} here {i // 5000}" for i in range(60000))
    r = lines.remove_similar_lines(docs([(1, text), (2, "line 7 of many words 7 here 0")])).collect()
    assert {x["doc_id"]: x["n_removed"] for x in r}[2] == 1


def test_filters_keep_every_match():
    rng = np.random.default_rng(7)
    for n in range(1, 60):
        for m in range(n, 60):
            need = int(lines.overlap(n + m, 0.8))
            common = rng.integers(0, n + 1)
            assert (common >= need) == (5 * common >= 4 * (n + m - common))


def test_other_thresholds(spark, docs):
    rows = [(1, "a b"), (2, "a b c"), (3, "x"), (4, "x y"), (5, "p q r"), (6, "p q s"), (7, "x y z w")]
    for threshold, want in ((0.5, {2: [0], 4: [0], 6: [0], 7: [0]}), (0.7, {}), (1.0, {})):
        got = {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(docs(rows), threshold=threshold).collect()}
        assert got == {i: want.get(i, []) for i, _ in rows}, threshold


def test_families_of_many_cells(spark, docs, monkeypatch):
    monkeypatch.setattr(lines, "CELL", 16)
    rng, base = random.Random(3), [f"t{i}" for i in range(40)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(40)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(docs(rows)).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_rows_of_unknown_size(spark, docs):
    rows = corpus(12, 30)
    made = spark.sparkContext.parallelize(rows, 3).toDF("doc_id long, text string")
    want = [x for (i, _), x in zip(rows, brute(rows), strict=True)]
    got = {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(made).collect()}
    assert [got[i] for i, _ in rows] == want
    joined = docs(rows).drop("source").join(docs(rows).select("doc_id", "source"), "doc_id", "left").join(docs([(1, "a")]).select(F.col("doc_id").alias("d")), F.col("d") < 0, "left")
    got = {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(joined.select("doc_id", "text")).collect()}
    assert [got[i] for i, _ in rows] == want


def test_rows_of_many_partitions(spark, docs):
    rows = corpus(14, 150)
    want = [x for (i, _), x in zip(rows, brute(rows), strict=True)]
    got = {r["doc_id"]: r["removed"] for r in lines.remove_similar_lines(docs(rows).repartition(37)).collect()}
    assert [got[i] for i, _ in rows] == want
