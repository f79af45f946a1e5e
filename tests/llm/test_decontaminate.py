import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ragspark.llm import decontaminate as D


def distance(item, text):
    """Smallest edit distance of the item to a substring of the text, the plain way."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_myers_distance(item, text):
    assert D.best_match(D.pattern_bits(item), len(item), text)[0] == distance(item, text)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "~"
        elif kind == 1:
            out.insert(at, "~")
        else:
            del out[at]
    return "".join(out)


def test_pairs_match_brute_force(spark, docs):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(200)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 30)))) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    rows = []
    for i in range(80):
        body = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        if i % 2:
            item = rng.choice(items[:12])[1]
            body += " " + edited(rng, item, rng.randint(0, len(item) // 8)).upper() + "\n" + body
        rows.append((i, body))
    rows += [(200, None), (201, ""), (202, "x " * 60000 + items[0][1])]
    held = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (D.ITEMS_AT_ONCE, 6):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.find_items(docs(rows), held, at_once=at_once).collect()}
        want = {}
        for i, t in rows[:82]:
            for k, item in items:
                n = D.normalised(item or "")
                if len(n) >= D.MIN_CHARS and (d := distance(n, D.normalised(t or ""))) <= int(len(n) * D.ERROR_RATE):
                    want[i, k] = d
        assert want == {k: v for k, v in got.items() if k[0] != 202} and got[202, 0] == 0
    kept = D.drop_contaminated(docs(rows), held).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {i for i, _ in rows} - {i for i, _ in got}


def test_empty_tables_nulls_and_clashes(spark, docs, clashes):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    none = items.limit(0)
    assert D.find_items(docs([]), items).count() == 0 and D.find_items(docs([(1, "a")]), none).count() == 0
    text = "And: The QUICK brown\n\nfox jumped over the lazy dog!"
    got = D.find_items(docs([(None, text), (2**60 + 1, text), (3, "clean")], extra=clashes), items).collect()
    assert sorted(str(r["doc_id"]) for r in got) == [str(2**60 + 1)] * 2 + ["None"] * 2 and {r["distance"] for r in got} == {2}
    assert [r["doc_id"] for r in D.drop_contaminated(docs([(1, text), (3, "clean"), (4, None)], extra=clashes), items).collect()] == [3, 4]


def test_short_items_match_exactly_at_word_bounds(spark, docs):
    items = spark.createDataFrame([(1, "Who wrote  Emma?"), (2, "art"), (3, " "), (4, None)], "item_id long, text string")
    rows = [(1, "Q: who wrote\nEMMA? A: J. A."), (2, "who wrote emma"), (3, "parts, arts and smart"), (4, "parts of (Art)"), (5, "who wrotf emma?"), (6, ""), (7, None)]
    got = {(r["doc_id"], r["item_id"], r["distance"], r["end"], r["n_chars"]) for r in D.find_items(docs(rows), items).collect()}
    assert got == {(1, 1, 0, 18, 15), (4, 2, 0, 13, 3)}
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs(rows), items).collect()) == [2, 3, 5, 6, 7]


def test_items_that_share_an_id_keep_their_own_lengths(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps over the dog y"), (2, "an entirely different benchmark item of some length here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick brown fox jumps over the dog"), (7, "an entirely different benchmark item of some length here")], "item_id long, text string")
    rows = D.find_items(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_chars"]) for r in rows) == [(1, 7, 38), (2, 7, 56)]


def test_very_long_text(spark):
    text = "lorem ipsum dolor " * 60_000 + "the quick brown fox jumps over the dog " + "sit amet " * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick brown fox jumps over the dog")], "item_id long, text string")
    assert [r["distance"] for r in D.find_items(docs, items).collect()] == [0]
