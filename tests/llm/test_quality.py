import random
import re

from ragspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def judged(spark, rows, schema="doc_id long, text string"):
    return quality.judged(spark.createDataFrame(rows, schema))


def test_base_measures_equal_a_plain_count(spark):
    draw = random.Random(7)
    alphabet = ["the", "of", "añadir", "𝒳y", "x|y", "#", "a.b", "***", "te"]
    texts = [None, "", " \t\n", "one two", "a b c a b c", "a a a a", "\n\nx\n x\nx\n"]
    for _ in range(60):
        size = draw.choice([3, 10, 60, 120])
        texts.append("".join(draw.choice(alphabet[: draw.randint(2, 9)]) + draw.choice([" ", " ", "\n", "\t", "  ", "\r\n", "\x0b"]) for _ in range(size)))
    found = {r["doc_id"]: r for r in judged(spark, list(enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(text), text
        assert r["kept"] == (not r["base_failed"] and not r["failed"])


def test_rules_name_what_they_reject(spark):
    good = " ".join(f"the w{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(60))
    texts = {
        "good": good, "symbols": " ".join(w + "##" for w in good.split()), "stop_words": " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(80)),
        "letters": good + " " + " ".join(str(i) for i in range(200)), "ellipses": "\n".join(f"{w} the of it {i}..." for i, w in enumerate(good.split()[:30])),
        "bullets": "\n".join(f"- {w} the of a{i}" for i, w in enumerate(good.split()[1::3])),
        "duplicate_lines": good + "\nthe end of it" * 6, "word_length": " ".join(f"the {'x' * 40}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)),
    }
    rows = judged(spark, list(texts.items()), "doc_id string, text string").collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {name: name == "good" for name in texts}
    for r in rows:
        assert r["doc_id"] == "good" or r["doc_id"] in r["failed"], r


def test_own_thresholds(spark):
    rules = (quality.Rule("short", "n_words", least=60), quality.Rule("calm", "n_symbols / n_words", most=0.0))
    text = " ".join(f"w{i}" for i in range(55))
    row = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules).first()
    assert row["failed"] == ["short"] and not row["base_failed"] and not row["kept"]


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(None, None, 1, "a"), (3, "x", 2, "b"), (3, "x", 2, "b")]
    out = judged(spark, rows, "doc_id long, text string, N_Words int, _m string")
    assert out.columns.count("n_words") == 1 and "_m" in out.columns and "N_Words" not in out.columns
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in out.collect()) == [(0, 0, False), (3, 1, False), (3, 1, False)]
    assert judged(spark, []).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 5003}x{i % 7}" for i in range(300_000))
    row = judged(spark, [(1, text)]).first()
    assert row["n_words"] == 300_000 and row["n_repeat_words"] == 300_000


def test_plan_is_one_projection(spark):
    plan = judged(spark, [(1, "a")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
