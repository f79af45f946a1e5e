import re
import unicodedata

from pyspark.sql import functions as F

from ragspark.functions import highlights as H
from ragspark.functions import text as T


def plain(text, pattern):
    """The plain way: a map of each normalised character to its original, matches mapped back."""
    out, places = "", []
    for i, char in enumerate(text):
        for c in "".join(x for x in unicodedata.normalize("NFD", char) if not unicodedata.combining(x)).lower():
            out += c
            places.append(i)
    return [(places[m.start()], places[m.end() - 1] + 1) for m in re.finditer(pattern, out) if m.group()]


def test_spans_of_accented_and_decomposed_text(spark):
    texts = ["Constitución POLÍTICA de Colombia", unicodedata.normalize("NFD", "Constitución POLÍTICA, constitución"), "La İley y la ley; el artículo 42", "𝒳 ley é ley", "", "sin nada"]
    patterns = ["constitucion", "politica", r"ley\b", r"articulos?\s+\d+", "(?:x)*", "c"]
    rows = [(i, t, p) for i, t in enumerate(texts) for p in patterns]
    found = spark.createDataFrame(rows, "id int, t string, p string").select("t", "p", H.spans(F.col("t"), F.col("p")).alias("s")).collect()
    for r in found:
        assert [(x.desde, x.hasta) for x in r.s] == plain(r.t, r.p), (r.t, r.p)


def test_overlaps_are_merged_and_nulls_mark_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "la ley 100 de 1993 y la ley"), (1, 2, None), (2, 1, "ley")], "qid int, pos int, texto string")
    patterns = spark.createDataFrame([(1, r"ley \d+"), (1, r"100 de \d+"), (1, "ley"), (1, None), (3, "la")], "qid int, patron string")
    out = sorted(map(tuple, H.highlights(rows, patterns, ["qid", "pos"], ["qid"]).select("qid", "pos", "desde", "hasta").collect()))
    assert out == [(1, 1, 3, 18), (1, 1, 24, 27)]


def test_sentences_keep_their_figures(spark):
    row = spark.createDataFrame([("0 cero. Uno 1. Dos 2. Véase la Ley 3",)], "t string").select(T.sentences(F.col("t"))).first()[0]
    assert row == ["0 cero.", "Uno 1.", "Dos 2.", "Véase la Ley 3"]
