import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import answering as G
from ragspark.operators import chain as H

LAW = {"doc_id": "ley_100", "norma": "Ley 100 de 1993", "articulo": "5", "score": 0.9, "fuente": "rerank",
       "texto": "Ley 100 de 1993. ARTÍCULO 5. La pensión se reconoce a quien cumpla los requisitos de edad. El fondo paga las mesadas cada mes del año. Se aplica la Ley 50 de 1990."}
RULING = {"doc_id": "sentencia_c_355", "norma": "Sentencia C-355 de 2006", "articulo": None, "score": 0.5, "fuente": "rerank",
          "texto": "Sentencia C-355 de 2006. La Corte declaró exequible la norma acusada por los cargos analizados."}
PASSAGE = "qid long, pos int, doc_id string, norma string, articulo string, texto string, score double, fuente string"
ASKED = "id long, formato string, pregunta string, opciones map<string,string>"


def passages_of(spark, found):
    return spark.createDataFrame([(q, i + 1, *[p[k] for k in ("doc_id", "norma", "articulo", "texto", "score", "fuente")]) for q, ps in found.items() for i, p in enumerate(ps)], PASSAGE)


def answers(spark, questions, found, policy=H.Policy(), generator=None):
    asked = spark.createDataFrame([(i, form, "¿Quién tiene derecho a la pensión?", options) for i, form, options in questions], ASKED)
    return {r["id"]: r for r in H.answered(asked, passages_of(spark, found), policy, generator).collect()}


@pytest.mark.parametrize(("word", "root"), [
    ("nacionalmente", "nacional"), ("chicharrones", "chicharron"), ("torneado", "torn"), ("constitución", "constitu"), ("responsabilidad", "respons"), ("rápidamente", "rapid"),
    ("biología", "biolog"), ("existencia", "existent"), ("diciéndole", "dic"), ("pague", "pag"), ("c_355", "c_355"), ("actividades", "activ")])
def test_stems(word, root):
    assert T.stem(word) == root


def test_roots_of_columns_are_those_of_texts(spark):
    texts = ["Los contratos de la Sentencia C-355, art. 3o y 2.2.1", "nacionalmente Ñandúes", ""]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.index_terms(F.col("t")).alias("r")).collect():
        assert r["r"] == T.roots(r["t"])


def test_answers_of_the_evidence_alone(spark):
    got = answers(spark, [(1, "multiple_choice", {"A": "nada", "B": "requisitos de edad"}), (2, "semi_open", None), (3, "open_ended", None), (4, "multiple_choice", {}), (5, "odd", None)],
                  {q: [LAW, RULING] for q in (1, 2, 3)}, H.Policy(mentions=2, extend=False))
    one, two, three, four = (got[i] for i in (1, 2, 3, 4))
    assert one.respuesta_correcta == "B" and sorted(one.descarte_opciones) == ["A", "C", "D"] and not one.abstencion
    assert one.justificacion == "La opción B se ajusta a lo dispuesto en Ley 100 de 1993, artículo 5. Fundamento normativo: Sentencia C-355 de 2006; Ley 50 de 1990."
    assert two.respuesta.startswith("Conforme a lo dispuesto en Ley 100 de 1993, artículo 5: La pensión se reconoce") and two.referencia_legal == "Ley 100 de 1993, artículo 5; Sentencia C-355 de 2006; Ley 50 de 1990"
    assert two.palabras_clave == ["quién", "tiene", "derecho", "pensión"] or "pensión" in two.palabras_clave
    assert three.marco_normativo == "Ley 100 de 1993, artículo 5; Sentencia C-355 de 2006; Ley 50 de 1990." and three.jurisprudencia == "Sentencia C-355 de 2006."
    assert three.conclusion == "La solución del caso se rige por Ley 100 de 1993, artículo 5." and three.veredicto == G.OK
    assert four.respuesta_correcta == "A" and not four.abstencion and four.justificacion == "La opción A es la que mejor corresponde a la pregunta."
    assert "odd" in got[5].error and got[5].veredicto is None


def test_what_a_generator_says_is_checked(spark):
    def said(question, passages):
        return {
            1: {"respuesta": "La pensión procede. La Ley 77 de 1999 lo prohíbe. Rige la constitución de sociedades.", "palabras_clave": ["a", 3, " b "], "referencia_legal": "Ley 77 de 1999"},
            2: {"respuesta": "Rige la Ley 77", "referencia_legal": "de 1999"}, 3: {"respuesta": ""}, 4: {"respuesta_correcta": "C", "justificacion": "Sí.", "descarte_opciones": {"A": "por esto", "C": "x"}},
            6: {"analisis": ["Uno.", "Dos."], "conclusion": "Fin."}, 7: {"respuesta_directa": "Sí procede", "fundamento": "por ley", "alcance": None},
        }[question["id"]]

    got = answers(spark, [(1, "semi_open", None), (2, "semi_open", None), (3, "semi_open", None), (4, "multiple_choice", {"A": "x"}), (5, "semi_open", None), (6, "open_ended", None), (7, "semi_open", None)],
                  {q: [LAW] for q in range(1, 8)}, H.Policy(sources=0, extend=False), said)
    assert got[1].respuesta == "La pensión procede. Rige la conformación de sociedades." and got[1].veredicto == G.UNBACKED and got[1].quitadas == ["ley/77/1999"]
    assert got[1].referencia_legal == "Ley 100 de 1993, artículo 5" and got[1].rellenados == ["referencia_legal"] and got[1].palabras_clave == ["a", "b"]
    assert got[2].veredicto == G.UNBACKED and got[2].quitadas == ["ley/77/1999"] and got[2].respuesta.startswith("Conforme a") and got[2].referencia_legal == "Ley 100 de 1993, artículo 5"
    assert got[3].abstencion and got[3].motivo == "respuesta_vacia" and got[3].respuesta == ""
    assert got[4].respuesta_correcta == "C" and got[4].descarte_opciones == {"A": "Por esto", "B": G.NO_REASON, "D": G.NO_REASON} and got[4].justificacion == "Sí."
    assert got[5].respaldo == "KeyError" and got[5].veredicto == G.OK and got[5].respuesta.startswith("Conforme a")
    assert got[6].analisis == "Uno. Dos." and got[6].jurisprudencia == G.NO_RULINGS and got[6].marco_normativo == "Ley 100 de 1993, artículo 5."
    assert got[7].respuesta == "Sí procede por ley"


def test_extension_prefers_cited_norms_and_keeps_limits(spark):
    got = answers(spark, [(1, "semi_open", None)], {1: [LAW, RULING]}, H.Policy(sources=0), lambda q, p: {"respuesta": "La pensión procede", "referencia_legal": "Sentencia C-355 de 2006"})
    text = got[1].respuesta
    assert text.startswith("La pensión procede. La Sentencia C-355 de 2006 señala: «La Corte declaró exequible la norma acusada por los cargos analizados». La Ley 100 de 1993, artículo 5, dispone: «")
    assert len(text.split()) <= 150 and got[1].rellenados == ["extension:pasajes"]


def test_abstention_and_weak_evidence(spark):
    got = answers(spark, [(1, "semi_open", None), (2, "open_ended", None), (3, "multiple_choice", {})], {1: [LAW], 3: [LAW]}, H.Policy(least_score=0.95))
    assert got[1].abstencion and got[1].motivo == "score_bajo" and got[1].respuesta == "" and got[1].veredicto == G.INSUFFICIENT
    assert got[2].motivo == "sin_pasajes" and not got[3].abstencion


def brute_choice(pieces, relevance, budget, weight=0.8):
    """Maximal marginal relevance by its definition."""
    chosen = []

    def worth(i):
        near = max((len(set(pieces[i]) & set(pieces[j])) / len(set(pieces[i]) | set(pieces[j])) if pieces[i] and pieces[j] else 0 for j in chosen), default=0)
        return round(weight * relevance[i] + (1 - weight) * (1 - near), 12)

    room = budget
    while fits := [i for i in range(len(pieces)) if i not in chosen and len(" ".join(pieces[i])) <= room]:
        chosen.append(max(fits, key=lambda i: (worth(i), -i)))
        room -= len(" ".join(pieces[chosen[-1]])) + 1
    return sorted(chosen or [max(range(len(pieces)), key=lambda i: (relevance[i], -i))])


def test_choice_is_that_of_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pieces = [[f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 8))] for _ in range(rng.integers(1, 9))]
        relevance, budget = rng.integers(0, 9, len(pieces)) / 8, int(rng.integers(0, 70))
        sizes = np.array([len(" ".join(p)) for p in pieces])
        assert G.choose_diverse(pieces, sizes, relevance, budget).tolist() == brute_choice(pieces, relevance, budget)
    assert G.with_gaps(["a", "b", "c", "d"], np.array([1, 3])) == "[…] b […] d"
