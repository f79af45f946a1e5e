from pyspark.sql import functions as F

from ragspark.operators import answers as A

FIELDS = [
    (1, "respuesta", 0, "Rige la Ley 100 de 1993. La Ley 5 de 1992 y la Ley 100 de 1993 tampoco. Fin."), (1, "referencia", 1, "Ley 100 de 1993."),
    (2, "respuesta", 0, "Nada. Véase la Ley 7"), (2, "referencia", 1, "de 1990 y otras."),
    (3, "respuesta", 0, "La constitución en mora según Pérez et al. basta."), (3, "referencia", 1, None),
    (4, "respuesta", 0, "La Constitución Política lo dice."), (4, "referencia", 1, "Ley 9 de 1999."), (5, "respuesta", 0, ""),
]
BACKED = [(1, "ley/100/1993"), (2, "ley/1/2000"), (4, "constitucion")]


def run(spark):
    fields = spark.createDataFrame(FIELDS, "qid int, campo string, ord int, texto string")
    backed = spark.createDataFrame(BACKED, "qid int, body string")
    fills = fields.filter("campo = 'respuesta' OR qid = 2").select("qid", "campo", F.concat(F.lit("Relleno "), F.col("campo")).alias("texto"))
    rows, verdicts = A.verified(fields, backed, fills)
    return {(r.qid, r.campo): (r.texto, r.rellenado) for r in rows.collect()}, {r.qid: (r.veredicto, r.quitadas) for r in verdicts.collect()}


def test_three_steps(spark):
    rows, verdicts = run(spark)
    assert rows[1, "respuesta"] == ("Rige la Ley 100 de 1993. Fin.", False) and rows[1, "referencia"] == ("Ley 100 de 1993.", False)
    # A citation over two fields empties both; each takes its filling.
    assert rows[2, "respuesta"] == ("Relleno respuesta", True) and rows[2, "referencia"] == ("Relleno referencia", True)
    # What only looks like a citation is rewritten, and no sentence is lost.
    assert rows[3, "respuesta"] == ("La conformación en mora según Pérez y otros basta.", False) and rows[3, "referencia"] == ("", False)
    assert rows[4, "respuesta"] == ("La Constitución Política lo dice.", False) and rows[4, "referencia"] == ("", False)
    assert rows[5, "respuesta"] == ("Relleno respuesta", True)
    assert verdicts == {1: ("cita_sin_respaldo", ["ley/5/1992"]), 2: ("cita_sin_respaldo", ["ley/7/1990"]), 3: ("ok", []), 4: ("cita_sin_respaldo", ["ley/9/1999"]), 5: ("ok", [])}
