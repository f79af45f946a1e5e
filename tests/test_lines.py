from ragspark.sources import lines as L
from ragspark.sources import norms as N

SCHEMA = "doc_id string, pagina int, linea int, texto string"
LAW = [
    ["DECISION 999", "", "Régimen de Prueba", "", "DECIDE:", "", "TITULO I", "", "DISPOSICIONES GENERALES", "", "Del Objeto", "", "Artículo 1.- Esta Decisión regula la prue-", "ba con líneas partidas.",
     "Artículo 2.- No podrán registrarse los signos que:", "a)", "carezcan de distintividad;", "b)", "-", "otros;", " - 2 - "],
    ["CAPITULO I", "", "DE LAS MARCAS", "", "Artículo 3.- Texto del", " 78 ", "artículo 9.", "", "DISPOSICIONES TRANSITORIAS", "", "PRIMERA.- Régimen de transición.", "", "Dada en la ciudad de Lima.", "", "Firma"],
]


def lines(spark, docs):
    return spark.createDataFrame([(d, p, i, t) for d, pages in docs.items() for p, page in enumerate(pages) for i, t in enumerate(page)], SCHEMA)


def test_law_from_lines(spark):
    got = N.documents(L.law_articles(lines(spark, {"d": LAW, "e": [["sin artículos", None, "dos"]]})))
    found = {r.doc_id: r for r in got.collect()}
    arts = {a.articulo: a for a in found["d"].articulos}
    assert list(arts) == ["1", "2", "3", "TRANSITORIA PRIMERA"]
    assert arts["1"].parrafos == ["Artículo 1.- Esta Decisión regula la prueba con líneas partidas."] and arts["1"].ruta == ["TITULO I. DISPOSICIONES GENERALES", "Del Objeto"]
    assert arts["2"].parrafos == ["Artículo 2.- No podrán registrarse los signos que:", "a) carezcan de distintividad;", "b) -", "otros;"]
    assert arts["3"].ruta == ["TITULO I. DISPOSICIONES GENERALES", "CAPITULO I. DE LAS MARCAS"] and arts["3"].parrafos == ["Artículo 3.- Texto del artículo 9."]
    assert arts["TRANSITORIA PRIMERA"].ruta == ["DISPOSICIONES TRANSITORIAS"] and arts["TRANSITORIA PRIMERA"].parrafos == ["PRIMERA.- Régimen de transición."]
    assert found["d"].preambulo == ["DECISION 999", "Régimen de Prueba", "DECIDE:"] and found["e"].preambulo == ["sin artículos", "dos"]


DIGEST = [
    ["RELATORÍA", "portada"],
    ["RELATORÍA", "1", "A", "ABUSO DEL DERECHO", "Primera frase que sigue", "en otra línea.", "Segunda con cita (SC1121-2018;", "18/04/2018)", "Tercera que pasa de"],
    ["RELATORÍA", "2", "página (SC 44-2019, AC9-2019; 1/2/2019).", "Cola sin cierre."],
    ["SC1121-2018", "M. PONENTE", ": JUAN PÉREZ", "TEMA: contratos", "Reseña que", "RELATORÍA", "sigue.", "AC9-2019", "Otra reseña.", "Índice alfabético", "Abuso, 1"],
]


def test_digest(spark):
    rows = sorted(L.digest_sections(lines(spark, {"d": DIGEST, "e": [["nada", "más"]]})).collect(), key=lambda r: (r.doc_id, r.seccion, r.n, r.pos))
    found = {}
    for r in rows:
        found.setdefault((r.doc_id, r.seccion, r.titulo), []).append(r.texto)
    assert found == {
        ("d", "extracto", "SC1121-2018"): ["ABUSO DEL DERECHO", "Primera frase que sigue en otra línea.", "Segunda con cita (SC1121-2018; 18/04/2018)"],
        ("d", "extracto", "SC44-2019"): ["Tercera que pasa de página (SC 44-2019, AC9-2019; 1/2/2019).", "Cola sin cierre."],
        ("d", "providencia", "SC1121-2018"): ["M. PONENTE: JUAN PÉREZ", "TEMA: contratos", "Reseña que sigue."],
        ("d", "providencia", "AC9-2019"): ["Otra reseña."],
    }


def test_headers_by_share_of_pages(spark):
    rows = lines(spark, {"a": [["x", "y"], ["x ", "z"], ["w"]], "b": [["x"], ["y"]]})
    assert sorted(map(tuple, L.running_headers(rows).collect())) == [("a", "x")]
    assert sorted(map(tuple, L.running_headers(rows, 0.5).collect())) == [("a", "x"), ("b", "x"), ("b", "y")]
    assert L.running_headers(rows.limit(0)).count() == 0
