"""From passages to verified answers as one plan: what a generator says or the evidence gives, checked, referenced and extended.

Every rule is a join, a grouping or an expression over rows of fields; only a
generator that is plugged in runs as Python, once a question, and its failure is
that question's alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import citations as C
from ragspark.functions import text as T
from ragspark.operators import answers as A
from ragspark.operators import answering as G
from ragspark.operators.index import body_text
from ragspark.sources.storage import stored

Generator = Callable[[dict, list[dict]], dict]
#: Words of a sentence that may extend an answer, and how alike what is said may be to it.
EXTENSION_WORDS, MOST_ALIKE = (5, 60), 0.5
ANSWER = (
    "id long, formato string, abstencion boolean, respuesta_correcta string, justificacion string, descarte_opciones map<string,string>, respuesta string, "
    "palabras_clave array<string>, referencia_legal string, marco_normativo string, analisis string, jurisprudencia string, conclusion string, "
    "veredicto string, motivo string, quitadas array<string>, rellenados array<string>, respaldo string, error string"
)
_SAID = "id long, campos map<string,string>, letra string, motivos map<string,string>, claves array<string>, respaldo string"


@dataclass(frozen=True)
class Policy:
    """How answers are made: threshold of abstention, references to add by kind, whether to extend."""

    least_score: float | None = None
    sources: int = 10
    mentions: int = 0
    extend: bool = True


def evidence_of(passages: DataFrame, most: int = G.BACKING) -> DataFrame:
    """passages(qid, pos, doc_id, norma, articulo, texto, score, fuente) as evidence with ``cita``, ``cuerpo`` and ``raices``, ``most`` a question."""
    rows = passages.filter(F.col("pos") <= most).select(
        F.col("qid").alias("id"), "pos", F.col("doc_id").cast("string").alias("doc_id"), "norma", "articulo", "texto", "score", "fuente")
    return stored(rows.withColumns({
        "cita": G.cite(F.col("norma"), F.col("articulo")), "cuerpo": G.body_of(F.col("texto"), F.col("norma")), "raices": F.array_distinct(T.index_terms(F.col("texto")))}), "evidence")


def generated(asked: DataFrame, evidence: DataFrame, generator: Generator) -> DataFrame:
    """(_SAID) of a generator on each question; one that fails says nothing and its error's name is told as ``respaldo``."""
    fields = ("pos", "doc_id", "norma", "articulo", "texto", "score", "fuente")
    listed = evidence.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pasajes"))

    def text(value) -> str | None:
        parts = [v.strip() for v in (value if isinstance(value, list) else [value]) if isinstance(v, str) and v.strip()]
        return " ".join(parts) or None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for q in batch.to_dict("records"):
                passages = list(q.pop("pasajes")) if q["pasajes"] is not None else []
                try:
                    said = generator({**q, "opciones": dict(q["opciones"] or {})}, passages)
                    parts = [said.get(f) for f in ("respuesta_directa", "fundamento", "alcance")]
                    if parts[0] is not None:
                        said = {**said, "respuesta": [p for p in parts if p]}
                    reasons = said.get("descarte_opciones")
                    rows.append({
                        "id": q["id"], "campos": {f: t for f in G.TEXTS if (t := text(said.get(f)))}, "letra": text(said.get("respuesta_correcta")),
                        "motivos": {k: t for k, v in reasons.items() if (t := text(v))} if isinstance(reasons, dict) else {},
                        "claves": [k.strip() for k in said.get("palabras_clave") or [] if isinstance(k, str) and k.strip()][:6], "respaldo": None})
                except Exception as error:  # whatever a model's client raises must not end the run
                    rows.append({"id": q["id"], "campos": {}, "letra": None, "motivos": {}, "claves": [], "respaldo": type(error).__name__})
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _SAID.split(", ")])

    return stored(asked.join(listed, "id", "left").mapInPandas(run, _SAID), "generated")


def chosen_letters(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, elegida): the option with the largest share of its roots in the evidence; then by their number, then the first letter."""
    roots = evidence.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("raices"))).alias("hay"))
    options = asked.filter("formato = 'multiple_choice' AND opciones IS NOT NULL").select("id", F.explode("opciones").alias("letra", "t"))
    options = options.withColumn("own", F.array_distinct(T.index_terms(F.col("t")))).join(roots, "id", "left")
    n = F.size(F.array_intersect("own", F.coalesce("hay", F.array().cast("array<string>"))))
    share = F.when(F.size("own") > 0, n / F.size("own")).otherwise(F.lit(0.0))
    return options.groupBy("id").agg(F.min_by("letra", F.struct((-share).alias("s"), (-n).alias("n"), "letra")).alias("elegida"))


def closest_cites(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, cercana): the citation of the passage that shares most roots with wanted(id, t), the first of equals."""
    asked = wanted.withColumn("own", F.array_distinct(T.index_terms(F.col("t"))))
    near = evidence.join(asked, "id").withColumn("_n", F.size(F.array_intersect("own", "raices")))
    return near.groupBy("id").agg(F.min_by("cita", F.struct((-F.col("_n")).alias("n"), "pos")).alias("cercana"))


def defaults(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, elegida, campos): what each field says where nothing else does, from the evidence alone; null where it gives nothing."""
    letters = chosen_letters(asked, evidence)
    norms = evidence.groupBy("id", "norma").agg(F.min(F.struct("pos", "cita")).alias("c"))
    first = evidence.groupBy("id").agg(
        F.min_by(F.struct("cita", G.leading(F.col("cuerpo"), 3, 110).alias("corto"), G.leading(F.col("cuerpo"), 5, 160).alias("largo")), "pos").alias("p"),
        F.min_by("norma", F.when(F.lower("norma").startswith("sentencia"), F.col("pos"))).alias("fallo"))
    listed = norms.groupBy("id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["cita"]), 1, 3), "; ").alias("normas"))
    base = asked.join(letters, "id", "left").withColumn("letra", F.coalesce("given", "elegida", F.lit("A")))
    wanted = base.filter("formato = 'multiple_choice'").select("id", F.coalesce(F.nullif(F.try_element_at("opciones", F.col("letra")), F.lit("")), "pregunta").alias("t"))
    full = base.join(first, "id", "left").join(listed, "id", "left").join(closest_cites(wanted, evidence), "id", "left")
    option = F.concat(F.lit("La opción "), F.col("letra"))
    start = F.concat(F.lit("Conforme a lo dispuesto en "), F.col("p.cita"), F.lit(": "))
    given = {
        "justificacion": F.when(F.col("cercana").isNotNull(), F.concat(option, F.lit(" se ajusta a lo dispuesto en "), F.col("cercana"), F.lit("."))).otherwise(
            F.concat(option, F.lit(" es la que mejor corresponde a la pregunta."))),
        "respuesta": F.concat(start, F.col("p.corto")), "referencia_legal": F.col("p.cita"), "marco_normativo": F.concat(F.col("normas"), F.lit(".")),
        "analisis": F.concat(start, F.col("p.largo")), "jurisprudencia": F.when(F.col("p").isNotNull(), F.coalesce(F.concat("fallo", F.lit(".")), F.lit(G.NO_RULINGS))),
        "conclusion": F.concat(F.lit("La solución del caso se rige por "), F.col("p.cita"), F.lit(".")),
    }
    return full.select("id", "letra", F.create_map(*[x for f, c in given.items() for x in (F.lit(f), c)]).alias("por_defecto"))


def field_rows(answers: DataFrame, column: str) -> DataFrame:
    """(qid, campo, ord, texto) of the cited fields of answers(id, formato, <column> map)."""
    order = F.create_map(*[x for form, f in G.FORMS.items() for x in (F.lit(form), F.array(*map(F.lit, f.cited)))])
    return answers.select(F.col("id").alias("qid"), F.posexplode(F.element_at(order, F.col("formato"))).alias("ord", "campo"), F.col(column).alias("_m")).select(
        "qid", "campo", "ord", F.coalesce(F.try_element_at("_m", F.col("campo")), F.lit("")).alias("texto"))


def assembled(said: Column, form: str, field: str) -> Column:
    """A generator's text of a field: cleaned, and capped where the field has limits."""
    text = T.clean(F.trim(F.coalesce(F.try_element_at(said, F.lit(field)), F.lit(""))))
    limit = G.FORMS[form].limits.get(field)
    return F.array_join(T.capped(T.sentences(text), limit[0], limit[1] or 1 << 30), " ") if limit else text


def references(fields: DataFrame, asked: DataFrame, evidence: DataFrame, sources: int, mentions: int) -> DataFrame:
    """(qid, campo, nuevas) to be added to the field for references: norms of the passages it leaves out, their own, then those they mention most."""
    reference = reduce(lambda acc, x: acc.when(F.col("formato") == x[0], x[1].reference), list(G.FORMS.items())[1:], F.when(F.col("formato") == "multiple_choice", "justificacion"))
    own = fields.join(asked.select(F.col("id").alias("qid"), "formato"), "qid").filter(F.col("campo") == reference)
    own = stored(own.select("qid", "campo", "texto", C.citations(F.col("texto")).alias("hay")), "reference-fields")
    cites = G.cites_by_norm(evidence.withColumnRenamed("id", "qid")).withColumn("c", C.citations(F.col("cita"))).join(own, "qid")
    known = F.when(F.size("c") > 0, F.size(F.array_except("c", "hay")) == 0).otherwise(F.lower("texto").contains(F.lower("cita")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    first = stored(cites.filter(~known).withColumn("_n", place).filter(F.col("_n") <= max(sources, 0)).select("qid", "pos", "cita", "c"), "references")
    bodies = own.select("qid", F.explode(C.bodies(F.col("hay"))).alias("b")).union(first.select("qid", F.explode(C.bodies(F.col("c"))).alias("b"))).distinct()
    listed = first.select("qid", F.lit(0).alias("part"), F.col("pos").cast("long").alias("at"), "cita")
    if mentions > 0:
        told = evidence.select(F.col("id").alias("qid"), "pos", F.explode(C.bodies(C.citations(F.col("texto")))).alias("b"))
        counted = told.groupBy("qid", "b").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).join(bodies, ["qid", "b"], "left_anti")
        named = counted.withColumn("cita", C.checked_name(F.col("b.tipo"), F.col("b.numero"), F.col("b.anio"))).filter("cita IS NOT NULL")
        order = [F.desc("n"), F.col("first"), *[F.coalesce(F.col(f"b.{x}"), F.lit("")) for x in ("tipo", "numero", "anio")]]
        named = named.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("at") <= mentions)
        listed = listed.union(named.select("qid", F.lit(1), F.col("at").cast("long"), "cita"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", "cita")))
    new = listed.groupBy("qid").agg(F.transform(ordered, lambda x: x["cita"]).alias("nuevas"))
    return new.join(own.select("qid", "campo"), "qid")


def referenced(text: Column, form: Column, new: Column) -> Column:
    """A field with its new references, each kind of answer in its own way."""
    base, listed = F.rtrim(F.coalesce(text, F.lit("")), F.lit(" .;")), F.array_join(new, "; ")
    reason = F.concat(F.when(base != "", F.concat(base, F.lit(". "))).otherwise(F.lit("")), F.lit("Fundamento normativo: "), listed, F.lit("."))
    plain = F.concat_ws("; ", F.nullif(base, F.lit("")), listed)
    return F.when(new.isNull(), text).when(form == "multiple_choice", reason).when(form == "open_ended", F.concat(plain, F.lit("."))).otherwise(plain)


def extended(fields: DataFrame, asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, campo, largo): fields below their least number of sentences, with sentences of the passages behind.

    Candidates have so many words and are unlike what is said. Those of norms
    that the answer cites come first, then by the rounded share of the
    question's roots, then by the passages' order. They are taken in that order
    by a fold, each if it is unlike those taken and the words do not get too many.
    """
    least = [(form, *f.least) for form, f in G.FORMS.items() if f.least]
    fits = reduce(lambda a, b: a | b, [(F.col("formato") == form) & (F.col("campo") == field) for form, field, _, _ in least])
    n = reduce(lambda acc, x: acc.when(F.col("formato") == x[0], x[2]), least[1:], F.when(F.col("formato") == least[0][0], least[0][2]))
    most = reduce(lambda acc, x: acc.when(F.col("formato") == x[0], x[3] or 1 << 30), least[1:], F.when(F.col("formato") == least[0][0], least[0][3] or 1 << 30))
    forms = asked.select(F.col("id").alias("qid"), "formato", "pregunta")
    short = fields.join(forms, "qid").filter(fits & (F.trim("texto") != "")).withColumns({"_least": n, "_most": most})
    short = short.filter(F.size(T.sentences(F.col("texto"))) < F.col("_least")).withColumn("base", T.semicolons_to_sentences(F.col("texto")))
    said = short.select("qid", F.explode(T.sentences(F.col("base"))).alias("s")).withColumn("r", F.array_distinct(T.index_terms(F.col("s"))))
    short = stored(short.join(said.groupBy("qid").agg(F.collect_list("r").alias("dichas")), "qid").withColumn("asked", F.array_distinct(T.index_terms(F.col("pregunta")))), "short-answers")
    cited = A.cited_bodies(fields.filter("ord < 2"), "qid")
    own = A.cited_bodies(evidence.select(F.col("id").alias("qid"), "pos", F.col("norma").alias("texto")), "qid", "pos").join(cited, ["qid", "body"], "left_semi").select("qid", "pos").distinct()
    pool = evidence.withColumnRenamed("id", "qid").join(own.withColumn("_own", F.lit(0)), ["qid", "pos"], "left").withColumn("_own", F.coalesce("_own", F.lit(1)))
    pool = pool.join(short.select("qid", "dichas", "asked"), "qid").select("qid", "pos", "_own", "norma", "articulo", "doc_id", "dichas", "asked", F.explode(T.sentences(F.col("cuerpo"))).alias("s"))
    pool = pool.filter(T.word_count(F.col("s")).between(*EXTENSION_WORDS)).withColumn("r", F.array_distinct(T.index_terms(F.col("s"))))
    pool = pool.filter(F.forall("dichas", lambda d: T.jaccard(d, F.col("r")) <= MOST_ALIKE))
    share = F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", "r")) / F.size("asked")).otherwise(F.lit(0.0))
    quoted = G.quotation(F.col("norma"), F.col("articulo"), F.col("doc_id"), F.col("s"))
    one = F.struct("_own", (-F.round(share, 3)).alias("w"), "pos", "s", "r", quoted.alias("q"), T.word_count(quoted).alias("words"))
    ready = short.join(pool.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("pool")), "qid")
    zero = F.struct(F.array().cast("array<array<string>>").alias("taken"), F.array().cast("array<string>").alias("texts"), T.word_count(F.col("base")).alias("words"))

    def step(acc: Column, x: Column) -> Column:
        room = (F.size("dichas") + F.size(acc["texts"]) < F.col("_least")) & (acc["words"] + x["words"] <= F.col("_most"))
        take = room & F.forall(acc["taken"], lambda t: T.jaccard(t, x["r"]) <= MOST_ALIKE)
        grown = F.struct(F.concat(acc["taken"], F.array(x["r"])).alias("taken"), F.concat(acc["texts"], F.array(x["q"])).alias("texts"), (acc["words"] + x["words"]).alias("words"))
        return F.when(take, grown).otherwise(acc)

    folded = ready.withColumn("_f", F.aggregate("pool", zero, step)).filter(F.size("_f.texts") > 0)
    return folded.select("qid", "campo", F.concat_ws(" ", F.col("base"), F.array_join("_f.texts", " ")).alias("largo"))


def answered(questions: DataFrame, passages: DataFrame, policy: Policy = Policy(), generator: Generator | None = None) -> DataFrame:
    """Answers(ANSWER) to questions(id, formato, pregunta, opciones map) from their ranked passages.

    Free text without passages, whose best scored passage is below the
    threshold, or of which the generator says nothing that counts, abstains. A
    question of an unknown kind has its ``error`` and no other field.
    """
    asked = questions.select(F.col("id").cast("long").alias("id"), "formato", "pregunta", F.col("opciones").cast("map<string,string>").alias("opciones"))
    known = asked.filter(F.col("formato").isin(*G.FORMS))
    evidence = evidence_of(passages)
    said = generated(known, evidence, generator) if generator else known.select(
        "id", F.create_map().cast("map<string,string>").alias("campos"), F.lit(None).cast("string").alias("letra"), F.create_map().cast("map<string,string>").alias("motivos"),
        F.array().cast("array<string>").alias("claves"), F.lit("").alias("respaldo"))
    base = known.join(said.withColumnsRenamed({"letra": "given"}), "id").withColumn("given", F.when(F.col("given").isin(*G.LETTERS), F.col("given")))
    base = stored(base.join(defaults(base, evidence), "id"), "answers")

    best = evidence.groupBy("id").agg(F.max(F.when(~F.col("fuente").isin(*A.UNSCORED), F.col("score"))).alias("mejor"), F.lit(True).alias("hay"))
    base = base.join(best, "id", "left").withColumn("hay", F.coalesce("hay", F.lit(False)))
    free = F.col("formato") != "multiple_choice"
    low = F.lit(False) if policy.least_score is None else F.coalesce(F.col("mejor") < policy.least_score, F.lit(False))
    reason = F.when(free & ~F.col("hay"), F.lit("sin_pasajes")).when(free & low, F.lit("score_bajo"))
    text = reduce(lambda acc, x: acc.when((F.col("formato") == x[0]), x[1]), [
        (form, F.create_map(*[x for f in G.FORMS[form].fields if f in G.TEXTS for x in (F.lit(f), assembled(F.col("campos"), form, f))])) for form in list(G.FORMS)[1:]],
        F.when(F.col("formato") == "multiple_choice", F.create_map(F.lit("justificacion"), assembled(F.col("campos"), "multiple_choice", "justificacion"))))
    base = base.withColumns({"motivo": reason, "_text": text})
    # Without a generator, or where it failed, the evidence speaks; it does not where a generator left the main fields empty.
    spoke = F.col("respaldo").isNull()
    main = reduce(lambda acc, x: acc.when(F.col("formato") == x[0], x[1]), [
        (form, reduce(lambda a, b: a & b, [F.element_at("_text", F.lit(f)) == "" for f in G.FORMS[form].main])) for form in list(G.FORMS)[1:]], F.when(F.col("formato") == "multiple_choice", False))
    base = base.withColumn("motivo", F.coalesce("motivo", F.when(spoke & main, F.lit("respuesta_vacia")))).withColumn(
        "_text", F.when(spoke & (F.col("formato") == "open_ended") & (F.element_at("_text", F.lit("jurisprudencia")) == ""), F.map_zip_with(
            "_text", F.create_map(F.lit("jurisprudencia"), F.lit(G.NO_RULINGS)), lambda k, a, b: F.coalesce(F.nullif(a, F.lit("")), b))).otherwise(F.col("_text")))
    base = stored(base, "assembled")

    alive = base.filter("motivo IS NULL")
    fills = field_rows(alive, "por_defecto").drop("ord").filter("texto <> ''")
    spoken = field_rows(alive, "_text").join(alive.select(F.col("id").alias("qid"), spoke.alias("_spoke")), "qid")
    begun = spoken.join(fills.withColumnRenamed("texto", "_fill"), ["qid", "campo"], "left").withColumn(
        "texto", F.when(~F.col("_spoke") & (F.col("texto") == ""), F.coalesce("_fill", F.lit(""))).otherwise(F.col("texto"))).select("qid", "campo", "ord", "texto")
    backed = stored(A.cited_bodies(evidence.select(F.col("id").alias("qid"), "texto"), "qid"), "backed")
    checked, verdicts = A.verified(begun, backed, fills)
    checked = stored(checked, "verified")

    new = references(checked, alive, evidence, policy.sources, policy.mentions)
    forms = alive.select(F.col("id").alias("qid"), "formato")
    with_new = checked.join(new, ["qid", "campo"], "left").join(forms, "qid")
    with_new = stored(with_new.select("qid", "campo", "ord", referenced(F.col("texto"), F.col("formato"), F.col("nuevas")).alias("texto"), "rellenado", F.col("nuevas").isNotNull().alias("_new")), "referenced")
    final = with_new.withColumn("_long", F.lit(False))
    if policy.extend:
        longer = extended(with_new.select("qid", "campo", "ord", "texto"), alive, evidence)
        final = with_new.join(longer, ["qid", "campo"], "left").withColumns({"_long": F.col("largo").isNotNull(), "texto": F.coalesce("largo", "texto")})
    marks = F.array_compact(F.array(
        F.when(F.col("rellenado"), F.col("campo")), F.when(F.col("_new"), F.concat("campo", F.lit(":pasajes"))), F.when(F.col("_long"), F.lit("extension:pasajes"))))
    whole = final.groupBy(F.col("qid").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("campo", "texto"))).alias("_final"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", marks.alias("m")))), lambda x: x["m"])).alias("rellenados"))

    out = base.join(whole, "id", "left").join(verdicts.withColumnRenamed("qid", "id"), "id", "left")
    closed, none = F.col("formato") == "multiple_choice", F.array().cast("array<string>")
    away = F.col("motivo").isNotNull() & ~closed
    words = F.coalesce(F.when(F.size("claves") > 0, F.col("claves")), T.keywords(F.col("pregunta")))
    reasons = F.map_from_entries(F.transform(F.filter(F.array(*map(F.lit, G.LETTERS)), lambda x: x != F.col("letra")), lambda x: F.struct(
        x, F.coalesce(F.nullif(T.clean(F.try_element_at("motivos", x)), F.lit("")), F.lit(G.NO_REASON)))))
    made = {
        "abstencion": away, "respuesta_correcta": F.when(closed, F.col("letra")), "descarte_opciones": F.when(closed, reasons).otherwise(F.create_map().cast("map<string,string>")),
        "palabras_clave": F.when((F.col("formato") == "semi_open") & ~away, words).otherwise(none), "veredicto": F.when(away, F.lit(G.INSUFFICIENT)).otherwise(F.col("veredicto")),
        "quitadas": F.coalesce("quitadas", none), "rellenados": F.coalesce("rellenados", none), "respaldo": F.nullif(F.col("respaldo"), F.lit("")), "error": F.lit(None).cast("string"),
        **{f: F.when(away, F.lit("")).otherwise(F.coalesce(F.try_element_at("_final", F.lit(f)), F.lit(""))) for f in G.TEXTS},
    }
    columns = [c.split(" ")[0] for c in ANSWER.replace("map<string,string>", "map").split(", ")]
    kinds = dict(c.rsplit(" ", 1) for c in ANSWER.split(", "))
    done = out.withColumns(made).select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
    odd = asked.filter(F.col("formato").isNull() | ~F.col("formato").isin(*G.FORMS)).withColumn("error", F.concat(F.lit("unknown kind of question: "), F.coalesce("formato", F.lit("null"))))
    return done.unionByName(odd.select(*[(F.col(c) if c in ("id", "formato", "error") else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]))
