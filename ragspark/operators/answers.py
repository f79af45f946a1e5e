"""Answers as tables: evidence selection, verification, abstention and submissions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import citations as C
from ragspark.functions import text as T
from ragspark.operators.answering import choose_diverse, with_gaps
from ragspark.operators.index import body_text
from ragspark.sources.storage import stored

#: Letters of a closed question, sources outside the rerank score, passages that back citations.
LETTERS = ("A", "B", "C", "D")
UNSCORED = ("lookup", "valores")
BACKING = 10
#: Uses of words that read as a citation and are none: the body, the pattern, what replaces it.
FALSE_USES = (
    ("constitucion", r"(?U)\bconstituci([oó])n\b(?!\s+(?:pol[ií]tica|nacional))", "conformaci$1n"),
    ("estatuto_tributario", r"(?iU)\bet\s+al\.?", "y otros"),
)
UNBACKED, OK = "cita_sin_respaldo", "ok"


def compressed(passages: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Passages(keys, pos, piece, relevance) cut to the pieces chosen for diversity; relevance is min-max scaled in each.

    ``vista`` is the passage that is left, with a mark for each gap; it stands beside every chosen piece.
    """
    fields = ", ".join(f"`{k}` {passages.schema[k].dataType.simpleString()}" for k in keys)
    own = Window.partitionBy(*keys)
    low, high = F.min("relevance").over(own), F.max("relevance").over(own)
    scaled = passages.withColumn("relevance", F.when(high > low, (F.col("relevance") - low) / (high - low)).otherwise(F.lit(1.0)))

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", ignore_index=True)
        pieces = group["piece"].tolist()
        at = choose_diverse([list(r) for r in group["_roots"]], np.array([len(p) for p in pieces]), group["relevance"].to_numpy(float), budget)
        return group.iloc[at][[*keys, "pos", "piece"]].assign(vista=with_gaps(pieces, at))

    return scaled.withColumn("_roots", T.index_terms(F.col("piece"))).groupBy(*keys).applyInPandas(select, f"{fields}, pos int, piece string, vista string")


def without_unbacked(sentences: DataFrame, backed: DataFrame) -> DataFrame:
    """Rows (qid, pos, sentence, bodies) flagged ``removed`` where a cited body is not among the query's ``backed``."""
    cited = sentences.select("qid", "pos", F.explode("bodies").alias("body"))
    bad = cited.join(backed.select("qid", "body").distinct(), ["qid", "body"], "left_anti").select("qid", "pos").distinct()
    return sentences.join(bad.withColumn("_bad", F.lit(True)), ["qid", "pos"], "left").withColumn(
        "removed", F.coalesce("_bad", F.lit(False))).drop("_bad")


def cited_bodies(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, body) that rows(keys, texto) cite; texts without a mark of a citation do not leave the JVM."""
    return rows.select(*keys, F.explode(C.bodies(C.citations(F.col("texto")))).alias("b")).select(*keys, body_text(F.col("b")).alias("body")).distinct()


def verified(fields: DataFrame, backed: DataFrame, fills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers whose every citation is backed: fields(qid, campo, ord, texto, rellenado), and verdicts(qid, veredicto, quitadas).

    Three steps of anti joins on bodies. Of fields(qid, campo, ord, texto), with
    words that only look like a citation rewritten where their body is not among
    backed(qid, body), each sentence that cites another body goes. Then the
    fields are read as one text, in their order: a field that cites what is
    still not backed is emptied. If the text still does, as a citation may span
    two fields, all fields are. A field that is empty after a step takes its
    text from fills(qid, campo, texto), which cites nothing that is not backed.
    """
    known = backed.select("qid", "body").distinct()
    flags = known.groupBy("qid").agg(*[F.max(F.col("body") == body).alias(f"_has{i}") for i, (body, _, _) in enumerate(FALSE_USES)])
    rows = fields.select("qid", "campo", "ord", F.coalesce("texto", F.lit("")).alias("texto")).join(flags, "qid", "left")
    text = F.col("texto")
    for i, (_, pattern, instead) in enumerate(FALSE_USES):
        text = F.when(F.coalesce(F.col(f"_has{i}"), F.lit(False)), text).otherwise(F.regexp_replace(text, pattern, instead))
    rows = stored(rows.select("qid", "campo", "ord", text.alias("texto")), "rewritten")
    filling = fills.select("qid", "campo", F.col("texto").alias("_fill"))

    def unbacked(of: DataFrame, *keys: str) -> DataFrame:
        return cited_bodies(of, "qid", *keys).join(known, ["qid", "body"], "left_anti")

    def whole(of: DataFrame) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("ord", "texto")))
        return of.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["texto"]), " ").alias("texto"))

    def refilled(of: DataFrame, done: Column) -> DataFrame:
        empty = F.trim("texto") == ""
        filled = of.join(filling, ["qid", "campo"], "left")
        return filled.withColumn("rellenado", done | (empty & F.col("_fill").isNotNull())).withColumn("texto", F.when(empty, F.coalesce("_fill", F.lit(""))).otherwise(F.col("texto"))).drop("_fill")

    pieces = stored(rows.select("qid", "campo", F.posexplode(T.sentences(F.col("texto"))).alias("pos", "texto")), "sentences")
    bad = stored(unbacked(pieces, "campo", "pos"), "unbacked")
    kept = pieces.join(bad.select("qid", "campo", "pos").distinct(), ["qid", "campo", "pos"], "left_anti")
    listed = F.array_sort(F.collect_list(F.struct("pos", "texto")))
    joined = kept.groupBy("qid", "campo").agg(T.joined_parts(F.transform(listed, lambda x: x["texto"])).alias("texto"))
    first = refilled(rows.drop("texto").join(joined, ["qid", "campo"], "left").withColumn("texto", F.coalesce("texto", F.lit(""))), F.lit(False))
    first = stored(first, "checked-sentences")

    rest = stored(unbacked(whole(first)), "unbacked-whole")
    holds = cited_bodies(first.join(rest.select("qid").distinct(), "qid", "left_semi"), "qid", "campo").join(rest, ["qid", "body"], "left_semi").select("qid", "campo").distinct()
    second = first.join(holds.withColumn("_gone", F.lit(True)), ["qid", "campo"], "left").withColumn("texto", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("texto"))).drop("_gone")
    second = stored(refilled(second, F.col("rellenado")), "checked-fields")

    still = unbacked(whole(second.join(rest.select("qid").distinct(), "qid", "left_semi"))).select("qid").distinct()
    third = second.join(still.withColumn("_gone", F.lit(True)), "qid", "left").withColumn("texto", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("texto"))).drop("_gone")
    third = refilled(third, F.col("rellenado"))

    removed = bad.select("qid", "body").union(rest.select("qid", "body")).groupBy("qid").agg(F.array_sort(F.collect_set("body")).alias("quitadas"))
    verdicts = fields.select("qid").distinct().join(removed, "qid", "left").select(
        "qid", F.when(F.col("quitadas").isNotNull(), F.lit(UNBACKED)).otherwise(F.lit(OK)).alias("veredicto"), F.coalesce("quitadas", F.array().cast("array<string>")).alias("quitadas"))
    return third.select("qid", "campo", "ord", "texto", "rellenado"), verdicts


def backing_bodies(passages: DataFrame, first: int = BACKING) -> DataFrame:
    """Bodies(qid, body) cited by the first passages of each query."""
    return passages.filter(F.col("pos") <= first).select("qid", F.explode("bodies").alias("body")).distinct()


def weak_evidence(questions: DataFrame, passages: DataFrame, threshold: float) -> DataFrame:
    """``debil``: free-text questions without lookup hits whose best scored passage is below the threshold."""
    best = passages.groupBy("qid").agg(
        F.max(F.when(~F.col("fuente").isin(*UNSCORED), F.col("score"))).alias("mejor"),
        F.max((F.col("fuente") == "lookup").cast("int")).alias("_lookup"),
    )
    weak = (F.col("formato") != "cerrada") & (F.coalesce("_lookup", F.lit(0)) == 0) & F.col("mejor").isNotNull() & (F.col("mejor") < threshold)
    return questions.join(best, "qid", "left").withColumn("debil", F.coalesce(weak, F.lit(False))).drop("_lookup")


def abstention(answers: DataFrame) -> DataFrame:
    """``abstencion``: insufficient or empty open answers; closed ones never abstain."""
    empty = F.trim(F.coalesce("respuesta", F.lit(""))) == ""
    return answers.withColumn("abstencion", (F.col("formato") != "cerrada") & (F.coalesce("insuficiente", F.lit(False)) | empty))


def two_pass(weak: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The second retrieval for weak questions, the first for the others; ``iterations`` tells which."""
    again = weak.filter("debil").select("qid")
    return first.join(again, "qid", "left_anti").withColumn("iterations", F.lit(1)).unionByName(
        second.join(again, "qid", "left_semi").withColumn("iterations", F.lit(2)))


def discards(options: Column, chosen: Column, default: str = "No corresponde.") -> Column:
    """Map of exactly the letters not chosen, with a default reason."""
    others = F.filter(F.array(*map(F.lit, LETTERS)), lambda x: x != chosen)
    return F.map_from_entries(F.transform(others, lambda x: F.struct(x, F.coalesce(F.get(options, F.array_position(F.array(*map(F.lit, LETTERS)), x).cast("int") - 1), F.lit(default)))))


def submission_errors(subs: DataFrame, known_ids: DataFrame) -> DataFrame:
    """One row per broken rule of each submission line, and of each known id that no line has."""
    times = F.count(F.lit(1)).over(Window.partitionBy("id"))
    rules = F.array(
        F.when(~F.col("_known"), F.lit("id desconocido")),
        F.when(~F.col("_sent"), F.lit("sin entrega")),
        F.when(F.col("_times") > 1, F.lit("id repetido")),
        F.when((F.col("formato") == "cerrada") & ~F.col("letra").isin(*LETTERS), F.lit("letra no valida")),
        F.when(~F.col("abstencion") & (F.trim(F.coalesce("respuesta", F.lit(""))) == ""), F.lit("respuesta vacia")),
        F.when(F.col("n_pasajes") > BACKING, F.lit("demasiados pasajes")),
        F.when(F.isnan("score") | (F.abs("score") == float("inf")), F.lit("numero no finito")),
    )
    sent = subs.withColumn("_times", times).withColumn("_sent", F.lit(True))
    marked = sent.join(known_ids.select("id").distinct().withColumn("_known", F.lit(True)), "id", "full")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_known", "_sent")})
    return marked.select("id", F.explode(F.array_compact(rules)).alias("error"))


def passage_errors(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """passages(id, pos, doc_id, inicio, fin, texto) whose document is unknown or whose text is not that slice of texts(doc_id, completo)."""
    found = passages.join(texts.select("doc_id", "completo"), "doc_id", "left")
    slice_ = F.substr("completo", (F.col("inicio") + 1).cast("int"), (F.col("fin") - F.col("inicio")).cast("int"))
    error = F.when(F.col("completo").isNull(), F.lit("documento desconocido")).when(~F.coalesce(slice_ == F.col("texto"), F.lit(False)), F.lit("texto distinto"))
    return found.withColumn("error", error).filter("error IS NOT NULL").select("id", "pos", "doc_id", "error")


def unbacked_citations(answers: DataFrame, passages: DataFrame, first: int = BACKING) -> DataFrame:
    """(id, body) cited by answers(id, texto) and by none of the first passages(id, pos, texto) of their question."""
    def cited(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.explode(C.bodies(C.citations(F.col("texto")))).alias("body")).distinct()

    return cited(answers).join(cited(passages.filter(F.col("pos") <= first)), ["id", "body"], "left_anti")


def shown_citations(answers: DataFrame, passages: DataFrame, first: int = BACKING) -> DataFrame:
    """What a reader is shown of answers(id, texto): each citation, whether passages(id, pos, texto) back its norm and hold its article, and where.

    A norm without an article is left out where the answer cites one of its
    articles; "3o" is article 3. ``pasajes`` has the positions of the passages
    that cite the norm.
    """
    def cited(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("id", *more, F.explode(C.citations(F.col("texto"))).alias("c")).withColumn("_body", F.struct("c.tipo", "c.numero", "c.anio"))

    whole = Window.partitionBy("id", "_body")
    own = cited(answers).withColumn("_some", F.max(F.col("c.articulo").isNotNull()).over(whole)).filter(F.col("c.articulo").isNotNull() | ~F.col("_some"))
    there = cited(passages.filter(F.col("pos") <= first), "pos")
    held = there.groupBy("id", "_body").agg(F.array_sort(F.collect_set("pos")).alias("pasajes"), F.collect_set(C.without_ordinal(F.col("c.articulo"))).alias("_articles"))
    found = own.join(held, ["id", "_body"], "left")
    article = F.coalesce(F.array_contains("_articles", C.without_ordinal(F.col("c.articulo"))), F.lit(False))
    return found.select("id", "c", C.display_name(F.col("c")).alias("cita"), F.col("pasajes").isNotNull().alias("respaldada"), article.alias("articulo_en_pasajes"),
                        F.coalesce("pasajes", F.array().cast("array<int>")).alias("pasajes"))
