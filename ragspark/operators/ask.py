"""From questions to verified answers: lookup, lexical and dense candidates, quotas, reranking, fusion, answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import citations as C
from ragspark.functions import text as T
from ragspark.operators import chain as G
from ragspark.operators import index as I
from ragspark.operators import models as M
from ragspark.operators import ranking as R
from ragspark.operators import retrieval as V
from ragspark.sources.storage import stored


@dataclass(frozen=True)
class Settings:
    """Numbers of candidates and passages, what may be a candidate, caps by class and document, and how answers are made.

    Classes in ``harvested`` and documents in ``lookup_only`` are no candidates;
    they come only where a question names them, or, the former, by coupling.
    """

    candidates: int = 20
    passages: int = 10
    lookup_hits: int = 4
    parts_of_article: int = 2
    caps: dict[str, int] = field(default_factory=lambda: {"sentencia": 4, "voto": 1})
    factors: dict[str, float] = field(default_factory=lambda: {"derogado": 0.8, "inexequible": 0.7})
    harvested: tuple[str, ...] = ()
    lookup_only: tuple = ()
    per_document: int | None = None
    primary: str = "norma"
    primaries: int = 0
    coupled: int = 0
    coupled_list: int = 300
    core: int = 10
    terms: Callable[[Column], Column] = T.index_terms
    policy: G.Policy = G.Policy()


#: Words by which a question asks for case law, in normalised text.
CASE_LAW = (r"\b(?:sentencias?|jurisprudencia\w*|precedentes?|providencias?|fallos?|corte constitucional|corte suprema|consejo de estado|ratio decidendi|"
            r"magistrad[oa] ponente|salvamento|aclaracion de voto)\b")


def named_bodies(questions: DataFrame, index: I.CitationIndex) -> DataFrame:
    """(qid, body, article, tipo) that questions(qid, text) name, rulings without a year if only one may be meant."""
    cites = questions.select("qid", F.explode(C.query_citations(F.col("text"))).alias("c"))
    full = cites.select("qid", I.body_text(F.col("c")).alias("body"), F.lower("c.articulo").alias("article"), "c.tipo")
    short = C.yearless_rulings(questions, index.rulings).select(
        "qid", F.concat_ws("/", "tipo", "numero", "anio").alias("body"), F.lit(None).cast("string").alias("article"), "tipo")
    return full.union(short).distinct()


def named(questions: DataFrame, index: I.CitationIndex, s: Settings) -> DataFrame:
    """Fragments that questions(qid, text) name: those of a cited article, else the card of a cited norm."""
    cited = named_bodies(questions, index).drop("tipo")
    return V.lookup_hits(cited, index.of("articles", cited).drop("part"), index.of("cards", cited), s.parts_of_article, s.lookup_hits)


def allowed(fragments: DataFrame, s: Settings) -> DataFrame | None:
    """Chunks that may be candidates, as ``doc_id`` of the stored parts; None if all may."""
    if not s.harvested and not s.lookup_only:
        return None
    free = F.lit(True)
    if s.harvested:
        free = free & ~F.coalesce(F.col("clase"), F.lit("")).isin(*s.harvested)
    if s.lookup_only:
        free = free & ~F.col("doc_id").isin(*s.lookup_only)
    return fragments.filter(free).select(F.col("chunk_id").alias("doc_id"))


def candidates(
    questions: DataFrame, path: str, n: int, model: I.Model | None = None, only: DataFrame | None = None, terms: Callable[[Column], Column] = T.index_terms,
) -> DataFrame:
    """The ``n`` best chunks of questions(qid, text) among ``only``: lexical, or fused with dense ones if there is an encoder."""
    spark = questions.sparkSession
    asked = V.query_terms(questions, terms(F.col("text")), "qid")
    lexical = V.bm25_topk(I.load_lexical(spark, path, V.vocabulary_of(asked)), asked, n, only=only)
    if model is None:
        return lexical
    head = I.prefixes(model.name)["query"]
    vectors = questions.select("qid", model.encode(F.concat(F.lit(head), F.col("text"))).alias("v")).withColumn("v", I.normalised(F.col("v")))
    columns = ["qid", "doc_id", "chunk_id", "score", "pos"]
    dense = V.dense_topk(vectors, V.masked(I.load_dense(spark, path), only), n)
    return R.rrf(dense.select(*columns).withColumn("list_ord", F.lit(0)).unionByName(lexical.select(*columns).withColumn("list_ord", F.lit(1)))).filter(F.col("pos") <= n)


def preselected(questions: DataFrame, path: str, fragments: DataFrame, s: Settings, model: I.Model | None = None) -> DataFrame:
    """Candidates for the reranker: capped by class out of three times as many, with ``s.primaries`` primaries among them."""
    about = ["doc_id", "chunk_id", "clase", "vigencia", "texto"]

    def held(n: int, only: DataFrame | None) -> DataFrame:
        found = candidates(questions, path, n, model, only, s.terms).select("qid", "pos", F.col("doc_id").alias("chunk_id"))
        return V.beside(found, fragments.select(*about), "chunk_id").withColumn("score", F.lit(0.0))

    mask = allowed(fragments, s)
    first = stored(R.type_quota(held(3 * s.candidates, mask), s.caps, s.candidates, factor=s.candidates / s.passages), "preselected")
    if not s.primaries:
        return first
    own = fragments.filter(F.col("clase") == s.primary).select(F.col("chunk_id").alias("doc_id"))
    best = held(s.primaries, own if mask is None else V.masked(own, mask))
    return stored(R.guarantee(first, best, s.candidates, F.col("clase") == s.primary), "with-primaries")


def by_coupling(questions: DataFrame, path: str, fragments: DataFrame, index: I.CitationIndex, first: DataFrame, s: Settings) -> DataFrame:
    """Harvested rulings for questions that ask for case law and name none, by the norms that they share with the question."""
    cites = named_bodies(questions, index)
    asks = questions.filter(T.norm(F.col("text")).rlike(CASE_LAW)).join(cites.filter("tipo = 'jurisprudencia'").select("qid").distinct(), "qid", "left_anti")
    harvested = fragments.filter(F.col("clase").isin(*s.harvested))
    lists = candidates(asks, path, s.coupled_list, None, harvested.select(F.col("chunk_id").alias("doc_id")), s.terms)
    lists = V.beside(lists.select("qid", "pos", F.col("doc_id").alias("chunk_id")), harvested.select("doc_id", "chunk_id"), "chunk_id")
    norms = index.norms.filter(~F.col("body").startswith("jurisprudencia/"))
    core = V.core_bodies(cites.filter("tipo <> 'jurisprudencia'"), first, norms, s.core, F.col("clase") == s.primary)
    edges = index.cited.join(harvested.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "body")
    return V.coupled(lists, edges, stored(core.join(asks.select("qid"), "qid", "left_semi"), "core"), s.coupled)


def retrieve(questions: DataFrame, path: str, s: Settings = Settings(), model: I.Model | None = None, scorer: M.Scorer = M.token_overlap, rules: DataFrame | None = None) -> DataFrame:
    """The passages of questions(qid, text), ``s.passages`` at most, from the index at ``path``.

    Candidates are preselected, joined by rulings that share their norms,
    reranked, lowered where no longer in force and capped by document; they come
    behind what the question names, and are capped by class once more. Fixed
    passages of rules take the last places.
    """
    spark = questions.sparkSession
    fragments, cites = I.load_fragments(spark, path), I.load_citations(spark, path)
    first = preselected(questions, path, fragments, s, model)
    if s.coupled and s.harvested:
        more = by_coupling(questions, path, fragments, cites, first, s).select("qid", "doc_id", "chunk_id", F.col("pos").alias("_more"))
        fresh = V.beside(more.join(first.select("qid", *R.KEY), ["qid", *R.KEY], "left_anti"), fragments.select("doc_id", "chunk_id", "clase", "vigencia", "texto"), ["doc_id", "chunk_id"])
        behind = fresh.select("qid", (F.col("_more") + 4 * s.candidates).alias("pos"), "doc_id", "chunk_id", "clase", "vigencia", "texto", F.lit(0.0).alias("score"))
        first = first.select(*behind.columns).unionByName(behind)
    ranked = R.penalise(M.reranked(first, questions, scorer), s.factors)
    if s.per_document:
        ranked = R.per_document_cap(ranked, s.per_document, s.passages)
    columns = ["qid", "pos", "doc_id", "chunk_id", "score", "clase", "fuente"]
    listed = stored(ranked.withColumn("fuente", F.lit("rerank")).select(*columns).withColumn("list_ord", F.lit(0)), "reranked")
    about = fragments.select("chunk_id", "clase")
    looked = V.beside(named(questions, cites, s), about, "chunk_id").withColumns({"score": F.lit(1.0), "fuente": F.lit("lookup")}).select(*columns)
    looked = stored(looked, "lookup")
    fixed = V.beside(V.rule_hits(questions, rules, s.passages), about, "chunk_id").withColumns({"score": F.lit(1.0), "fuente": F.lit("valores")}).select(*columns) if rules is not None else looked.limit(0)
    long = R.fuse(looked, listed, fixed.limit(0), s.lookup_hits + 4 * s.candidates + s.coupled)
    capped = stored(R.type_quota(long, s.caps, s.passages, F.col("fuente") == "lookup"), "capped")
    final = R.fuse(capped.limit(0), capped.withColumn("list_ord", F.lit(0)), fixed, s.passages)
    return V.beside(final.drop("clase"), fragments, ["doc_id", "chunk_id"])


def ask(
    spark: SparkSession, questions: DataFrame, path: str, s: Settings = Settings(), generator: G.Generator | None = None, model: I.Model | None = None,
    scorer: M.Scorer = M.token_overlap, rules: DataFrame | None = None, replan: Callable[[DataFrame], DataFrame] | None = None, least_score: float = 0.0,
) -> DataFrame:
    """Answers (see ``answering.ANSWER``) to questions(id, formato, pregunta, opciones) from the index at ``path``.

    ``replan`` may turn questions(qid, text) whose best passage scores below
    ``least_score``, and which name no norm, into others; they are retrieved once more.
    """
    options = F.when(F.col("opciones").isNotNull(), F.array_join(F.transform(F.array_sort(F.map_entries("opciones")), lambda e: e["value"]), "\n"))
    asked = questions.select(F.col("id").cast("long").alias("qid"), F.concat_ws("\n", "pregunta", options).alias("text"))
    passages = retrieve(asked, path, s, model, scorer, rules)
    if replan is not None:
        best = passages.groupBy("qid").agg(F.max(F.when(F.col("fuente") == "rerank", F.col("score"))).alias("best"), F.max((F.col("fuente") == "lookup").cast("int")).alias("named"))
        weak = best.filter((F.col("named") == 0) & (F.coalesce("best", F.lit(-1.0)) < least_score)).select("qid")
        again = retrieve(replan(asked.join(weak, "qid")), path, s, model, scorer, rules)
        passages = passages.join(again.select("qid").distinct(), "qid", "left_anti").unionByName(again)
    return G.answered(questions, passages, s.policy, generator)
