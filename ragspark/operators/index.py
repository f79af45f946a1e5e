"""Stored indexes: fragments, their postings and their vectors as tables, with the fingerprint of what they were made from."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import citations as C
from ragspark.functions import text as T
from ragspark.operators.retrieval import MOST_TERMS, LexicalIndex, document_ranges, lexical_index, reuse_vectors
from ragspark.sources.storage import stored

#: Version of the tokens that the lexical part holds, and of its tables.
TOKENS_VERSION = 2
#: Version of the patterns that the citation part was read with.
CITATIONS_VERSION = 1
PARTS = ("lexical", "dense", "citations")
#: Rows of a bucket of the citation part, and the most buckets of one table.
BUCKET_ROWS, MOST_BUCKETS = 1 << 20, 4096
#: What encoders of the E5 family want before queries and passages; others want nothing.
E5_PREFIXES = {"query": "query: ", "passage": "passage: "}

Encoder = Callable[[Column], Column]


def prefixes(encoder: str) -> dict[str, str]:
    return E5_PREFIXES if "e5" in encoder.lower() else {"query": "", "passage": ""}


@dataclass(frozen=True)
class Model:
    """A named encoder: a function of a text column to an array of doubles, and the longest text it reads."""

    name: str
    encode: Encoder
    max_chars: int = 1024


def hashed_roots(dim: int = 64) -> Model:
    """The encoder that needs no model: counts of hashed roots. Its vectors are lexical, not semantic."""
    def counts(texts: pd.Series) -> pd.Series:
        stems: dict[str, str] = {}

        def one(text: str) -> np.ndarray:
            found = T.roots(text, stems)
            return np.bincount([zlib.crc32(r.encode()) % dim for r in found] or [0], minlength=dim).astype(float) * bool(found)

        return texts.map(one)

    return Model(f"hashed-roots-{dim}", lambda c: F.pandas_udf(counts, "array<double>")(F.coalesce(c, F.lit(""))))


def normalised(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def fingerprint(fragments: DataFrame) -> tuple[int, str]:
    """Number of rows and a hash of (chunk_id, texto) that no order of rows changes."""
    row = fragments.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("chunk_id", "texto").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], str(row["h"] or 0)


def _note(spark: SparkSession, path: str, part: str, **values) -> None:
    rows = [(part, k, str(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "part string, name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/notes/{part}")


def notes(spark: SparkSession, path: str, part: str) -> dict[str, str]:
    """What a part was made from and how; a part that is not there is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/notes/{part}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"no {part} part of the index at {path}: build it")
    return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/notes/{part}").collect()}


def store_fragments(fragments: DataFrame, path: str) -> None:
    """The fragments in order of their ids; the parts refer to them."""
    fragments.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{path}/fragments")
    spark = fragments.sparkSession
    n, own = fingerprint(spark.read.parquet(f"{path}/fragments"))
    _note(spark, path, "fragments", n=n, fingerprint=own)


def build_lexical(spark: SparkSession, path: str, terms: Callable[[Column], Column] = T.index_terms) -> None:
    """Postings by ranges of terms, so that a query's terms prune files and row groups, and the statistics."""
    index = lexical_index(spark.read.parquet(f"{path}/fragments"), terms(F.col("texto")), "chunk_id")
    # A frequent term has a row in each block of documents, so it is dealt by both.
    index.postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    _note(spark, path, "lexical", fingerprint=notes(spark, path, "fragments")["fingerprint"], tokens=TOKENS_VERSION)


def build_dense(spark: SparkSession, path: str, model: Model, reuse: bool = True) -> dict[str, int]:
    """Vectors of all fragments; those of texts that an older index of the same model has are taken over. Tells how many were."""
    rows = spark.read.parquet(f"{path}/fragments").select(F.col("chunk_id").alias("id"), F.col("texto").alias("text"))
    head, kept = prefixes(model.name)["passage"], None
    if reuse:
        try:
            old = notes(spark, path, "dense")
            if (old["encoder"], old["max_chars"], old["prefix"]) == (model.name, str(model.max_chars), head):
                kept = spark.read.parquet(f"{path}/vectors/{old['version']}").select("id", "text", "v")
        except FileNotFoundError:
            kept = None
    # Texts meet the older vectors once, and are counted and encoded from there.
    known = stored(reuse_vectors(rows, kept), "known-vectors") if kept is not None else rows.withColumns({"v": F.lit(None).cast("array<double>"), "from_id": F.lit(None).cast("long")})
    # Only texts without a vector reach the encoder.
    encoded = known.filter("v IS NULL").withColumn("v", model.encode(F.concat(F.lit(head), F.substring("text", 1, model.max_chars))))
    both = known.filter("v IS NOT NULL").select("id", "text", "v").union(encoded.select("id", "text", normalised(F.col("v")).alias("v")))
    own = notes(spark, path, "fragments")["fingerprint"]
    version = F.sha2(F.lit(own + model.name), 256)
    version = spark.range(1).select(version.alias("v")).first()["v"][:16]
    if kept is None or old["version"] != version:
        both.write.mode("overwrite").parquet(f"{path}/vectors/{version}")
    reused, total = known.filter("v IS NOT NULL").count() if kept is not None else 0, int(notes(spark, path, "fragments")["n"])
    _note(spark, path, "dense", fingerprint=own, encoder=model.name, max_chars=model.max_chars, prefix=head, version=version, n=total)
    return {"reused": reused, "encoded": total - reused}


@dataclass(frozen=True)
class CitationIndex:
    """Stored tables of who is cited as what, each in directories by a hash of its body.

    ``norms(body, doc_id, inicio, fin)`` are the documents that a body names,
    ``articles(body, article, doc_id, chunk_id, part)`` the fragments of their
    articles, ``cards(body, doc_id, chunk_id)`` where a document that is named
    whole is opened, ``rulings(numero, anio)`` those that a number may name, and
    ``cited(body, doc_id)`` the bodies that a document's fragments cite, its own
    left out.
    """

    norms: DataFrame
    articles: DataFrame
    cards: DataFrame
    rulings: DataFrame
    cited: DataFrame
    buckets: dict[str, int]

    def of(self, name: str, asked: DataFrame) -> DataFrame:
        """The rows of a table whose body is among asked(body); only the directories of those bodies are read.

        The numbers of the directories, MOST_BUCKETS at most, pass the driver.
        """
        keyed = stored(asked.select("body").distinct().withColumn("bucket", _bucket(F.col("body"), self.buckets[name])), "asked-bodies")
        held = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        few = sum(r["n"] for r in held) <= MOST_TERMS
        rows = getattr(self, name).filter(F.col("bucket").isin([r["bucket"] for r in held]))
        return rows.join(F.broadcast(keyed) if few else keyed, ["bucket", "body"], "left_semi").drop("bucket")


def _bucket(body: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(body), F.lit(n)).cast("int")


def body_text(b: Column) -> Column:
    """A body (tipo, numero, anio) in one word, parts that are missing left out."""
    return F.concat_ws("/", b["tipo"], b["numero"], b["anio"])


def _store_bucketed(rows: DataFrame, path: str) -> int:
    """Rows in directories by the bucket of their body, sorted within each file; tells the number of buckets."""
    n = min(MOST_BUCKETS, 1 + rows.count() // BUCKET_ROWS)
    dealt = rows.withColumn("bucket", _bucket(F.col("body"), n))
    # A hot body is dealt over files by its document too, so no task writes a third of a table.
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    dealt.repartition("bucket", spread).sortWithinPartitions("bucket", *rows.columns).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return n


def citation_tables(fragments: DataFrame) -> dict[str, DataFrame]:
    """The tables of a ``CitationIndex`` from fragments(doc_id, chunk_id, norma, texto[, articulo, seccion, numero]).

    A document's norm is read once, that of its first fragment; its card is its
    first fragment of the section ``ficha``, or its first one.
    """
    has = set(fragments.columns)
    article = F.lower("articulo") if "articulo" in has else F.lit(None).cast("string")
    card = F.min(F.when(F.col("seccion") == "ficha", F.col("chunk_id"))) if "seccion" in has else F.lit(None).cast("long")
    rows = fragments.select("*", article.alias("article"))
    about = rows.groupBy("doc_id").agg(F.min_by("norma", "chunk_id").alias("norma"), F.coalesce(card, F.min("chunk_id")).alias("card"))
    own = about.withColumn("b", F.explode(C.bodies(C.citations(F.col("norma"))))).select("doc_id", "card", "b.*", body_text(F.col("b")).alias("body"))
    norms = own.select("body", "doc_id").join(document_ranges(fragments), "doc_id").select("body", "doc_id", "inicio", "fin")
    part = F.row_number().over(Window.partitionBy("body", "doc_id", "article").orderBy("chunk_id"))
    articles = rows.filter("article IS NOT NULL").select("doc_id", "chunk_id", "article").join(own.select("body", "doc_id"), "doc_id").select(
        "body", "article", "doc_id", "chunk_id", part.alias("part"))
    named = rows.select("doc_id", F.explode(C.bodies(C.citations(F.col("texto")))).alias("b")).select("doc_id", body_text(F.col("b")).alias("body")).distinct()
    return {
        "norms": norms, "articles": articles, "cards": own.select("body", "doc_id", F.col("card").alias("chunk_id")),
        "rulings": own.filter("tipo = 'jurisprudencia'").select("numero", "anio").distinct(),
        "cited": named.join(own.select("doc_id", "body"), ["doc_id", "body"], "left_anti").select("body", "doc_id"),
    }


def build_citations(spark: SparkSession, path: str) -> None:
    """The citation part of the index: no later question reads citations from fragments."""
    about = {}
    for name, rows in citation_tables(spark.read.parquet(f"{path}/fragments")).items():
        place = f"{path}/citations/{name}"
        about[f"schema {name}"] = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        if name == "rulings":
            rows.coalesce(1).write.mode("overwrite").parquet(place)
        else:
            about[f"buckets {name}"] = _store_bucketed(stored(rows, f"citations-{name}"), place)
    _note(spark, path, "citations", fingerprint=notes(spark, path, "fragments")["fingerprint"], patterns=CITATIONS_VERSION, **about)


def load_citations(spark: SparkSession, path: str) -> CitationIndex:
    """The stored citation part; one of other fragments, or read with other patterns, is an error."""
    found = _checked(spark, path, "citations")
    if found["patterns"] != str(CITATIONS_VERSION):
        raise ValueError(f"the citation part was read with patterns of version {found['patterns']}, not {CITATIONS_VERSION}: rebuild the index")
    counts = {n: int(found[f"buckets {n}"]) for n in ("norms", "articles", "cards", "cited")}
    tables = {n: spark.read.schema(found[f"schema {n}"] + ", bucket int").parquet(f"{path}/citations/{n}") for n in counts}
    rulings = spark.read.schema(found["schema rulings"]).parquet(f"{path}/citations/rulings")
    return CitationIndex(**tables, rulings=rulings, buckets=counts)


def stale_parts(spark: SparkSession, path: str) -> list[str]:
    """Parts that were made from other fragments than those stored now."""
    own, out = notes(spark, path, "fragments")["fingerprint"], []
    for part in PARTS:
        try:
            if notes(spark, path, part)["fingerprint"] != own:
                out.append(part)
        except FileNotFoundError:
            continue
    return out


def _checked(spark: SparkSession, path: str, part: str) -> dict[str, str]:
    found, own = notes(spark, path, part), notes(spark, path, "fragments")
    if found["fingerprint"] != own["fingerprint"]:
        raise ValueError(f"the {part} part does not belong to the fragments at {path}: rebuild the index")
    return found


def load_lexical(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> LexicalIndex:
    """The stored postings, of a vocabulary only if one is given; another version of tokens is an error."""
    found = _checked(spark, path, "lexical")
    if found["tokens"] != str(TOKENS_VERSION):
        raise ValueError(f"the lexical part has tokens of version {found['tokens']}, not {TOKENS_VERSION}: rebuild the index")
    postings = spark.read.parquet(f"{path}/postings")
    postings = postings if vocabulary is None else postings.join(vocabulary, "term", "left_semi")
    return LexicalIndex(spark.read.parquet(f"{path}/blocks"), postings, spark.read.parquet(f"{path}/stats"))


def load_dense(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors(doc_id, v), by chunk; a number of rows other than the fragments' is an error."""
    found, own = _checked(spark, path, "dense"), notes(spark, path, "fragments")
    if found["n"] != own["n"]:
        raise ValueError(f"{found['n']} vectors for {own['n']} fragments at {path}")
    return spark.read.parquet(f"{path}/vectors/{found['version']}").select(F.col("id").alias("doc_id"), "v")


def load_fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/fragments")
