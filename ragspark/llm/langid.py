"""Language identification by mixture inference.

Each language has a model of character trigrams, hashed into a fixed number of
buckets. A document is taken as a mixture of languages: expectation-maximisation
finds the proportions that make its trigrams likeliest, and a penalty on every
further language picks the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import fresh, release_memory, table

#: Trigram buckets of a model.
BUCKETS = 1 << 15
#: About so many labelled documents of each language train its model, the ones with the smallest hashes.
DOCS_PER_LANGUAGE = 2000
#: Price in log-likelihood of each further language, times log(1 + trigrams).
PENALTY = 3.0
#: EM ends after so many rounds, or when no proportion moves by more than TOLERANCE.
ROUNDS, TOLERANCE = 25, 1e-3
#: The same for the fits that are compared.
FIT_ROUNDS, FIT_TOLERANCE = 400, 1e-5
#: Labels that a model has at most (the table of a model is BUCKETS of them); more are an error.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: Characters handled at once.
BATCH_CHARS = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to itself for a letter, to a space for anything else."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram buckets of a text and their counts. Texts without letters have none."""
    codes = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mixed = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
    mixed ^= mixed >> np.uint32(15)
    hashed = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17))[(b != 32) | ((a != 32) & (c != 32))]
    if len(hashed) < 1000:
        found, counts = np.unique(hashed, return_counts=True)
        return found.astype(np.int64), counts.astype(float)
    counts = np.bincount(hashed, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def train(samples: DataFrame, label: str, text: str) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the table of trigram probabilities, buckets by languages.

    The counts are summed on the executors; the driver gets at most
    buckets times languages numbers. Null labels and texts do not train.
    """
    rows = samples.select(F.col(label).alias("_label"), F.col(text).alias("_text")).dropna()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, one in zip(batch["_label"], batch["_text"], strict=True):
                found, counts = grams(one)
                total.setdefault(name, np.zeros(BUCKETS))[found] += counts
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"_label": name, "_bucket": at, "_n": counts[at].astype(np.int64)})

    summed = (
        rows.mapInPandas(count, "_label string, _bucket long, _n long").groupBy("_label", "_bucket").agg(F.sum("_n").alias("_n")).toPandas()
    )
    names = sorted(summed["_label"].unique())
    counts = np.full((BUCKETS, len(names)), 0.1)
    for k, name in enumerate(names):
        own = summed[summed["_label"] == name]
        counts[own["_bucket"].to_numpy(), k] += own["_n"].to_numpy()
    return names, counts / counts.sum(axis=0)


def _mixture(
    x: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of many documents at once, and what no mixture of the allowed languages exceeds.

    x: probabilities, grams by languages; starts: each document's first gram;
    allowed: documents by languages. The log-likelihood is concave in the
    proportions: from any point it rises to no more than its tangent does at the
    best corner, wherever EM stopped.
    """
    sizes = np.diff(np.append(starts, len(counts)))
    total = np.add.reduceat(counts, starts)
    parts = allowed / allowed.sum(axis=1, keepdims=True)
    active = np.arange(len(starts))
    for _ in range(rounds):
        if not len(active):
            break
        if len(active) < len(starts):
            rows = np.repeat(active, sizes[active])
            begin = np.concatenate([[0], np.cumsum(sizes[active])[:-1]])
            at = np.arange(len(rows)) - np.repeat(begin, sizes[active]) + np.repeat(starts[active], sizes[active])
            xs, cs = x[at], counts[at]
        else:
            rows, begin, xs, cs = np.repeat(active, sizes), starts, x, counts
        weighted = xs * parts[rows]
        weighted *= (cs / weighted.sum(axis=1))[:, None]
        new = np.add.reduceat(weighted, begin, axis=0) / total[active, None]
        moved = np.abs(new - parts[active]).max(axis=1)
        parts[active] = new
        active = active[moved > tolerance]
    doc = np.repeat(np.arange(len(starts)), sizes)
    mixed = (x * parts[doc]).sum(axis=1)
    likely = np.add.reduceat(counts * np.log(mixed), starts)
    slope = np.add.reduceat(x * (counts / mixed)[:, None], starts, axis=0)
    return parts, likely, likely + np.where(allowed > 0, slope, 0).max(axis=1) - total


def proportions(texts: list[str], model: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Texts by languages: the proportions of the chosen set, zero elsewhere; a zero row where a text has no letter.

    Of all sets of languages the one with the largest log-likelihood less the
    price of its further languages is chosen (ties: the smaller, then the first
    in lexicographic order). All sets of k languages are fitted for growing k,
    for the texts that some set of k or more could still decide: no set is
    likelier than the bound on all languages together.
    """
    n_langs = model.shape[1]
    out = np.zeros((len(texts), n_langs))
    per = [grams(t) for t in texts]
    some = [i for i, (g, _) in enumerate(per) if len(g)]
    if not some:
        return out
    at, counts = np.concatenate([per[i][0] for i in some]), np.concatenate([per[i][1] for i in some])
    sizes = np.array([len(per[i][0]) for i in some])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = model[at]
    price = penalty * np.log1p(np.add.reduceat(counts, starts))
    single = np.add.reduceat(counts[:, None] * np.log(x), starts, axis=0)
    chosen, top = np.eye(n_langs)[single.argmax(axis=1)], single.max(axis=1)
    if n_langs > 1:
        bound = _mixture(x, counts, starts, np.ones((len(some), n_langs)))[2]
        for k in range(2, n_langs + 1):
            left = np.flatnonzero(bound - (k - 1) * price > top)
            if not len(left):
                break
            rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in left])
            begin = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
            xs, cs = x[rows], counts[rows]
            for held in combinations(range(n_langs), k):
                parts, likely, _ = _mixture(xs[:, held], cs, begin, np.ones((len(left), k)), FIT_ROUNDS, FIT_TOLERANCE)
                worth = likely - (k - 1) * price[left]
                better = worth > top[left]
                if better.any():
                    new = np.zeros((better.sum(), n_langs))
                    new[:, held] = parts[better]
                    chosen[left[better]], top[left[better]] = new, worth[better]
    out[some] = chosen
    return out


def identify(
    docs: DataFrame, names: list[str], model: np.ndarray, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``key`` and the columns ``keep``, ``lang_pred``, ``score`` and ``mixture`` (language to proportion) of each row.

    ``lang_pred`` has the largest proportion (ties: the first by name), ``score``
    is that proportion. A text that is null or has no letter gets ``und``, 0 and
    an empty mixture. Texts are read whole and rows handled one by one: repeated
    or null keys give a row each. A kept column with the name of an added one gives way.
    A kept text travels once, and a batch's texts become Python strings a part at a time.
    """
    added = {"lang_pred": pa.string(), "score": pa.float64(), "mixture": pa.map_(pa.string(), pa.float64())}
    kept = [c for c in dict.fromkeys([key, *(keep or [])]) if c not in added]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    at = kept.index(text) if text in kept else len(kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes, dtype=np.int64) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                texts = [t or "" for t in batch.column(at).slice(a, b - a).to_pylist()]
                parts = proportions(texts, model) if names else np.zeros((b - a, 1))
                best, known = parts.argmax(axis=1).tolist(), (parts.sum(axis=1) > 0).tolist()
                found = (
                    [names[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)],
                    np.minimum(parts.max(axis=1), 1.0),
                    [[(n, float(p)) for n, p in zip(names, row, strict=False) if p > 0] for row in parts],
                )
                own = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found, added.values())], names=[*kept, *added])
        release_memory()

    texts = [] if text in kept else [F.col(text).alias(fresh("_text", kept))]
    return docs.select(*kept, *texts).mapInArrow(
        predict, f"{fields}, lang_pred string, score double, mixture map<string,double>"
    )


def held_out(key: Column) -> Column:
    """Rows whose crc32(key as text) mod 4 is 2 never train."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, key: str = "doc_id", label: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """The labelled rows that may train, thinned to about ``per_language`` of each language by a hash of the key.

    The numbers of rows by label are broadcast; over MOST_LANGUAGES labels are an error.
    """
    able = docs.select(key, label, "text").filter(F.col(label).isNotNull() & F.col("text").isNotNull() & ~held_out(F.col(key)))
    sizes = able.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} labels in {label}")
    sizes = docs.sparkSession.createDataFrame(found, sizes.schema)
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return able.join(F.broadcast(sizes), label).filter(share * F.col("_n") < per_language).drop("_n")


def fit(docs: DataFrame, key: str = "doc_id", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Model of the documents' own labels, without the held-out quarter."""
    return train(training_rows(docs, key, label), label, "text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``documents``; the model comes from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    names, model = fit(docs)
    return identify(docs, names, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
