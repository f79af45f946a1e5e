"""Secret scans: fixed patterns, and character Markov models for what has none.

Two first-order character models are trained, one on random strings and one on
ordinary identifiers and words. A candidate token is scored by the log-likelihood
ratio of its transitions under the two, in all and on average: a short token
needs unlikely letters, a long one may be milder. Above both thresholds it is a
secret of kind ``markov``. Pattern spans always stay; a model span never overlaps
one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import carried, table

#: The patterns of the contract; letters of the first in either case (ASCII).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

#: A token for the models: a whole run of so many of these characters or more; in fewer there is too little to tell.
CANDIDATE_CHARS = 8
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_CHARS, re.ASCII)
#: Log-likelihood ratio, in nats, from which a token counts as random: the mean of its transitions, and their sum.
THRESHOLD, TOTAL = 0.75, 14.0
#: Labelled samples of each class the models are trained on, and the seed of their generator.
SAMPLES, SEED = 4000, 20
#: Labelled keys whose rows' words train the ordinary class, at most (those with the smallest hashes), as many rows, and characters of these.
LABELLED_ROWS, LABELLED_CHARS = 500, 4_000_000

#: Parts of ordinary identifiers.
STEMS = tuple(
    "account action active address admin agent album alert alias amount archive array article asset async author backup "
    "balance batch billing block body bool bottom branch browser buffer build button cache callback cancel canvas "
    "capacity category channel char check child class clean client clock close cluster code collect color column "
    "command comment commit common compare config connect console content context control convert copy count country "
    "create current cursor custom data database date debug decode default delete depth device dialog digit direct "
    "display document domain download draft driver edge edit element email empty enable encode engine entity entry "
    "error event exec export factory feature field file filter final find first flag flow folder font footer force "
    "format frame from function global graph grid group handler hash header height helper hidden host image import "
    "index info init input insert instance integer item iterator job join json kernel label language last layer layout "
    "length level library limit line link list listener load local location lock log main manager map mask master match "
    "matrix max member memory menu merge message meta method min mode model module month mouse name native network "
    "next node notify number object offset option order output owner package page panel param parent parse password "
    "path pattern payment phone pixel player plugin point policy pool popup port position post prefix price print "
    "process product profile progress project property proxy public query queue random range rate read record "
    "reference region register release remote remove render report request reset resource response result retry return "
    "root route row rule sample save scale schema scope score screen script search section select sequence server "
    "service session setting shape shared sheet size sort source space start state status step storage store stream "
    "string style submit suffix summary sync system table target task template test text theme thread time title token "
    "tool top total trace track transfer tree trigger type unit update upload user utils value vector version video "
    "view visible volume width window worker write year zone".split()
)


def labelled_samples(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """``n`` random strings (label 1) and ``n`` ordinary identifiers (label 0), the same for a seed."""
    rng = random.Random(seed)
    alphabets = (
        "0123456789abcdef",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        "abcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
        "abcdefghijklmnopqrstuvwxyz",
    )
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(8, 48))), 1) for _ in range(n)]
    for _ in range(n):
        parts = rng.choices(STEMS, k=rng.randint(2, 5))
        style = rng.randrange(5)
        if style == 0:
            name = "_".join(parts)
        elif style == 1:
            name = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            name = "-".join(parts)
        elif style == 3:
            name = "_".join(parts).upper()
        else:
            name = "/".join(parts)
        number = rng.choice(["", "", str(rng.randrange(10)), str(rng.randrange(1900, 2100)), f"_v{rng.randrange(10)}",
                             f"-{rng.randrange(2000, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", str(rng.randrange(10**8))])
        out.append((name + number, 0))
    return out


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.5) -> np.ndarray:
    """The 128 x 128 table of log P(next | char; random) - log P(next | char; ordinary)."""
    counts = np.full((2, 128, 128), smoothing)
    for text, label in samples:
        codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def ratios(token: str, model: np.ndarray) -> tuple[float, float]:
    """Mean and sum of the log-likelihood ratios of the token's transitions."""
    codes = np.frombuffer(token.encode("ascii"), dtype=np.uint8)
    found = model[codes[:-1], codes[1:]]
    return float(found.mean()), float(found.sum())


def is_random(token: str, model: np.ndarray, threshold: float = THRESHOLD, total: float = TOTAL) -> bool:
    mean, whole = ratios(token, model)
    return mean >= threshold and whole >= total


def words_of_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> list[tuple[str, int]]:
    """Ordinary samples (label 0): distinct letter-only candidates in texts that ``labels`` call good, a bounded number of rows."""
    order = F.xxhash64(F.col(key).cast("string"), F.lit("secrets"))
    keys = labels.filter(F.col(quality) == 1).select(key).distinct().orderBy(order, key).limit(LABELLED_ROWS)
    rows = docs.join(F.broadcast(keys), key, "left_semi").filter(F.col(text).isNotNull()).select(text).orderBy(order, text).limit(LABELLED_ROWS)
    found, left = set(), LABELLED_CHARS
    for r in rows.collect():
        found.update(t for t in CANDIDATE.findall(r[text][:left]) if t.isalpha())
        left -= min(left, len(r[text]))
    return [(t, 0) for t in sorted(found)]


def find_secrets(
    text: str, model: np.ndarray, threshold: float = THRESHOLD, total: float = TOTAL, known: dict[str, bool] | None = None
) -> list[tuple[int, int, int]]:
    """All spans as (start, kind's place in KINDS, end), in code points, sorted. ``known`` remembers verdicts on tokens."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        random_ = known.get(token) if known is not None else None
        if random_ is None:
            random_ = is_random(token, model, threshold, total)
            if known is not None and len(token) <= 64:
                known[token] = random_
        if random_ and not any(a < m.end() and m.start() < b for a, _, b in base):
            more.append((m.start(), 3, m.end()))
    return sorted(base + more)


#: Tokens whose verdicts a task remembers from batch to batch.
REMEMBERED = 200_000


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, total: float = TOTAL,
    samples: Iterable[tuple[str, int]] | None = None,
) -> DataFrame:
    """One row per document: ``key`` and ``spans``, an array of (kind, start, end).

    Offsets are code points of the whole text, ends exclusive; spans are sorted
    by start, then kind as in KINDS. A null text counts as empty and has no
    spans. Rows are handled one by one, so repeated and null keys give a row
    each; an empty table gives an empty result; other columns do not matter.
    The models are trained from ``samples`` (label 1 random, 0 ordinary); tokens
    of fewer characters than CANDIDATE_CHARS are not scored.
    """
    model = train(labelled_samples() if samples is None else samples)
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(t or "", model, threshold, total, known)]
                for t in batch["_text"]
            ]
            yield pd.DataFrame({key: batch[key], "spans": found})

    found = docs.select(carried(key), F.col(text).alias("_text")).mapInPandas(
        scan, f"`{key}` string, spans array<struct<kind:string,start:long,end:long>>"
    )
    return found.withColumn(key, F.col(key).cast(kind))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, samples=[*labelled_samples(), *words_of_rows(docs, table(spark, sf_dir, "labels"))])

    def written(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        of("markov").alias("n_markov"),
    )


def reference_digest(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of one text the plain way, for tests."""
    text, spans = text or "", []
    for place, pattern in enumerate((ASSIGN, ACCESS, re.compile("[0-9a-f]+"))):
        for m in pattern.finditer(text):
            n = len(m[2]) if place == 0 else len(m[0])
            if n >= (8, 16, 32)[place]:
                spans.append((m.start(), place, m.end()))
    spans.sort()
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())
