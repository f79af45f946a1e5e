"""Words of texts as 64-bit hashes, many texts at once, in NumPy.

A word is a run of anything but ASCII white space, as its UTF-8 bytes, and is
hashed 8 bytes at a time. Hashes of windows are polynomials in a fixed odd base
modulo 2^64, taken from prefix sums and then mixed. So no Python object is made
for a word, unless it is very long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Of a word's 8 bytes, those that the first so many make up.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and its inverse^0.. modulo 2^64, at least n of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words begin and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, from its length and its parts of 8 bytes; A-Z count as a-z if ``lower``."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eights[starts] & _FIRST[np.minimum(sizes, 8)]))
    left, at = np.flatnonzero(sizes > 8), 8
    while len(left) and at < LONG:
        rest = sizes[left] - at
        h[left] = mix(h[left] ^ (eights[starts[left] + at] & _FIRST[np.minimum(rest, 8)]))
        at += 8
        left = left[rest > 8]
    for i in left:
        h[i] = xxhash.xxh64_intdigest(padded[starts[i] : ends[i]].tobytes(), 0)
    return h


def window_hashes(words: np.ndarray, size: int, base: int = 1) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, by its first word; fewer words give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(_BASES[base], len(words) + 1)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * down[:n])


def hashed_text(text: bytes, lower: bool = False, step: int = 1 << 21) -> np.ndarray:
    """Hashes of all words of one text, in segments so that memory stays bounded."""
    if len(text) <= step:
        data = np.frombuffer(text, dtype=np.uint8)
        return word_hashes(data, *word_spans(data), lower=lower)
    out, at, data = [], 0, np.frombuffer(text, dtype=np.uint8)
    while at < len(data):
        end = at + step
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = data[at:end]
        out.append(word_hashes(part, *word_spans(part), lower=lower))
        at = end
    return np.concatenate(out)


def in_chunks(batches: Iterator[pd.DataFrame], size: str, limit: int) -> Iterator[pd.DataFrame]:
    """The rows anew, in frames whose ``size`` column sums to about ``limit``; one row may be larger."""
    held, total = [], 0
    for batch in batches:
        begin, sizes = 0, batch[size].to_numpy()
        for i, s in enumerate(sizes):
            if total and total + s > limit:
                held.append(batch.iloc[begin:i])
                yield pd.concat(held, ignore_index=True)
                held, total, begin = [], 0, i
            total += int(s)
        held.append(batch.iloc[begin:])
    if total or any(len(h) for h in held):
        yield pd.concat(held, ignore_index=True)
