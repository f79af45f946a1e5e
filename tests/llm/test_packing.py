import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ragspark.llm import packing

PATH = packing.default_tokenizer()
TEXTS = [
    None, "", " ", "Hello it's ñandú, don't we'll", "İstanbul Σας a²b ½ ª", "<|endoftext|> plain <|startoftext|>", "á é", "tab\tnl\r\nñ\x0bx y\x1fz",
    "12a__b 3.14%%% 中文 \U0001f600", "ŉ Ǆ ß ſ", "'s 'S 'RE'd", "x" * 5000, "word " * 6000,
]


@pytest.fixture(scope="module")
def direct():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def test_ids_are_the_tokenizers_own(direct, monkeypatch):
    rng = random.Random(3)
    alphabet = "aábcçdeéëfgñoöuüsß'’.,-_!0123 \t\n\r<|>ΣσÅİıǅ ́"
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    words = packing.Words(PATH)
    for text in [*TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000))]:
        assert np.frombuffer(words.encode(text or ""), dtype=words.wide).tolist() == direct(text)


def check(pieces, rows, direct):
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append(direct(t))
    sequences, ids = {}, {}
    for r in pieces:
        assert 0 < r["length"] == len(r["ids"]) // 4
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], dtype="<u4").tolist(), r["doc_tokens"]))
    for key, docs in left.items():
        assert sum(len(d) for d in docs) == sum(len(p) for _, p, _ in ids[key])
        for start, piece, total in ids[key]:
            assert any(len(d) == total and d[start : start + len(piece)] == piece for d in docs)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
        padding += 0 if at & (at - 1) == 0 else packing.SEQUENCE - at
    return padding


def test_pieces_round_trip_without_padding(spark, docs, direct, clashes):
    rows = list(enumerate(TEXTS)) + [(100 + i, "same text") for i in range(200)] + [(7, "twice")] * 2 + [(None, "no key"), (2**60 + 1, "large key")]
    pieces = packing.pack(docs(rows, extra=clashes), PATH).collect()
    assert check(pieces, rows, direct) == 0


def test_empty_table(docs):
    assert packing.pack(docs([]), PATH).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    cells = {packing.hilbert_index([x, y, z], 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1], strict=True)) == 1 for i in range(511))


def test_like_documents_lie_near(direct):
    rng = random.Random(1)
    topics = [[f"{a}{b}" for b in ("one", "two", "three", "four", "five")] for a in ("red", "green", "blue", "grey", "black", "white")]
    keys = sorted((packing.curve_key(np.array(direct(" ".join(rng.choices(t, k=80))))), i) for i, t in enumerate(topics) for _ in range(20))
    same = sum(a[1] == b[1] for a, b in zip(keys, keys[1:], strict=False))
    assert same > 60


def test_tail_is_cut_into_powers_of_two():
    rows = [("a", 0, 700, b"\0" * 2800, 700, 5, 0), ("b", 0, 605, b"\0" * 2420, 605, 5, 700)]
    out = packing._powers(rows)
    lengths = {}
    for _, _, n, ids, _, s, _ in out:
        assert len(ids) == 4 * n
        lengths[s] = lengths.get(s, 0) + n
    assert [lengths[k] for k in sorted(lengths)] == [1024, 256, 16, 8, 1]


PLAIN_CHARS = "aábçdeéËfgÑoöstmrvlßȺȾŉİǅ×÷_'''\"-.,<|>0123456789 \t\n\r\x0b\0²"


@pytest.mark.parametrize("chars", [PLAIN_CHARS, PLAIN_CHARS[:-3].replace("İ", "").replace("|", "")])
@pytest.mark.parametrize("block, cache", [(40, 20), (300, 100), (4_000_000, 400_000)])
def test_blocks_give_the_tokenizers_own_ids(direct, monkeypatch, chars, block, cache):
    rng = random.Random(4)
    monkeypatch.setattr(packing, "BLOCK_CHARS", block)
    monkeypatch.setattr(packing, "BLOCK_WORDS", 7)
    monkeypatch.setattr(packing, "CACHE_WORDS", cache)
    contractions = ["don't", "we'LL", "I'd've", "'S", "''s", ".'s", "x'", "'", "'l", "'r e", "'re", "'rest", "'ss9", "'s×"]
    texts = [t or "" for t in TEXTS] + contractions
    texts += ["".join(rng.choices([*chars, *contractions], k=rng.randint(0, 90))) for _ in range(1500)]
    words = packing.Words(PATH)
    assert [ids.tolist() for ids in words.encode_all(texts)] == [direct(t) for t in texts]


def test_every_plain_character_is_cut_as_the_tokenizer_does(direct):
    texts = [f"a{c}{c}b {c}1" for c in map(chr, range(0x250)) if packing.is_plain(c)]
    assert len(texts) > 400
    assert [ids.tolist() for ids in packing.Words(PATH).encode_all(texts)] == [direct(t) for t in texts]


def test_the_model_sees_a_word_once_and_many_at_a_time(direct, monkeypatch):
    words, seen = packing.Words(PATH), []
    by_model = words.by_model
    monkeypatch.setattr(words, "by_model", lambda some: (seen.append(some.to_pylist()), by_model(some))[1])
    texts = [f"Word{chr(97 + i % 26)}, and word{chr(97 + i % 7)} don't" for i in range(500)]
    for _ in range(2):
        assert [ids.tolist() for ids in words.encode_all(texts)] == [direct(t) for t in texts]
    assert len(seen) == 1
    assert sorted(seen[0]) == sorted([",", "and", "don", "'t", *(f"word{chr(97 + i)}" for i in range(26))])


def test_a_key_is_that_of_the_document_alone(direct):
    rng = random.Random(5)
    docs = [np.array(direct(" ".join(rng.choices(["red", "green", "blue", "naïve", "7"], k=rng.randint(0, 50))))) for _ in range(600)]
    keys = packing.curve_keys(docs)
    assert keys == [packing.curve_key(d) for d in docs]
    assert keys[::-1] == packing.curve_keys(docs[::-1])
    assert packing.curve_keys([]) == []
