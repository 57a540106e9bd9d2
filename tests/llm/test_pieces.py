"""Subword encoding against the library: ids, byte spans and decoding."""

import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as spm

from feedlens.llm.pieces import CharMap, Codec, Normalizer, encode, piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return spm.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return Codec(f.read())


def _check(lib, codec, texts):
    offsets, ids, ends = codec.encode(texts)
    decoded = codec.decode(offsets, ids)
    for k, t in enumerate(texts):
        mine = ids[offsets[k]:offsets[k + 1]].tolist()
        assert mine == lib.encode(t), repr(t[:80])
        assert decoded[k] == lib.decode(mine), repr(t[:80])
        raw = t.encode()
        got = ends[offsets[k]:offsets[k + 1]].tolist()
        assert not got or got[-1] == len(raw)
        assert got == [p.end for p in lib.encode(t, return_type="proto").pieces], repr(t[:80])


def test_corpus(lib, codec, corpus):
    _check(lib, codec, [t or "" for _, t in corpus])


def test_odd_texts(lib, codec):
    r = random.Random(3)
    alphabet = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "é", "ß", "日", "本", "😀", "▁", " ", "<s>", "</s>", "<unk>", "<0x41>", "#", "9", "́", "ﬁ", "​"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    _check(lib, codec, ["", " ", "  ", "▁", " ▁ ", "a", " a", "a ", *texts])


def test_forgetting_changes_nothing(lib, codec, monkeypatch):
    import feedlens.llm.pieces as pieces
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 3)
    _check(lib, codec, ["one two three four five", "five four three"])
    _check(lib, codec, ["six seven", "five four three"])


def _trie(rules: dict[bytes, str]) -> bytes:
    """A compiled character map with a double-array trie, laid out one block of 256 per node."""
    tree: dict = {}
    for key in rules:
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[None] = key
    texts, at = b"", {}
    for key, target in rules.items():
        at[key] = len(texts)
        texts += target.encode() + b"\0"
    units: dict[int, int] = {}
    free = [1]

    def place(node: dict, pos: int, label: int) -> None:
        base = free[0] * 256
        free[0] += 1
        units[pos] = ((pos ^ base) << 10) | (0x100 if None in node else 0) | label
        if None in node:
            units[base] = at[node[None]] | 0x80000000
        for b, child in node.items():
            if b is not None:
                place(child, base ^ b, b)

    place(tree, 0, 0)
    size = max(units) + 256
    return struct.pack("<I", size * 4) + b"".join(struct.pack("<I", units.get(k, 0)) for k in range(size)) + texts


def test_character_map_longest_prefix_and_alignment():
    rules = {"ﬁ".encode(): "fi", "é".encode(): "é", "ab".encode(): "X", "abc".encode(): "Y", "​".encode(): "", "\t".encode(): " "}
    blob = _trie(rules)
    assert {s: t for rs in CharMap(blob).by_first.values() for s, t in rs} == {k.decode(): v for k, v in rules.items()}
    norm, ends = Normalizer(blob, True, False, True)("ﬁab\tabcd​e")
    assert norm == "▁fiX▁Yde"
    assert ends.tolist() == [0, 0, 0, 3, 5, 6, 9, 13, 14]
    assert Normalizer(blob, True, True, True)("  a  b ")[0] == "▁a▁b"
    assert Normalizer(blob, False, False, False)("a b")[0] == "a b"
    assert Normalizer(b"", True, False, True)("")[0] == ""


def test_encode_frame(documents, corpus, lib):
    rows = {r.doc_id: r for r in encode(documents, PATH).collect()}
    assert len(rows) == len(corpus)
    for i, t in corpus:
        assert rows[i].ids == lib.encode(t or "") and rows[i].decoded == lib.decode(rows[i].ids)
        assert len(rows[i].ends) == len(rows[i].ids)
    d = {r.doc_id: r for r in piece_digests(documents, PATH).collect()}
    assert all(d[i].n_tokens == len(rows[i].ids) and d[i].spanned_bytes == len((t or "").encode()) for i, t in corpus)
    assert piece_digests(documents.limit(0), PATH).count() == 0


def test_decode_invalid_bytes_like_the_library(lib, codec):
    bad = np.array([lib.piece_to_id("<0xE4>"), lib.piece_to_id("<0x41>"), lib.piece_to_id("▁a")], np.int32)
    assert codec.decode(np.array([0, 3]), bad) == [lib.decode(bad.tolist())]
    some = np.array([1, 0, 300, 2], np.int32)
    assert codec.decode(np.array([0, 4]), some) == [lib.decode(some.tolist())]
