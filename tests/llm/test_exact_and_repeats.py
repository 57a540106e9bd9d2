"""Exact dedup and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from feedlens.llm.exact import drop_exact_duplicates, exact_duplicates, merge_runs, digests
from feedlens.llm import repeats, words
from feedlens.llm.repeats import drop_repeated_windows, level_lengths, pack, unpack

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _exact(corpus):
    groups = {}
    for i, t in corpus:
        groups.setdefault(SPACES.sub(" ", t or ""), []).append(i)
    return {i: (min(g), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}


def test_exact(documents, corpus):
    want = _exact(corpus)
    got = {r.doc_id: r for r in exact_duplicates(documents).collect()}
    assert set(got) == set(want)
    for i, (keep, n, sha) in want.items():
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, n, keep == i, sha)


def test_exact_filter_keeps_columns(documents, corpus):
    kept = drop_exact_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({v[0] for v in _exact(corpus).values()})


def test_exact_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()), key=repr)
    assert rows == sorted([(1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (None, None, 2, True), (None, None, 2, True)], key=repr)
    assert exact_duplicates(df.limit(0)).count() == 0


def test_exact_filter_by_id_and_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "c"), (None, "a"), (None, " b"), (None, "\tb"), (3, None), (4, ""), (4, "d")],
                               "doc_id long, text string")
    want = sorted([(1, "a"), (1, "a"), (2, "c"), (None, " b"), (None, "\tb"), (3, None), (4, "d")], key=repr)
    for kept in (drop_exact_duplicates(df), corpus_pipeline.exact(spark, df, "")):
        assert sorted(map(tuple, kept.collect()), key=repr) == want


@pytest.mark.parametrize("runs,steps", [(1, 1), (2, 1), (16, 1), (16, 3), (64, 6)])
def test_merge_tree_shapes(documents, corpus, runs, steps):
    want = {(v[0], v[1]) for v in _exact(corpus).values()}
    assert {(r.keep_id, r.group_size) for r in merge_runs(digests(documents), runs, steps).collect()} == want


def test_exact_is_native(documents):
    plan = exact_duplicates(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def _cut(docs, window):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = _words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, t in docs:
        w = _words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), gone)
    return out


@pytest.mark.parametrize("window", [13, 5, 30])
def test_repeats(documents, corpus, window):
    want = _cut(corpus, window)
    got = {r.doc_id: r for r in drop_repeated_windows(documents, window).collect()}
    assert set(got) == set(want)
    for i, (n, removed, text, gone) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, removed, text)
        spans = {k for a, m in zip(got[i].removed_start, got[i].removed_words) for k in range(a, a + m)}
        assert spans == gone


def test_repeats_edges(spark):
    w = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(3, w), (3, w), (None, w), (7, None), (8, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in drop_repeated_windows(df).collect())
    assert got == [(False, 3, 0), (False, 3, 0), (False, 7, 0), (False, 8, 0), (True, 0, 20)]
    assert drop_repeated_windows(df.limit(0)).count() == 0


def test_level_lengths():
    for w in range(1, 60):
        lengths = level_lengths(w)
        assert lengths[-1] == w and all(a <= b <= 2 * a for a, b in zip(lengths[:-1], lengths[1:]))


def test_pack_round_trip():
    r = np.random.default_rng(1)
    for values in ([], [0], [65534], [65535], [65536, 131070], np.unique(r.integers(0, 1 << 28, 5000))):
        values = np.asarray(values, np.int64)
        assert (unpack(pack(values)) == values).all()


def _cancelling(n):
    """The Thue-Morse word of n letters and its complement: equal under any polynomial hash modulo 2**64."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_are_no_repeats(spark):
    a, b = _cancelling(1024)
    rows = [(1, " ".join(f"{a} {i}" for i in range(13))), (2, " ".join(f"{b} {i}" for i in range(13))), (3, " ".join(f"{a} {i}" for i in range(13)))]
    got = {r.doc_id: r.n_removed for r in repeats.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), window=13).collect()}
    assert got == {1: 0, 2: 0, 3: 26}


def test_word_hashes():
    a, b = _cancelling(1024)
    long = "x" * 70_000
    texts = [a, b, long, long[:-1] + "y", "y" + long[1:], "ab", "ba", "a", "a\0", "x" * 8, "x" * 9, "x" * 16, "x" * 17]
    one = words.Words(pa.array(texts))
    for seed in (words.SEED, words.CHECK_SEED):
        assert len(set(one.hashes(seed).tolist())) == len(texts)
    for t, h, c in zip(texts, one.hash, one.hashes(words.CHECK_SEED)):
        beside = words.Words(pa.array(["some words", f"\n{t}\t", None, f"before {t} after"]))
        assert beside.hash[2] == beside.hash[4] == h and beside.hashes(words.CHECK_SEED)[4] == c
    assert (words.Words(pa.array(["ABC Long" + "Z" * 30]), lower=True).hash == words.Words(pa.array(["abc long" + "z" * 30])).hash).all()


def test_windows_are_told_apart_by_the_second_hash():
    known, checks = np.array([5, 7, 7, 7, 9], np.uint64), np.array([1, 2, 4, 6, 0], np.uint64)
    hit, at = repeats._find(np.array([7, 7, 7, 5, 8, 9, 9], np.uint64), np.array([6, 3, 2, 1, 0, 0, 1], np.uint64), known, checks)
    assert hit.tolist() == [True, False, True, True, False, True, False] and at[hit].tolist() == [3, 1, 0, 4]
