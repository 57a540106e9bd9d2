"""Near-duplicate documents and vectors, and components, against brute force."""

import random
import re

import numpy as np
import pytest

from feedlens.llm.components import components
from feedlens.llm.nearsets import drop_near_duplicates, near_duplicates, survival, trees_for
from feedlens.llm.vectors import vector_duplicates

from .conftest import CLASHING, sentence

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _set(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


class _Parts:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def _near(docs, width, percent):
    sets = {i: _set(t, width) for i, t in docs}
    parts = _Parts(sets)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parts.join(a, b)
    return {i: (len(sets[i]), parts.root(i)) for i in ids}


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies of many strengths around a few bases, and unrelated texts."""
    r = random.Random(11)
    out = []
    for base in range(6):
        words = sentence(r, 150).split(" ")
        for _ in range(25):
            mine = list(words)
            for _ in range(r.randint(0, 7)):
                mine[r.randrange(len(mine))] = sentence(r, 1) + str(r.random())
            out.append(" ".join(mine))
    out += [sentence(r, r.randint(1, 60)) for _ in range(50)]
    return list(enumerate(out))


@pytest.mark.parametrize("limits", [{}, {"node_sets": 8, "levels": 1}, {"node_sets": 8, "levels": 2}, {"node_bytes": 4096}])
def test_near_groups(spark, copies, limits):
    want = _near(copies, 4, 80)
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in near_duplicates(df, 4, 80, **limits).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_corpus(documents, corpus):
    want = _near(corpus, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents).collect()}
    assert got == want
    kept = drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_near_edges(spark):
    df = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (2, "A b C"), (None, "a b c"), (5, None), (6, " ")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 4).collect()), key=repr)
    assert got == sorted([(4, 1, 2, False), (4, 1, 2, False), (2, 1, 2, True), (None, 1, None, True), (5, 0, 5, True), (6, 0, 6, True)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_trees_reach_the_recall():
    assert 1 - (1 - survival(0.8)) ** trees_for(0.999, 0.8) >= 0.999


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(100, 180)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (900, 901), (901, 900)]
    parts = _Parts({x for pair in links for x in pair})
    for a, b in links:
        parts.join(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {row.id: row.component_id for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: parts.root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(seed=4, n=300, dims=32):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    near = base[:60] + 0.22 * r.normal(size=(60, dims))
    group = base[0] + 0.12 * r.normal(size=(80, dims))
    same = np.repeat(base[5:6], 30, 0)
    return np.concatenate([base, near, group, same, 3 * base[10:15]]).astype(np.float32)


@pytest.mark.parametrize("list_rows", [2048, 16])
def test_vectors_recall_and_precision(spark, list_rows):
    x = _vectors()
    rows = [(i, [float(c) for c in v], *[i] * len(CLASHING)) for i, v in enumerate(x)]
    names = ", ".join(f"`{c}` long" for c in CLASHING)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, {names}").repartition(3)
    got = {r.vec_id: r for r in vector_duplicates(df, list_rows=list_rows).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    degree = links.sum(1)
    n = np.array([got[i].n_links for i in range(len(u))])
    assert (n <= degree).all() and n.sum() >= 0.97 * degree.sum()
    parts = _Parts(range(len(u)))
    for a, b in zip(*np.nonzero(links)):
        parts.join(int(a), int(b))
    same = sum(got[i].component_id == parts.root(i) for i in range(len(u)))
    assert same >= 0.98 * len(u)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("n,dims", [(1500, 32), (6000, 32), (6000, 4)])
def test_vectors_recall_of_a_dense_group(spark, n, dims):
    """A third of the rows lie around one centre; what is found of their links must not fall with their number."""
    r = np.random.default_rng(9)
    x = r.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:n // 3] = x[0] + np.sqrt(r.uniform(0.02, 0.05, size=(n // 3, 1))) * x[:n // 3][r.permutation(n // 3)]
    links = (x @ x.T >= 0.95 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in vector_duplicates(df).collect()}
    assert links.sum() > n * n / 30 and all(got[i] <= w for i, w in enumerate(links))
    assert sum(got.values()) >= 0.97 * links.sum()


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
            (8, [1.0, 0.0, 0.0]), (9, []), (None, [0.0, 1.0]), (10, [1e200, 1e190]), (11, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9),
                          (None, 0, None), (10, 4, 1), (11, 4, 1)], key=repr)
    assert vector_duplicates(df.limit(0)).count() == 0


def test_texts_that_share_an_id_stay_apart(spark):
    r = random.Random(3)
    a = sentence(r, 100)
    near = a + " tail"
    other = sentence(r, 80)
    rows = [(1, a, 1), (5, near, 2), (5, other, 3), (5, other, 4), (None, other, 5), (None, a, 6), (6, other + " end", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert sorted(x.n for x in drop_near_duplicates(df).collect()) == [1, 3, 4, 5, 6]


def test_words_that_cancel_are_not_similar(spark):
    """Texts without a common word whose letters cancel in a polynomial hash."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, f"{t} {t} {t}"), (2, " ".join([t.translate(str.maketrans("ab", "ba"))] * 3))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 2)]
