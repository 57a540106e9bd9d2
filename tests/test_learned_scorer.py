"""The naive Bayes scorer against a walk over the words, and its edges."""

import math
import re
from collections import Counter

import pandas as pd
import pytest

from feedlens.functions.text import UNIQUE_STOP_WORDS
from feedlens.operators import learned as NB, scoring as S

ROWS = [(1, "great lamp great light", 5.0), (2, "great chair", 4.0), (3, "broken lamp, awful awful", 1.0), (4, "awful light", 2.0), (5, "plain chair", 3.0),
        (6, None, 5.0), (7, "great awful", None), (8, "", 3.0), (9, "unseen words entirely", None), (10, "chair lamp chair", 3.0)]


def _frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, rating double, sentiment_label string")


def _words(text):
    return [w for w in re.findall(r"(?<!\w)[a-z]{3,}(?!\w)", (text or "").lower()) if w not in UNIQUE_STOP_WORDS]


def _brute(rows, least=2):
    name = lambda r: "positive" if r >= 4 else "negative" if r <= 2 else "neutral"
    rated = [(t, name(r)) for _, t, r in rows if r is not None]
    counts = {c: Counter(w for t, k in rated if k == c for w in _words(t)) for c in NB.CLASSES}
    vocabulary = [w for w in set().union(*counts.values()) if sum(counts[c][w] for c in NB.CLASSES) >= least]
    totals = {c: sum(counts[c][w] for w in vocabulary) for c in NB.CLASSES}
    weights = {w: [math.log((counts[c][w] + 1) / (totals[c] + len(vocabulary))) for c in NB.CLASSES] for w in vocabulary}
    priors = [math.log((sum(k == c for _, k in rated) + 1) / (len(rated) + 3)) for c in NB.CLASSES]
    out = {}
    for i, t, _ in rows:
        m = [p + sum(weights[w][k] for w in _words(t) if w in weights) for k, p in enumerate(priors)]
        best = max(range(3), key=lambda k: m[k])
        out[i] = NB.CLASSES[best], 1 / sum(math.exp(x - m[best]) for x in m)
    return weights, out


def test_scores_by_brute_force(spark):
    df = _frame(spark)
    model = NB.fit(df)
    weights, want = _brute(ROWS)
    got = {r.word: [r[c] for c in NB.CLASSES] for r in model.weights.collect()}
    assert got.keys() == weights.keys() and all(got[w] == pytest.approx(weights[w]) for w in weights)
    scored = NB.score(df, model)
    assert set(scored.columns) == {"id", "text", "rating", "sentiment_label", "confidence_score"}
    rows = {r.id: r for r in scored.collect()}
    assert all(rows[i].sentiment_label == label and rows[i].confidence_score == pytest.approx(p) for i, (label, p) in want.items())
    told = NB.agreement(scored).first()
    assert told.n == 8 and told.agreement == pytest.approx(sum(
        want[i][0] == ("positive" if r >= 4 else "negative" if r <= 2 else "neutral") for i, _, r in ROWS if r is not None) / 8)


def test_edges(spark):
    df = _frame(spark)
    none = NB.fit(df.where("rating IS NULL"))
    assert none.weights.count() == 0 and {r.sentiment_label for r in NB.score(df, none).collect()} == {"negative"}
    assert NB.score(df.limit(0), NB.fit(df)).count() == 0 and NB.agreement(df.limit(0)).first().agreement is None
    few = NB.fit(df, most_words=2)
    assert few.weights.count() == 2


def test_an_empty_batch_keeps_all_its_columns(spark):
    df = _frame(spark).limit(0)
    assert S.score_with(df, S.PandasLexiconScorer(), keep_scores=True).collect() == []
    seen = []

    def scorer(texts):
        seen.append(len(texts))
        return pd.DataFrame([[1.0]] * len(texts), columns=["joy"])

    assert {r.sentiment_label for r in S.score_with(_frame(spark), scorer, keep_scores=True).collect()} == {"joy"}
