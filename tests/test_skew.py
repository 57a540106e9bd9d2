"""A product holding far more than a third of all rows: results equal a pandas brute force."""

import datetime as dt
import re
from collections import Counter

import pandas as pd
import pytest

from feedlens.functions.text import STOP_WORDS
from feedlens.operators import text as TX

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet",
         "kilo", "lima", "mike", "the", "and", "a", "it", "café", "x1y"]
LABELS = ["joy", "anger", "neutral", "sadness", "surprise", "fear", "disgust"]


@pytest.fixture(scope="module")
def skewed(spark):
    rows = []
    for i in range(3000):
        product = "hot" if i % 5 < 3 else f"p{i % 7}"              # 60 % of rows in one product
        text = " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 2 + i % 11))
        rows.append((i, product, LABELS[i % 7], text, 0.3 + (i * 37 % 70) / 100.0,
                     dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 4, i % 4 + i % 3))
    return spark.createDataFrame(rows, "id long, product string, sentiment_label string, text string, "
                                       "confidence_score double, event_ts timestamp_ntz, "
                                       "helpfulness_numerator int, helpfulness_denominator int")


def _pol(label):
    if label in ("joy", "positive", "label_2"):
        return "positive"
    if label in ("anger", "disgust", "fear", "sadness", "negative", "label_0"):
        return "negative"
    if label in ("neutral", "surprise", "label_1"):
        return "neutral"
    return None


def test_keywords_on_hot_product_match_brute_force(spark, skewed):
    pdf = skewed.toPandas()
    pdf["pol"] = pdf.sentiment_label.map(_pol)
    want = {}
    stops = set(STOP_WORDS)
    for (prod, pol), g in pdf.groupby(["product", "pol"]):
        if len(" ".join(g.text).strip()) < 50:
            continue
        c = Counter(w for t in g.text for w in re.findall(r"\b[a-z]{3,}\b", t.lower()) if w not in stops)
        want[(prod, pol)] = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5]]
    got = {}
    for r in TX.keywords(skewed, 5).orderBy("product", "polarity", "rank").collect():
        got.setdefault((r.product, r.polarity), []).append(r.word)
    assert got == want


def test_top_comments_on_hot_product_match_brute_force(spark, skewed):
    as_of = "2024-03-01 00:00:00"
    got = {(r.product, r.polarity): r for r in
           TX.top_comments(skewed, 3, as_of).where("rank = 1").collect()}
    pdf = skewed.toPandas()
    pdf["pol"] = pdf.sentiment_label.map(_pol)
    now = pd.Timestamp(as_of)
    days = (now - pdf.event_ts).dt.days
    helpful = (pdf.helpfulness_numerator / pdf.helpfulness_denominator.where(pdf.helpfulness_denominator > 0)
               ).fillna(0.0) * 0.3
    pdf["score"] = (pdf.confidence_score * 0.4 + helpful + (1.0 - days / 365.0).clip(lower=0.0) * 0.2
                    + (pdf.text.str.len() / 1000.0).clip(upper=1.0) * 0.1)
    best = pdf.sort_values(["score", "id"], ascending=[False, True]).groupby(["product", "pol"]).head(1)
    want = {(r.product, r.pol): r.id for r in best.itertuples()}
    assert {k: v.id for k, v in got.items()} == want
    assert sum(1 for k in got if k[0] == "hot") == 3
