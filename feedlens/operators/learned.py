"""C5, learned: a multinomial naive Bayes scorer with star ratings (P4) as labels.

The model is fitted by one aggregate over words with one count per class, so a frequent word is combined map-side.
Scoring joins the words of the texts with the weights, which are a bounded table, and adds them up per row
map-side: what is shuffled is three sums per row and task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import polarity
from ..functions.text import UNIQUE_STOP_WORDS, candidate_keywords
from .scoring import rating_labels

CLASSES = ("negative", "neutral", "positive")
#: Pseudo-count of a word in a class, rows a word must occur in at least, and words of a model at most (the most frequent).
ALPHA, LEAST_COUNT, MOST_WORDS = 1.0, 2, 200_000


@dataclass
class NaiveBayes:
    """``weights`` (word, count, negative, neutral, positive): log probabilities of a word by class;
    ``priors``: log probabilities of the classes."""

    weights: DataFrame
    priors: dict[str, float]


def _words(df: DataFrame, *columns: Column) -> DataFrame:
    words = df.select(*columns, F.explode(candidate_keywords(F.coalesce(F.col("text"), F.lit("")))).alias("word"))
    return words.where(~F.col("word").isin(UNIQUE_STOP_WORDS))


def fit(df: DataFrame, rating: str = "rating", alpha: float = ALPHA, least_count: int = LEAST_COUNT, most_words: int = MOST_WORDS) -> NaiveBayes:
    """Fit on the rows of ``df`` that have a rating; a word is a keyword of W2.

    Rows without a rating take no part, a null text has no words.  The priors (one row) reach the driver; the
    weights, at most ``most_words`` rows, stay a frame that callers may write and read again.
    """
    rows = df.select("text", rating_labels(F.col(rating).cast("double")).alias("label")).where(F.col("label").isNotNull())
    n = rows.agg(*[F.count_if(F.col("label") == c).alias(c) for c in CLASSES]).first()
    total = sum(n)
    priors = {c: math.log((n[c] + alpha) / (total + alpha * len(CLASSES))) for c in CLASSES}
    counts = _words(rows, F.col("label")).groupBy("word").agg(
        F.count(F.lit(1)).alias("count"), *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES]).where(F.col("count") >= least_count)
    counts = counts.orderBy(F.col("count").desc(), "word").limit(most_words)
    sums = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{c}").alias(f"t_{c}") for c in CLASSES])
    one = F.broadcast(sums.withColumn("_all", F.lit(1)))                    # one row
    weights = counts.withColumn("_all", F.lit(1)).join(one, "_all").select(
        "word", "count", *[F.ln((F.col(f"n_{c}") + alpha) / (F.col(f"t_{c}") + alpha * F.col("v"))).alias(c) for c in CLASSES])
    return NaiveBayes(weights, priors)


def score(df: DataFrame, model: NaiveBayes, id_col: str = "id") -> DataFrame:
    """``df`` with sentiment_label and confidence_score by the model; ids tell the rows apart.

    The label is the class of the largest posterior, the confidence that posterior; ties go to the class that sorts
    first.  Words the model has not seen say nothing, so a text without known words, a null one too, gets the priors.
    """
    sums = _words(df, F.col(id_col).alias("_id")).join(F.broadcast(model.weights), "word").groupBy("_id").agg(
        *[F.sum(c).alias(f"_{c}") for c in CLASSES])
    out = df.drop("sentiment_label", "confidence_score").join(sums, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    margins = {c: F.lit(model.priors[c]) + F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in CLASSES}
    out = out.withColumns({f"_m_{c}": m for c, m in margins.items()})
    best = F.greatest(*[F.col(f"_m_{c}") for c in CLASSES])
    label = F.when(F.col("_m_negative") == best, "negative").when(F.col("_m_neutral") == best, "neutral").otherwise("positive")
    mass = sum((F.exp(F.col(f"_m_{c}") - best) for c in CLASSES), F.lit(0.0))
    return out.withColumns({"sentiment_label": label, "confidence_score": F.lit(1.0) / mass}).drop(
        "_id", *[f"_{c}" for c in CLASSES], *[f"_m_{c}" for c in CLASSES])


def agreement(scored: DataFrame, rating: str = "rating", label: str = "sentiment_label") -> DataFrame:
    """(n, agreement): the share of rated rows whose label's polarity is that of the rating."""
    rows = scored.select(rating_labels(F.col(rating).cast("double")).alias("want"), polarity(label, "m1").alias("got")).where(F.col("want").isNotNull())
    same = F.coalesce(F.col("want") == F.col("got"), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if(same).cast("double"), F.count(F.lit(1))).alias("agreement"))
