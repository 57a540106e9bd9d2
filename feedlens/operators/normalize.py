"""Projections and normalisation P1–P16: raw reviews / feedback items -> feedback rows.

All steps are column expressions in one ``select`` (P1), so normalisation fuses into the scan's
whole-stage codegen and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import M3_NEGATIVE, M3_NEUTRAL, M3_POSITIVE, polarity
from ..functions.timefns import parse_event_time
from .scoring import rating_labels

# Defaults applied by the reference's CSV loaders.
REVIEW_DEFAULTS = {"Score": 3.0, "HelpfulnessNumerator": 0, "HelpfulnessDenominator": 0,
                   "Customer_Type": "Normal"}


def _text(c: str) -> Column:
    """String column with '' read as missing (the reference tests strings by truthiness)."""
    return F.nullif(F.col(c), F.lit(""))


def product_or_unknown(c: Column) -> Column:
    """Missing or empty product -> 'unknown'."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def review_metadata(df: DataFrame) -> Column:
    """P5: metadata JSON holding only present keys, in the reference's key order."""
    cols = set(df.columns)
    score = F.col("Score").cast("double")
    fields = [
        score.alias("rating"),
        rating_labels(score).alias("expected_sentiment"),                 # P4
        _text("Id").alias("review_id"),
        _text("UserId").alias("user_id"),
        _text("ProfileName").alias("profile_name"),
        _text("Summary").alias("summary"),
        F.col("HelpfulnessNumerator").alias("helpfulness_numerator"),
        F.col("HelpfulnessDenominator").alias("helpfulness_denominator"),
    ]
    for src, name in (("Suggestions", "suggestion"), ("ProductName", "product_name"),
                      ("ProductDescription", "product_description")):
        if src in cols:
            fields.append(_text(src).alias(name))
    return F.to_json(F.struct(*fields))   # null fields are dropped by to_json


def review_id(df: DataFrame) -> Column:
    """Numeric review id, or a 64-bit hash of the review when the id is not numeric."""
    return F.coalesce(F.col("Id").try_cast("long"),
                      F.xxhash64(*[F.col(c) for c in ("Id", "ProductId", "UserId", "Time", "Text")]))


def reviews_to_feedback(reviews: DataFrame, as_of) -> DataFrame:
    """P1 (+P2–P6): review rows -> feedback rows (id, text, event_ts, team, product, metadata).

    The parsed review time is used as event time (the reference drops it and stamps "now");
    unparseable times fall back to ``as_of``.
    """
    return reviews.select(
        review_id(reviews).alias("id"),
        F.col("Text").alias("text"),
        parse_event_time(F.col("Time"), fallback=as_of).alias("event_ts"),      # P3
        _text("Customer_Type").alias("team"),                                  # P6
        product_or_unknown(F.col("ProductId")).alias("product"),               # P2
        review_metadata(reviews).alias("metadata"))                            # P4, P5


def drop_blank_text(df: DataFrame, text_col: str = "Text") -> DataFrame:
    """Drop rows whose text is missing or only (Unicode) white space."""
    return df.where(has_text(F.col(text_col)))


def has_text(text: Column) -> Column:
    """P8's condition: some character that is not (Unicode) white space."""
    return text.rlike("(?U)\\S")


def fill_review_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Loader defaults for missing values (score 3, helpfulness 0, type 'Normal')."""
    d = {k: v for k, v in (defaults or REVIEW_DEFAULTS).items() if k in df.columns}
    return df.na.fill(d)


def resolve_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """P10: case-insensitive column aliases (``text``/``Text``, ``productId``/``ProductId``)."""
    by_lower = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(by_lower[w.lower()]).alias(w) if w.lower() in by_lower
                       else F.lit(None).cast("string").alias(w) for w in wanted])


def helpfulness_text(num: Column, den: Column) -> Column:
    """Helpfulness as the text 'n/d'."""
    return F.concat_ws("/", num.cast("string"), den.cast("string"))


def normalized_label(label: Column) -> Column:
    """Lower-cased label."""
    return F.lower(label)


def label_maps(df: DataFrame) -> DataFrame:
    """Each distinct label with its lower form and M1 / M1s / M2 / M3 classes."""
    g = df.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("count"))
    return g.select("sentiment_label", "count",
                    normalized_label(F.col("sentiment_label")).alias("label_lower"),
                    polarity("sentiment_label", "m1").alias("m1"),
                    polarity("sentiment_label", "m1s").alias("m1s"),
                    polarity("sentiment_label", "m2").alias("m2"),
                    polarity("sentiment_label", "m3").alias("m3"))


def dashboard_polarity(label_counts: DataFrame) -> DataFrame:
    """Dashboard positive / negative / neutral (case-sensitive M3 lists) and total, from a
    label distribution (A2)."""
    lab, n = F.col("sentiment_label"), F.col("count")
    return label_counts.agg(
        F.sum(F.when(lab.isin(M3_POSITIVE), n).otherwise(0)).alias("positive"),
        F.sum(F.when(lab.isin(M3_NEGATIVE), n).otherwise(0)).alias("negative"),
        F.sum(F.when(lab.isin(M3_NEUTRAL), n).otherwise(0)).alias("neutral"),
        F.sum(n).alias("total"))
