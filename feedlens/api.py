"""The public surface under the names used by the survey's target API.

Everything here re-exports or dispatches to the operators.  All functions that return frames are lazy;
``write_results`` and a started ``stream_reviews`` run jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import compare as _compare, metrics as _metrics, normalize as _normalize
from .operators import products as _products, profile as _profile, rules as _rules
from .operators import scoring as _scoring, text as _text, timeseries as _ts
from .sources import readers as _readers, sinks as _sinks
from .streaming import streams as _streams

_READERS = {
    "csv": _readers.read_reviews_csv,
    "enriched_csv": _readers.read_enriched_csv,
    "json": _readers.read_reviews_json,
    "json_array": _readers.read_reviews_json_array,
    "feedback_csv": _readers.read_feedback_csv,
    "parquet": _readers.read_fact,
}


def read_reviews(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read reviews or feedback in one of the supported formats."""
    return _READERS[fmt](spark, path)


def normalize(df: DataFrame, as_of) -> DataFrame:
    """Blank texts dropped, review rows mapped to feedback rows."""
    return _normalize.reviews_to_feedback(_normalize.drop_blank_text(df), as_of)


def score(df: DataFrame, scorer: str | Callable = "lexicon", **kw) -> DataFrame:
    """``"rating"``, ``"lexicon"`` (native) or any pandas batch scorer (pandas UDF)."""
    if scorer == "rating":
        return _scoring.rating_scorer(df, **kw)
    if scorer == "lexicon":
        return _scoring.lexicon_scorer(df, **kw)
    return _scoring.score_with(df, scorer, **kw)


write_results = _sinks.write_results
statistics = _profile.statistics
label_distribution = _profile.label_distribution
timeseries = _ts.sentiment_timeseries
emotion_timeseries = _ts.emotion_timeseries
products_timeseries = _ts.products_timeseries
product_timeseries = _ts.product_timeseries
timeseries_summary = _ts.timeseries_summary
products = _products.products_page
product_summary = _products.product_summary
top_comments = _text.top_comments
keywords = _text.keywords
insights = _rules.insights
suggestions = _rules.suggestions
alerts = _rules.alerts
escalations = _rules.escalations
volume_leaders = _rules.volume_leaders
dashboard = _rules.dashboard
confusion_matrix = _metrics.confusion_matrix
class_metrics = _metrics.class_metrics
overall_metrics = _metrics.overall_metrics
class_distribution = _metrics.class_distribution
confidence_by_class = _metrics.confidence_by_class
metadata_keys = _profile.metadata_key_census
stream_reviews = _streams.stream_reviews
stream_timeseries = _streams.stream_timeseries
stream_spikes = _streams.stream_spikes


def compare_products(df: DataFrame, product_1: str, product_2: str, top_n: int = 10) -> DataFrame:
    """Compare two products of a fact table (summary + keyword set algebra)."""
    return _compare.compare_products(_compare.comparable_summary(df, [product_1, product_2], top_n),
                                     product_1, product_2)


def profile(df: DataFrame, distinct_cols: list[str] | None = None) -> DataFrame:
    """Row count and distinct counts (default: product)."""
    return _profile.dataset_profile(df, distinct_cols or ["product"])
