"""Time series A5–A8, A32, J1, J2, R8: one ``groupBy(bucket, team, product)`` pass with
conditional counts instead of the reference's per-label rows + Python pivot (and instead of one
query per product in J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import EMOTIONS, count_polarity
from ..functions.numeric import pct, py_round
from ..functions.timefns import bucket
from . import filters


def _scope(df: DataFrame, start, end, team, product) -> DataFrame:
    df = filters.time_range(df, start, end)                 # F1
    return filters.equals_if_given(df, team=team, product=product)   # F2


def label_buckets(df: DataFrame, start=None, end=None, group_by: str = "hour",
                  team: str | None = None, product: str | None = None) -> DataFrame:
    """A5: rows per (bucket, raw label, team, product) with count and average confidence."""
    d = _scope(df, start, end, team, product)
    return (d.groupBy(bucket("event_ts", group_by).alias("time"), "sentiment_label", "team", "product")
             .agg(F.count(F.lit(1)).alias("count"), F.avg("confidence_score").alias("avg_confidence")))


def sentiment_timeseries(df: DataFrame, start=None, end=None, group_by: str = "hour",
                         team: str | None = None, product: str | None = None,
                         scheme: str = "m1") -> DataFrame:
    """Per bucket × team × product: positive / neutral / negative (M1), total, avg confidence.

    NULL team/product stay their own groups; avg_confidence is the true row average.
    """
    d = _scope(df, start, end, team, product)
    return (d.groupBy(bucket("event_ts", group_by).alias("time"), "team", "product").agg(
        count_polarity("sentiment_label", "positive", scheme).alias("positive"),
        count_polarity("sentiment_label", "neutral", scheme).alias("neutral"),
        count_polarity("sentiment_label", "negative", scheme).alias("negative"),
        F.count(F.lit(1)).alias("total"),
        F.avg("confidence_score").alias("avg_confidence")))


def emotion_timeseries(df: DataFrame, start=None, end=None, group_by: str = "hour",
                       team: str | None = None, product: str | None = None) -> DataFrame:
    """One column per emotion label (closed set -> conditional counts, no pivot pass)."""
    d = _scope(df, start, end, team, product)
    lab = F.lower(F.col("sentiment_label"))
    return d.groupBy(bucket("event_ts", group_by).alias("time")).agg(
        *[F.count_if(lab == e).alias(e) for e in EMOTIONS], F.count(F.lit(1)).alias("total"))


def timeseries_summary(df: DataFrame, start=None, end=None, team: str | None = None,
                       product: str | None = None) -> DataFrame:
    """Totals over the daily series, % (2 dp), mean of bucket confidences (3 dp, as the
    reference) and the row-weighted confidence."""
    s = sentiment_timeseries(df, start, end, "day", team, product)
    g = s.agg(F.sum("total").alias("total_feedback"), F.sum("positive").alias("positive_count"),
              F.sum("negative").alias("negative_count"), F.sum("neutral").alias("neutral_count"),
              F.avg("avg_confidence").alias("_bucket_conf"),
              F.sum(F.col("avg_confidence") * F.col("total")).alias("_wsum"))
    t = F.col("total_feedback")
    return g.select(
        F.coalesce(t, F.lit(0)).alias("total_feedback"),
        F.coalesce("positive_count", F.lit(0)).alias("positive_count"),
        F.coalesce("negative_count", F.lit(0)).alias("negative_count"),
        F.coalesce("neutral_count", F.lit(0)).alias("neutral_count"),
        py_round(pct(F.col("positive_count"), t), 2).alias("positive_percentage"),
        py_round(pct(F.col("negative_count"), t), 2).alias("negative_percentage"),
        py_round(pct(F.col("neutral_count"), t), 2).alias("neutral_percentage"),
        py_round(F.col("_bucket_conf"), 3).alias("average_confidence"),
        py_round(F.col("_wsum") / t, 3).alias("weighted_confidence"))


def product_timeseries(df: DataFrame, product_id: str, start=None, end=None,
                       group_by: str = "day") -> DataFrame:
    """The A6 series of one product."""
    return sentiment_timeseries(df, start, end, group_by, product=product_id)


def products_timeseries(df: DataFrame, product_ids: list[str] | str | None = None, limit: int = 50,
                        start=None, end=None, group_by: str = "day") -> DataFrame:
    """A6 series for the given products, or for the ``limit`` most reviewed known products.

    The top-N product list goes into a left-semi join: one pass over the facts instead of one query per
    product.  Whether that list is broadcast is left to its size at run time.
    """
    from .products import product_rollup
    if product_ids is not None:
        d = filters.products_in(df, product_ids)
    else:
        top = (product_rollup(df).orderBy(F.col("total_reviews").desc(), F.col("product_id"))
               .limit(limit).select(F.col("product_id").alias("product")))
        d = df.join(top, "product", "left_semi")
    return sentiment_timeseries(d, start, end, group_by)


def trend(series: DataFrame) -> DataFrame:
    """A32 (+W7): an A6 series re-rolled per calendar day across team and product, date ordered."""
    return (series.groupBy(bucket("time", "day").alias("day"))
                  .agg(F.sum("positive").alias("positive"), F.sum("neutral").alias("neutral"),
                       F.sum("negative").alias("negative"), F.sum("total").alias("total"))
                  .orderBy("day"))


def chart_series(series: DataFrame, value_cols=("positive", "neutral", "negative", "total")) -> DataFrame:
    """Long (time, team, product, series, value) form of an A6 series, for line/bar/area charts."""
    return series.unpivot(["time", "team", "product"], list(value_cols), "series", "value")
