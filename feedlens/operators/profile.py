"""Statistics and dataset profile: A1, A2, A23–A31, A33.

Shares of a total use a scalar subquery (``DataFrame.scalar()``) over the grouped counts, whose shuffle is
reused: nothing is cross-joined, no window runs over all rows in one partition and the facts are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metadata
from ..functions.numeric import py_round


def _distinct(col, exact: bool):
    """Exact distinct count, or HyperLogLog++ (``approx_count_distinct``, ~1 % error) when an exact
    answer is not needed: the sketch merges map-side instead of shuffling every distinct value."""
    return F.count_distinct(col) if exact else F.approx_count_distinct(col)


def statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """A1: count, distinct days, average confidence, first and last event."""
    return df.agg(
        F.count(F.lit(1)).alias("total_analyses"),
        _distinct(F.to_date("event_ts"), exact).alias("days_analyzed"),
        F.avg("confidence_score").alias("average_confidence"),
        F.min("event_ts").alias("first_analysis"),
        F.max("event_ts").alias("last_analysis"))


def label_distribution(df: DataFrame) -> DataFrame:
    """A2: rows per raw sentiment label."""
    return df.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("count"))


def dataset_profile(df: DataFrame, distinct_cols: list[str], exact: bool = True) -> DataFrame:
    """Row count and distinct counts of the given columns (e.g. product, user)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[_distinct(F.col(c), exact).alias(f"n_distinct_{c}") for c in distinct_cols])


def value_distribution(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    """Count and percentage of each value of ``col`` (optionally rounded, half-even)."""
    g = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count")).scalar()               # from the grouped counts: the facts are read once
    share = F.col("count").cast("double") * F.lit(100.0) / total
    if digits is not None:
        share = py_round(share, digits)
    return g.withColumn("percentage", share)


def text_length_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean / min / max text length in characters."""
    n = F.length(text_col)
    return df.agg(F.avg(n).alias("avg_length"), F.min(n).alias("min_length"),
                  F.max(n).alias("max_length"))


def average_rating(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Mean rating rounded to 2 decimals (half-even)."""
    return df.agg(py_round(F.avg(score_col), 2).alias("average_rating"))


def helpfulness_stats(df: DataFrame, num: str = "helpfulness_numerator",
                      den: str = "helpfulness_denominator") -> DataFrame:
    """Helpfulness ratio with denominator 0 read as 1: mean and rows with ratio exactly 1."""
    r = F.col(num).cast("double") / F.when(F.col(den) == 0, F.lit(1)).otherwise(F.col(den))
    return df.agg(F.avg(r).alias("avg_helpfulness_ratio"),
                  F.count_if(r == 1.0).alias("fully_helpful"))


def top_products_share(df: DataFrame, n: int = 5) -> DataFrame:
    """The n most reviewed products with their share of all rows (rank 1 = most reviewed)."""
    g = df.groupBy("product").agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count")).scalar()
    top = g.orderBy(F.col("count").desc(), F.col("product")).limit(n)
    return top.withColumn("share", F.col("count").cast("double") * F.lit(100.0) / total)


def metadata_key_census(df: DataFrame) -> DataFrame:
    """For each metadata key, the number of rows holding it."""
    return metadata.keys(df).groupBy("key").agg(F.count(F.lit(1)).alias("rows_with_key"))


def time_range(df: DataFrame) -> DataFrame:
    """First and last event time."""
    return df.agg(F.min("event_ts").alias("min_ts"), F.max("event_ts").alias("max_ts"))


def distinct_products(df: DataFrame, exact: bool = True) -> DataFrame:
    """Number of distinct products."""
    return df.agg(_distinct(F.col("product"), exact).alias("distinct_products"))


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The n products with most rows (ties by product id)."""
    g = df.groupBy("product").agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), F.col("product").asc_nulls_first()).limit(n)
