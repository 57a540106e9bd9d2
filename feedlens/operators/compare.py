"""Product comparison J3 with keyword set operations U1 (common) and U2 (unique).

The two products are selected by a predicate on the grouping key, which Catalyst pushes below the
aggregates into the scan; the pairing itself is a conditional aggregate over the two summary rows
(no join, never all pairs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .products import bulk_summary
from .text import keyword_lists

_NUM = ["positive_percentage", "negative_percentage", "neutral_percentage", "avg_confidence",
        "total_reviews"]
_KW = ["positive_keywords", "negative_keywords"]


def comparable_summary(df: DataFrame, products: list[str], top_n: int = 10) -> DataFrame:
    d = df.where(F.col("product").isin(products))
    kw = keyword_lists(d, top_n).withColumnRenamed("product", "product_id")
    empty = F.array().cast("array<string>")
    s = bulk_summary(d).join(kw, "product_id", "left")
    return s.withColumns({c: F.coalesce(F.col(c), empty) for c in _KW})


def compare_products(summary: DataFrame, product_1: str, product_2: str) -> DataFrame:
    """Differences (1 minus 2), better product (tie -> product 2), keyword set algebra."""
    pick = lambda c, p: F.max(F.when(F.col("product_id") == p, F.col(c)))
    g = summary.where(F.col("product_id").isin(product_1, product_2)).agg(
        *[pick(c, product_1).alias(f"{c}_1") for c in _NUM + _KW],
        *[pick(c, product_2).alias(f"{c}_2") for c in _NUM + _KW])

    def srt(c):
        return F.array_sort(c)
    return g.select(
        F.lit(product_1).alias("product_1"), F.lit(product_2).alias("product_2"),
        (F.col("positive_percentage_1") - F.col("positive_percentage_2")).alias("positive_percentage_diff"),
        (F.col("negative_percentage_1") - F.col("negative_percentage_2")).alias("negative_percentage_diff"),
        (F.col("neutral_percentage_1") - F.col("neutral_percentage_2")).alias("neutral_percentage_diff"),
        (F.col("avg_confidence_1") - F.col("avg_confidence_2")).alias("confidence_diff"),
        (F.col("total_reviews_1") - F.col("total_reviews_2")).alias("total_reviews_diff"),
        F.when(F.col("positive_percentage_1") > F.col("positive_percentage_2"), F.lit(product_1))
         .otherwise(F.lit(product_2)).alias("better_product"),
        srt(F.array_intersect("positive_keywords_1", "positive_keywords_2")).alias("common_positive_keywords"),
        srt(F.array_intersect("negative_keywords_1", "negative_keywords_2")).alias("common_negative_keywords"),
        srt(F.array_except("positive_keywords_1", "positive_keywords_2")).alias("unique_positive_keywords_p1"),
        srt(F.array_except("positive_keywords_2", "positive_keywords_1")).alias("unique_positive_keywords_p2"),
        srt(F.array_except("negative_keywords_1", "negative_keywords_2")).alias("unique_negative_keywords_p1"),
        srt(F.array_except("negative_keywords_2", "negative_keywords_1")).alias("unique_negative_keywords_p2"))


def keyword_set_rows(comparison: DataFrame) -> DataFrame:
    """U1/U2 flat form: one row per (set, keyword)."""
    sets = ["common_positive_keywords", "common_negative_keywords", "unique_positive_keywords_p1",
            "unique_positive_keywords_p2", "unique_negative_keywords_p1", "unique_negative_keywords_p2"]
    arr = F.array(*[F.struct(F.lit(s).alias("keyword_set"), F.col(s).alias("kw")) for s in sets])
    return (comparison.select(F.explode(arr).alias("x"))
                      .select("x.keyword_set", F.explode("x.kw").alias("keyword")))
