"""Product rollups (A3, A4, A9–A11), paging (W3) and the product summary.

All rollups are a single ``groupBy(product)`` with conditional counts: partial aggregation runs
map-side, so a product holding a third of all rows costs one hash-table entry per task, not a hot
reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import metadata
from ..functions.labels import count_polarity
from ..functions.numeric import pct
from . import filters

# ---- fixed values (must equal the reference) -------------------------------------------------
THEMES_PREFIX, NO_THEMES = "Key themes: ", "No key themes detected."
# ------------------------------------------------------------------------------------------------


def product_rollup(df: DataFrame, min_reviews: int = 1, scheme: str = "m1s") -> DataFrame:
    """A3: per known product (F5) total, pos/neg/neu counts and %, avg confidence, first/last."""
    g = (filters.known_product(df).groupBy("product").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        count_polarity("sentiment_label", "positive", scheme).alias("positive"),
        count_polarity("sentiment_label", "negative", scheme).alias("negative"),
        count_polarity("sentiment_label", "neutral", scheme).alias("neutral"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.min("event_ts").alias("first_review"),
        F.max("event_ts").alias("last_review"),
    ))
    g = filters.min_group_size(g, "total_reviews", min_reviews)
    return g.select(
        F.col("product").alias("product_id"), "total_reviews", "positive", "negative", "neutral",
        pct(F.col("positive"), F.col("total_reviews")).alias("positive_percentage"),
        pct(F.col("negative"), F.col("total_reviews")).alias("negative_percentage"),
        pct(F.col("neutral"), F.col("total_reviews")).alias("neutral_percentage"),
        "avg_confidence", "first_review", "last_review")


def qualifying_products(df: DataFrame, min_reviews: int = 1) -> DataFrame:
    """A4: number of known products with at least ``min_reviews`` rows (one-row DataFrame)."""
    g = filters.known_product(df).groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    return filters.min_group_size(g, "n", min_reviews).agg(F.count(F.lit(1)).alias("total"))


def products_page(df: DataFrame, limit: int = 100, offset: int = 0, min_reviews: int = 1,
                  scheme: str = "m1s") -> DataFrame:
    """Rollup ordered by volume (ties by product id), LIMIT/OFFSET, plus total and has_more.

    The page is a top-(offset+limit) sort (TakeOrderedAndProject); the total is a scalar subquery.
    """
    roll = product_rollup(df, min_reviews, scheme)
    total = roll.agg(F.count(F.lit(1))).scalar()        # same aggregate: its exchange is reused
    page = roll.orderBy(F.col("total_reviews").desc(), F.col("product_id").asc())
    if offset:
        page = page.offset(offset)
    page = page.limit(limit)
    return page.withColumns({
        "total": total,
        "has_more": F.lit(offset + limit) < total,
    })


def bulk_summary(df: DataFrame) -> DataFrame:
    """Per product (all products, 'unknown' included) M1 counts, % and avg confidence."""
    g = df.groupBy("product").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        count_polarity("sentiment_label", "positive", "m1").alias("positive_count"),
        count_polarity("sentiment_label", "negative", "m1").alias("negative_count"),
        count_polarity("sentiment_label", "neutral", "m1").alias("neutral_count"),
        F.sum(F.coalesce(F.col("confidence_score"), F.lit(0.0))).alias("_conf"),
    )
    t = F.col("total_reviews")
    return g.select(
        F.col("product").alias("product_id"), "total_reviews",
        "positive_count", "negative_count", "neutral_count",
        pct(F.col("positive_count"), t).alias("positive_percentage"),
        pct(F.col("negative_count"), t).alias("negative_percentage"),
        pct(F.col("neutral_count"), t).alias("neutral_percentage"),
        F.when(t > 0, F.col("_conf") / t).otherwise(F.lit(0.0)).alias("avg_confidence"))


def bulk_summary_with_emotions(df: DataFrame) -> DataFrame:
    """A9 + A10 from one (product, emotion) pre-aggregate: the per-product totals and the emotion
    map are both re-aggregated from it (one scan, two small shuffles instead of three)."""
    emotion = F.lower(F.coalesce("sentiment_label", F.lit("")))
    lvl1 = df.groupBy("product", emotion.alias("emotion")).agg(
        F.count(F.lit(1)).alias("count"),
        count_polarity("sentiment_label", "positive", "m1").alias("p"),
        count_polarity("sentiment_label", "negative", "m1").alias("n"),
        count_polarity("sentiment_label", "neutral", "m1").alias("u"),
        F.sum(F.coalesce(F.col("confidence_score"), F.lit(0.0))).alias("c"))
    g = lvl1.groupBy("product").agg(
        F.sum("count").alias("total_reviews"), F.sum("p").alias("positive_count"),
        F.sum("n").alias("negative_count"), F.sum("u").alias("neutral_count"), F.sum("c").alias("_conf"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("emotion", "count")))).alias("emotion_counts"))
    t = F.col("total_reviews")
    return g.select(
        F.col("product").alias("product_id"), "total_reviews",
        "positive_count", "negative_count", "neutral_count",
        pct(F.col("positive_count"), t).alias("positive_percentage"),
        pct(F.col("negative_count"), t).alias("negative_percentage"),
        pct(F.col("neutral_count"), t).alias("neutral_percentage"),
        F.when(t > 0, F.col("_conf") / t).otherwise(F.lit(0.0)).alias("avg_confidence"),
        "emotion_counts")


def emotion_counts_long(df: DataFrame) -> DataFrame:
    """A10 (flat form): rows (product, emotion, count); emotion = lower-cased label."""
    return (df.groupBy("product", F.lower(F.coalesce("sentiment_label", F.lit(""))).alias("emotion"))
              .agg(F.count(F.lit(1)).alias("count")))


def modal_value(df: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smallest value.

    Counted per (key, value) first, so the window only ranks distinct values of a key.
    """
    out = out or f"modal_{value}"
    counts = (df.where(F.col(value).isNotNull())
                .groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(key).orderBy(F.col("_n").desc(), F.col(value).asc())
    return (counts.withColumn("_rk", F.row_number().over(w)).where("_rk = 1")
                  .select(key, F.col(value).alias(out), F.col("_n").alias(f"{out}_count")))


def _modal_metadata(df: DataFrame) -> DataFrame:
    """A11 for product name and CSV description in one pass: (product, field, value) counts, one
    window ranking both fields, then one row per product."""
    kv = df.select("product", F.inline(F.array(
        F.struct(F.lit("product_name").alias("field"),
                 metadata.field(df, "product_name").alias("value")),
        F.struct(F.lit("csv_description").alias("field"),
                 metadata.field(df, "product_description").alias("value")))))
    best = modal_value(kv.withColumn("key", F.struct("product", "field")), "key", "value", "v")
    return best.groupBy(F.col("key.product").alias("product_id")).agg(
        F.max(F.when(F.col("key.field") == "product_name", F.col("v"))).alias("product_name"),
        F.max(F.when(F.col("key.field") == "csv_description", F.col("v"))).alias("csv_description"))


def key_themes(pos_keywords: Column, neg_keywords: Column, n: int = 5) -> Column:
    """Ordered de-duplicated positive-then-negative keywords, first ``n``."""
    return F.slice(F.array_distinct(F.concat(pos_keywords, neg_keywords)), 1, n)


def product_description(csv_description: Column, themes: Column) -> Column:
    """Modal CSV description, else the key themes, else a fixed sentence."""
    return F.coalesce(
        csv_description,
        F.when(F.size(themes) > 0, F.concat(F.lit(THEMES_PREFIX), F.array_join(themes, ", "))),
        F.lit(NO_THEMES))


def product_summary(df: DataFrame, top_n: int = 10, as_of=None) -> DataFrame:
    """The bulk-import product summary — A9 + A10 + A11 + W1 + W2 + U3/R6 joined on product.

    Every side is aggregated to one row (or a top-N list) per product before the equi-joins,
    so the joins move bounded rows per product.
    """
    from . import text as textops

    base = bulk_summary_with_emotions(df)
    kw = textops.keyword_lists(df, top_n).withColumnRenamed("product", "product_id")
    tc = textops.top_comment_lists(df, top_n, as_of).withColumnRenamed("product", "product_id")
    out = base.join(kw, "product_id", "left").join(tc, "product_id", "left")
    empty = F.array().cast("array<string>")
    for p in ("positive", "negative", "neutral"):
        out = out.withColumn(f"{p}_keywords", F.coalesce(F.col(f"{p}_keywords"), empty))
        c = f"top_{p}_comments"
        out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(tc.schema[c].dataType)))
    if "metadata" in df.columns:
        out = out.join(_modal_metadata(df), "product_id", "left")
    else:
        out = out.withColumn("product_name", F.lit(None).cast("string")) \
                 .withColumn("csv_description", F.lit(None).cast("string"))
    themes = key_themes(F.col("positive_keywords"), F.col("negative_keywords"))
    return out.withColumn("product_description",
                          product_description(F.col("csv_description"), themes)) \
              .drop("csv_description")
