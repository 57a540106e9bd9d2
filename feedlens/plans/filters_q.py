"""Registered filter queries F1–F13 (each returns the ids / groups it keeps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import polarity_sql
from ..operators import filters as FL
from ..operators.profile import label_distribution
from ..sources.fixtures import feedback_docs, feedback_events
from .oracle import with_views
from .registry import register

AS_OF = "2024-01-20 06:00:00"


@register("F1_time_range", with_views(
    "SELECT id FROM feedback_events WHERE event_ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' "
    "AND TIMESTAMP '2024-01-04 12:30:00'"))
def f1(spark, sf):
    return FL.time_range(feedback_events(spark, sf), "2024-01-03 00:00:00", "2024-01-04 12:30:00").select("id")


@register("F2_optional_equality", with_views(
    "SELECT id FROM feedback_events WHERE team = 'Trial' AND product = 'P6'"))
def f2(spark, sf):
    return FL.equals_if_given(feedback_events(spark, sf), team="Trial", product="P6", sentiment_label=None) \
        .select("id")


@register("F3_default_window", with_views(
    f"SELECT id FROM feedback_events WHERE event_ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY "
    f"AND TIMESTAMP '{AS_OF}'"))
def f3(spark, sf):
    start, end = FL.default_window(AS_OF, days=1)
    return FL.time_range(feedback_events(spark, sf), start, end).select("id")


@register("F4_date_bounds", with_views(
    "SELECT id FROM feedback_events WHERE event_ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' "
    "AND TIMESTAMP '2024-01-12 00:00:00'"))
def f4(spark, sf):
    start, end = FL.date_bounds("2024-01-10", "2024-01-12")
    return FL.time_range(feedback_events(spark, sf), start, end).select("id")


@register("F5_known_product", with_views(
    "SELECT id, product FROM feedback_events WHERE product IS NOT NULL AND product <> 'unknown'"))
def f5(spark, sf):
    return FL.known_product(feedback_events(spark, sf)).select("id", "product")


@register("F6_nonempty_product", with_views(
    "SELECT id, product FROM feedback_events WHERE product IS NOT NULL AND product <> ''"))
def f6(spark, sf):
    return FL.nonempty_product(feedback_events(spark, sf)).select("id", "product")


@register("F7_product_list", with_views(
    "SELECT id, product FROM feedback_events WHERE product IN ('P1', 'P2', 'P3')"))
def f7(spark, sf):
    return FL.products_in(feedback_events(spark, sf), " P1, P2 ,P3").select("id", "product")


@register("F8_all_sentinel_filters", with_views(
    "SELECT id FROM feedback_docs WHERE team = 'Normal' AND product = 'src4'"))
def f8(spark, sf):
    return FL.with_all_sentinel(feedback_docs(spark, sf, with_rating=False), sentiment="all",
                                customer_type="Normal", product="src4").select("id")


@register("F9_min_group_size", with_views(
    "SELECT product, CAST(count(*) AS BIGINT) AS n FROM feedback_events GROUP BY product HAVING count(*) >= 200"))
def f9(spark, sf):
    g = feedback_events(spark, sf).groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    return FL.min_group_size(g, "n", 200)


@register("F10_polarity_rows", with_views(
    f"SELECT id FROM feedback_docs WHERE {polarity_sql('sentiment_label', 'm1s')} = 'neutral'"))
def f10(spark, sf):
    return FL.of_polarity(feedback_docs(spark, sf, with_rating=False), "neutral", "m1s").select("id")


@register("F11_recent_days", with_views(
    f"SELECT id FROM feedback_events WHERE event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY"))
def f11(spark, sf):
    return FL.recent_days(feedback_events(spark, sf), AS_OF, 3).select("id")


@register("F12_metadata_key", with_views(
    "SELECT id FROM feedback_events WHERE list_contains(json_keys(metadata), 'k')"))
def f12(spark, sf):
    return FL.has_metadata_key(feedback_events(spark, sf), "k").select("id")


@register("F13_nonzero_labels", with_views("""
SELECT label, CAST(n AS BIGINT) AS count FROM (SELECT 'joy' AS label, count_if(sentiment_label = 'joy') AS n FROM feedback_events
  UNION ALL SELECT 'sadness', count_if(sentiment_label = 'sadness') FROM feedback_events
  UNION ALL SELECT 'anger', count_if(sentiment_label = 'anger') FROM feedback_events) x WHERE n > 0"""))
def f13(spark, sf):
    ld = label_distribution(feedback_events(spark, sf))
    lab = F.col("sentiment_label")
    wide = ld.agg(*[F.sum(F.when(lab == x, F.col("count")).otherwise(0)).alias(x) for x in ("joy", "sadness", "anger")])
    long = wide.unpivot([], ["joy", "sadness", "anger"], "label", "count")
    return FL.positive_counts(long, "count")
