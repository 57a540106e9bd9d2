"""Registered statistics / profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import filters as FL, profile as PR, sketches as SKT
from ..operators.scoring import rating_labels
from ..session import scratch_path
from ..sources import readers, sinks
from ..sources.fixtures import feedback_docs, feedback_events, feedback_orders
from .oracle import with_views
from .registry import register


@register("A1_statistics", with_views("""
SELECT CAST(count(*) AS BIGINT) AS total_analyses,
       CAST(count(DISTINCT CAST(event_ts AS DATE)) AS BIGINT) AS days_analyzed,
       avg(confidence_score) AS average_confidence,
       min(event_ts) AS first_analysis, max(event_ts) AS last_analysis
FROM feedback_events"""), stable=('average_confidence',))
def a1(spark, sf):
    return PR.statistics(feedback_events(spark, sf))


@register("A2_label_distribution", with_views(
    "SELECT sentiment_label, CAST(count(*) AS BIGINT) AS count FROM feedback_events GROUP BY 1"))
def a2(spark, sf):
    return PR.label_distribution(feedback_events(spark, sf))


@register("A23_dataset_profile", with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT product) AS BIGINT) AS n_distinct_product,
       CAST(count(DISTINCT team) AS BIGINT) AS n_distinct_team FROM feedback_orders"""))
def a23(spark, sf):
    return PR.dataset_profile(feedback_orders(spark, sf), ["product", "team"])


@register("A24_score_distribution", with_views("""
SELECT score AS value, CAST(count(*) AS BIGINT) AS count,
       CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM feedback_orders) AS percentage
FROM feedback_orders GROUP BY score"""))
def a24(spark, sf):
    return PR.value_distribution(feedback_orders(spark, sf), "score")


@register("A24_expected_sentiment_distribution", with_views("""
SELECT CASE WHEN score >= 4 THEN 'positive' WHEN score <= 2 THEN 'negative'
            WHEN score IS NOT NULL THEN 'neutral' END AS value, CAST(count(*) AS BIGINT) AS count,
       CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM feedback_orders) AS percentage
FROM feedback_orders GROUP BY 1"""))
def a24b(spark, sf):
    df = feedback_orders(spark, sf).withColumn("expected_sentiment", rating_labels(F.col("score")))
    return PR.value_distribution(df, "expected_sentiment")


@register("A25_text_length", with_views("""
SELECT avg(length(text)) AS avg_length, CAST(min(length(text)) AS INTEGER) AS min_length,
       CAST(max(length(text)) AS INTEGER) AS max_length FROM feedback_docs"""), stable=('avg_length',))
def a25(spark, sf):
    return PR.text_length_stats(feedback_docs(spark, sf, with_rating=False))


@register("A26_average_rating", with_views(
    "SELECT round_even(avg(score), 2) AS average_rating FROM feedback_orders"))
def a26(spark, sf):
    return PR.average_rating(feedback_orders(spark, sf))


@register("A27_helpfulness", with_views("""
SELECT avg(CAST(helpfulness_numerator AS DOUBLE) /
           CASE WHEN helpfulness_denominator = 0 THEN 1 ELSE helpfulness_denominator END)
         AS avg_helpfulness_ratio,
       CAST(count_if(CAST(helpfulness_numerator AS DOUBLE) /
           CASE WHEN helpfulness_denominator = 0 THEN 1 ELSE helpfulness_denominator END = 1.0)
         AS BIGINT) AS fully_helpful
FROM feedback_docs"""), stable=('avg_helpfulness_ratio',))
def a27(spark, sf):
    return PR.helpfulness_stats(feedback_docs(spark, sf, with_rating=False))


@register("A28_top_products_share", with_views("""
SELECT product, CAST(count(*) AS BIGINT) AS count,
       CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM feedback_orders) AS share
FROM feedback_orders GROUP BY product ORDER BY count DESC, product LIMIT 5"""))
def a28(spark, sf):
    return PR.top_products_share(feedback_orders(spark, sf), 5)


@register("A29_metadata_keys", with_views("""
SELECT key, CAST(count(*) AS BIGINT) AS rows_with_key
FROM (SELECT unnest(json_keys(metadata)) AS key FROM feedback_events) k GROUP BY key"""))
def a29(spark, sf):
    return PR.metadata_key_census(feedback_events(spark, sf))


def _variant_facts(spark, sf):
    """The events as a fact table whose metadata was parsed once, when it was written."""
    path = scratch_path(spark, "variant-facts")
    sinks.write_results(feedback_events(spark, sf), path, variant=True)
    return readers.read_fact(spark, path, variant=True)


@register("A29_metadata_keys_variant", with_views("""
SELECT key, CAST(count(*) AS BIGINT) AS rows_with_key
FROM (SELECT unnest(json_keys(metadata)) AS key FROM feedback_events) k GROUP BY key"""))
def a29_variant(spark, sf):
    return PR.metadata_key_census(_variant_facts(spark, sf))


@register("A29_metadata_schema", with_views("""
SELECT 'OBJECT<k: ' || CASE json_extract_string(json_group_structure(CAST(metadata AS JSON)), '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE 'other' END || '>' AS schema
FROM feedback_events"""))
def a29_schema(spark, sf):
    return metadata.schema(_variant_facts(spark, sf))


@register("F12_metadata_key_variant", with_views(
    "SELECT id, CAST(json_extract_string(metadata, '$.k') AS DOUBLE) AS k FROM feedback_events WHERE list_contains(json_keys(metadata), 'k')"))
def f12_variant(spark, sf):
    df = _variant_facts(spark, sf)
    return FL.has_metadata_key(df, "k").select("id", metadata.field(df, "k", "double").alias("k"))


@register("A30_time_range", with_views(
    "SELECT min(event_ts) AS min_ts, max(event_ts) AS max_ts FROM feedback_orders"))
def a30(spark, sf):
    return PR.time_range(feedback_orders(spark, sf))


@register("A31_distinct_products", with_views(
    "SELECT CAST(count(DISTINCT product) AS BIGINT) AS distinct_products FROM feedback_events"))
def a31(spark, sf):
    return PR.distinct_products(feedback_events(spark, sf))


@register("A31_top10_products", with_views("""
SELECT product, CAST(count(*) AS BIGINT) AS count FROM feedback_orders
GROUP BY product ORDER BY count DESC, product NULLS FIRST LIMIT 10"""))
def a31b(spark, sf):
    return PR.top_products(feedback_orders(spark, sf), 10)


@register("A33_team_share", with_views("""
SELECT team AS value, CAST(count(*) AS BIGINT) AS count,
       round_even(CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM feedback_events), 1)
         AS percentage
FROM feedback_events GROUP BY team"""))
def a33(spark, sf):
    return PR.value_distribution(feedback_events(spark, sf), "team", digits=1)


@register("U5_distinct_products", with_views(
    "SELECT DISTINCT product FROM feedback_docs"))
def u5(spark, sf):
    return feedback_docs(spark, sf, with_rating=False).select("product").distinct()


@register("A31_distinct_over_days", with_views("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT product) AS BIGINT) AS products, CAST(count(DISTINCT team) AS BIGINT) AS teams,
       true AS ids_within_error
FROM feedback_events WHERE CAST(event_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""))
def a31_over_days(spark, sf):
    """Distinct counts over a range of days from the merged sketches of a table that grew by two imports; small
    counts come out exactly, the ids are compared with the exact count."""
    base = scratch_path(spark, "a31-sketches")
    rows = feedback_events(spark, sf)
    for part in (F.col("id") % 3 > 0, F.col("id") % 3 == 0):
        sinks.write_results(rows.where(part), f"{base}/facts")
        SKT.refresh(spark, f"{base}/facts", f"{base}/view")
    exact = rows.where("CAST(event_ts AS DATE) BETWEEN DATE'2024-01-05' AND DATE'2024-01-20'").agg(F.count_distinct("id")).scalar()
    out = SKT.distinct_estimates(spark, f"{base}/view", "2024-01-05", "2024-01-20")
    return out.select("rows", F.col("distinct_product").alias("products"), F.col("distinct_team").alias("teams"),
                      (F.abs(F.col("distinct_id") - exact) <= 3 * SKT.error() * exact).alias("ids_within_error"))
