"""Registered product queries (A3, A4, A9–A11, W3, R6/J5 flat parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import polarity_sql
from ..functions.numeric import pct_sql
from ..operators import products as P, ranking as RK
from ..operators.scoring import rating_labels
from ..session import scratch_path
from ..sources.fixtures import feedback_docs, feedback_events, feedback_orders
from .oracle import with_views
from .registry import register


def _rollup_sql(src: str, min_reviews: int) -> str:
    pol = polarity_sql("sentiment_label", "m1s")
    return f"""
  SELECT product AS product_id, CAST(count(*) AS BIGINT) AS total_reviews,
         CAST(count_if({pol} = 'positive') AS BIGINT) AS positive,
         CAST(count_if({pol} = 'negative') AS BIGINT) AS negative,
         CAST(count_if({pol} = 'neutral') AS BIGINT) AS neutral,
         avg(confidence_score) AS avg_confidence,
         min(event_ts) AS first_review, max(event_ts) AS last_review
  FROM {src} WHERE product IS NOT NULL AND product <> 'unknown'
  GROUP BY product HAVING count(*) >= {min_reviews}"""


def _rollup_select(inner: str) -> str:
    return f"""SELECT product_id, total_reviews, positive, negative, neutral,
  {pct_sql('positive', 'total_reviews')} AS positive_percentage,
  {pct_sql('negative', 'total_reviews')} AS negative_percentage,
  {pct_sql('neutral', 'total_reviews')} AS neutral_percentage,
  avg_confidence, first_review, last_review FROM ({inner}) r"""


_SCORED_SQL = ("SELECT *, CASE WHEN score >= 4 THEN 'positive' WHEN score <= 2 THEN 'negative' "
               "ELSE 'neutral' END AS sentiment_label, 0.5e0 AS confidence_score FROM feedback_orders")


def _scored_orders(spark, sf):
    df = feedback_orders(spark, sf)
    return df.withColumn("sentiment_label", rating_labels(F.col("score"))).withColumn("confidence_score", F.lit(0.5))


@register("A3_product_rollup", with_views(_rollup_select(_rollup_sql("feedback_events", 1))), stable=('avg_confidence',))
def a3(spark, sf):
    return P.product_rollup(feedback_events(spark, sf))


@register("A3_product_rollup_orders",
          with_views(_rollup_select(_rollup_sql(f"({_SCORED_SQL})", 1))), stable=('avg_confidence',))
def a3_orders(spark, sf):
    return P.product_rollup(_scored_orders(spark, sf))


@register("A4_qualifying_products", with_views(
    "SELECT CAST(count(*) AS BIGINT) AS total FROM (SELECT product FROM feedback_events "
    "WHERE product IS NOT NULL AND product <> 'unknown' GROUP BY product HAVING count(*) >= 150) q"))
def a4(spark, sf):
    return P.qualifying_products(feedback_events(spark, sf), min_reviews=150)


@register("W3_products_page", with_views(f"""
SELECT p.*, t.total, (10 + 10) < t.total AS has_more
FROM ({_rollup_select(_rollup_sql('feedback_events', 1))} ORDER BY total_reviews DESC, product_id
      LIMIT 10 OFFSET 10) p,
     (SELECT CAST(count(*) AS BIGINT) AS total FROM (SELECT product FROM feedback_events
      WHERE product IS NOT NULL AND product <> 'unknown' GROUP BY product) q) t"""), stable=('avg_confidence',))
def w3(spark, sf):
    return P.products_page(feedback_events(spark, sf), limit=10, offset=10)


@register("W3_products_deep_page", with_views(f"""
SELECT p.*, t.total, (15 + 150) < t.total AS has_more
FROM ({_rollup_select(_rollup_sql('scored_orders', 1))} ORDER BY total_reviews DESC, product_id
      LIMIT 15 OFFSET 150) p,
     (SELECT CAST(count(*) AS BIGINT) AS total FROM (SELECT product FROM scored_orders
      WHERE product IS NOT NULL AND product <> 'unknown' GROUP BY product) q) t""", ("scored_orders", _SCORED_SQL)), stable=('avg_confidence',))
def w3_deep(spark, sf):
    path = scratch_path(spark, "w3-rank-index")
    RK.build_rank_index(_scored_orders(spark, sf), path, parts=16)
    return RK.page_from_index(spark, path, limit=15, offset=150)


@register("W3_products_after", with_views(f"""
SELECT * FROM ({_rollup_select(_rollup_sql('feedback_events', 1))}) p
WHERE total_reviews < 206 OR (total_reviews = 206 AND product_id > 'P2') ORDER BY total_reviews DESC, product_id LIMIT 12"""), stable=('avg_confidence',))
def w3_after(spark, sf):
    return RK.products_after(feedback_events(spark, sf), 206, "P2", limit=12)


@register("A9_bulk_summary", with_views(f"""
SELECT product AS product_id, CAST(count(*) AS BIGINT) AS total_reviews,
  CAST(count_if({polarity_sql('sentiment_label', 'm1')} = 'positive') AS BIGINT) AS positive_count,
  CAST(count_if({polarity_sql('sentiment_label', 'm1')} = 'negative') AS BIGINT) AS negative_count,
  CAST(count_if({polarity_sql('sentiment_label', 'm1')} = 'neutral') AS BIGINT) AS neutral_count,
  {pct_sql("count_if(" + polarity_sql('sentiment_label', 'm1') + " = 'positive')", 'count(*)')} AS positive_percentage,
  {pct_sql("count_if(" + polarity_sql('sentiment_label', 'm1') + " = 'negative')", 'count(*)')} AS negative_percentage,
  {pct_sql("count_if(" + polarity_sql('sentiment_label', 'm1') + " = 'neutral')", 'count(*)')} AS neutral_percentage,
  sum(coalesce(confidence_score, 0.0)) / count(*) AS avg_confidence
FROM feedback_events GROUP BY product"""), stable=('avg_confidence',))
def a9(spark, sf):
    return P.bulk_summary(feedback_events(spark, sf))


@register("A10_emotion_counts", with_views("""
SELECT product, lower(coalesce(sentiment_label, '')) AS emotion, CAST(count(*) AS BIGINT) AS count
FROM feedback_docs GROUP BY 1, 2"""))
def a10(spark, sf):
    return P.emotion_counts_long(feedback_docs(spark, sf, with_rating=False))


@register("A11_modal_segment", with_views("""
SELECT product, team AS modal_team, n AS modal_team_count FROM (
  SELECT product, team, n, row_number() OVER (PARTITION BY product ORDER BY n DESC, team) AS rk
  FROM (SELECT product, team, CAST(count(*) AS BIGINT) AS n FROM feedback_orders
        WHERE team IS NOT NULL GROUP BY 1, 2) c) r WHERE rk = 1"""))
def a11(spark, sf):
    return P.modal_value(feedback_orders(spark, sf), "product", "team", "modal_team")
