"""The reference's main flow end to end (bulk import): review rows derived from the tables ->
blank texts dropped -> normalised -> rating scorer -> product summary with keywords, key themes and
top comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import POLARITIES, polarity_sql
from ..functions.numeric import pct_sql
from ..functions.timefns import whole_days_between_sql
from ..operators import normalize as N, products as P, scoring as S, timeseries as TS
from ..session import scratch_path
from ..sources import readers as RD, sinks as SK
from ..sources.derived import REVIEW_ROWS_SQL, review_rows
from .normalize_q import _WS, AS_OF, FEEDBACK_SQL
from .oracle import with_views
from .registry import register
from .text_q import _THEMES_BODY, _kw_ctes

M1 = polarity_sql("sentiment_label", "m1")
M1S = polarity_sql("sentiment_label", "m1s")

_FACTS = f"""SELECT *,
  CASE WHEN coalesce(rating, 3.0e0) >= 4.0e0 THEN 'positive' WHEN coalesce(rating, 3.0e0) <= 2.0e0 THEN 'negative'
       ELSE 'neutral' END AS sentiment_label,
  CASE WHEN coalesce(rating, 3.0e0) >= 4.0e0 THEN 0.85e0 + (coalesce(rating, 3.0e0) - 4.0e0) * 0.1e0
       WHEN coalesce(rating, 3.0e0) <= 2.0e0 THEN 0.8e0 + (2.0e0 - coalesce(rating, 3.0e0)) * 0.1e0
       ELSE 0.75e0 END AS confidence_score
FROM ({FEEDBACK_SQL}) fb"""


def _modal_sql(col: str) -> str:
    return f"""SELECT product, {col}, n FROM (
  SELECT product, {col}, n, row_number() OVER (PARTITION BY product ORDER BY n DESC, {col}) AS rk
  FROM (SELECT product, {col}, CAST(count(*) AS BIGINT) AS n FROM facts WHERE {col} IS NOT NULL GROUP BY 1, 2) c) r
WHERE rk = 1"""


_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY product, polarity ORDER BY ranking_score DESC, id) AS rank FROM (
  SELECT product, id, text, {M1S} AS polarity,
    coalesce(confidence_score, 0.0e0) * 0.4e0
    + CASE WHEN helpfulness_denominator > 0
           THEN CAST(helpfulness_numerator AS DOUBLE) / helpfulness_denominator * 0.3e0 ELSE 0.0e0 END
    + greatest(0.0e0, 1.0e0 - {whole_days_between_sql('event_ts', f"TIMESTAMP '{AS_OF}'")} / 365.0e0) * 0.2e0
    + least(1.0e0, length(coalesce(text, '')) / 1000.0e0) * 0.1e0 AS ranking_score
  FROM facts) s WHERE polarity IS NOT NULL"""
_CTES = (("rv", REVIEW_ROWS_SQL), ("facts", _FACTS), *_kw_ctes(src="facts"))
#: Product descriptions: the modal one, else the key themes.
_THEMES = _THEMES_BODY.format(src="facts")

_SUMMARY = f"""SELECT product AS product_id, CAST(count(*) AS BIGINT) AS total_reviews,
  CAST(count_if({M1} = 'positive') AS BIGINT) AS positive_count,
  CAST(count_if({M1} = 'negative') AS BIGINT) AS negative_count,
  CAST(count_if({M1} = 'neutral') AS BIGINT) AS neutral_count,
  {pct_sql(f"count_if({M1} = 'positive')", 'count(*)')} AS positive_percentage,
  {pct_sql(f"count_if({M1} = 'negative')", 'count(*)')} AS negative_percentage,
  {pct_sql(f"count_if({M1} = 'neutral')", 'count(*)')} AS neutral_percentage,
  sum(coalesce(confidence_score, 0.0)) / count(*) AS avg_confidence
FROM facts GROUP BY product"""


def _scored(spark, sf):
    fb = N.reviews_to_feedback(N.drop_blank_text(review_rows(spark, sf)), AS_OF)
    return S.rating_scorer(fb.withColumn("score", F.get_json_object("metadata", "$.rating").cast("double")))


@register("BULK_import_product_summary", with_views(f"""
SELECT s.*, coalesce(md.product_description, th.product_description) AS product_description,
  coalesce(pk.kw, '') AS positive_keywords, CAST(least(10, coalesce(np.n, 0)) AS INTEGER) AS n_top_positive
FROM s LEFT JOIN th ON th.product_id = s.product_id LEFT JOIN md ON md.product = s.product_id
LEFT JOIN (SELECT product, string_agg(word, ',' ORDER BY rank) AS kw FROM kt WHERE polarity = 'positive'
           GROUP BY product) pk ON pk.product = s.product_id
LEFT JOIN (SELECT product, count(*) AS n FROM facts WHERE {M1S} = 'positive' GROUP BY product) np
  ON np.product = s.product_id""",
    *_CTES, ("th", _THEMES), ("md", _modal_sql("product_description")), ("s", _SUMMARY)), stable=("avg_confidence",))
def bulk(spark, sf):
    # as in the reference: store the scored rows (S6), then summarise from the fact table, so the
    # summary's branches read one columnar table instead of re-deriving and re-scoring each time
    path = scratch_path(spark, "bulk-import-facts")
    SK.write_results(_scored(spark, sf), path, by_date=False)
    summary = P.product_summary(RD.read_fact(spark, path), 10, AS_OF)
    return summary.select(
        "product_id", "total_reviews", "positive_count", "negative_count", "neutral_count",
        "positive_percentage", "negative_percentage", "neutral_percentage", "avg_confidence",
        "product_description", F.array_join("positive_keywords", ",").alias("positive_keywords"),
        F.size("top_positive_comments").alias("n_top_positive"))


# ---- J5 in full: every part of the summary in long form ---------------------------------------------
def _summary(spark, sf):
    return P.product_summary(_scored(spark, sf), 10, AS_OF)


@register("J5_top_comments", with_views(
    "SELECT product AS product_id, polarity, CAST(rank AS INTEGER) AS rank, id, text, ranking_score FROM rk WHERE rank <= 10",
    *_CTES, ("rk", _RANKED)), stable=("ranking_score",))
def j5_comments(spark, sf):
    lists = F.array(*[F.struct(F.lit(p).alias("polarity"), F.col(f"top_{p}_comments").alias("items")) for p in POLARITIES])
    return (_summary(spark, sf).select("product_id", F.inline(lists)).select("product_id", "polarity", F.inline("items"))
            .select("product_id", "polarity", "rank", "id", "text", "ranking_score"))


@register("J5_keywords", with_views("SELECT product AS product_id, polarity, rank AS position, word FROM kt", *_CTES))
def j5_keywords(spark, sf):
    lists = F.array(*[F.struct(F.lit(p).alias("polarity"), F.col(f"{p}_keywords").alias("items")) for p in POLARITIES])
    return (_summary(spark, sf).select("product_id", F.inline(lists)).select("product_id", "polarity", F.posexplode("items").alias("at", "word"))
            .select("product_id", "polarity", (F.col("at") + 1).alias("position"), "word"))


@register("J5_emotions", with_views("""SELECT product AS product_id, lower(sentiment_label) AS emotion, CAST(count(*) AS BIGINT) AS count
FROM facts GROUP BY 1, 2""", *_CTES))
def j5_emotions(spark, sf):
    return _summary(spark, sf).select("product_id", F.explode("emotion_counts").alias("emotion", "count"))


@register("J5_names", with_views("""
SELECT th.product_id, n.product_name, coalesce(md.product_description, th.product_description) AS product_description
FROM th LEFT JOIN n ON n.product = th.product_id LEFT JOIN md ON md.product = th.product_id""",
    *_CTES, ("th", _THEMES), ("n", _modal_sql("product_name")), ("md", _modal_sql("product_description"))))
def j5_names(spark, sf):
    return _summary(spark, sf).select("product_id", "product_name", "product_description")


@register("A11_modal_product_name", with_views(
    "SELECT product, product_name AS modal_name, n AS modal_name_count FROM n", *_CTES, ("n", _modal_sql("product_name"))))
def a11_name(spark, sf):
    named = _scored(spark, sf).withColumn("product_name", F.get_json_object("metadata", "$.product_name"))
    return P.modal_value(named, "product", "product_name", "modal_name")


# ---- time ranges over a written fact table --------------------------------------------------------------
_RANGE = ("2024-01-03 00:00:00", "2024-01-07 12:00:00")


@register("A6_timeseries_fact_table", with_views(f"""
SELECT CAST(date_trunc('day', event_ts) AS TIMESTAMP) AS time, team, product,
  CAST(count_if({M1} = 'positive') AS BIGINT) AS positive, CAST(count_if({M1} = 'neutral') AS BIGINT) AS neutral,
  CAST(count_if({M1} = 'negative') AS BIGINT) AS negative, CAST(count(*) AS BIGINT) AS total, avg(confidence_score) AS avg_confidence
FROM facts WHERE event_ts >= TIMESTAMP '{_RANGE[0]}' AND event_ts <= TIMESTAMP '{_RANGE[1]}' GROUP BY 1, 2, 3""", *_CTES),
    stable=("avg_confidence",))
def a6_fact(spark, sf):
    path = scratch_path(spark, "a6-facts")
    SK.write_results(_scored(spark, sf), path)
    return TS.sentiment_timeseries(RD.read_fact(spark, path), *_RANGE, "day")


# ---- quarantine of rejected rows (S10) ------------------------------------------------------------------
@register("S10_rejected_rows", with_views(
    f"SELECT Id, ProductId, Text FROM rv WHERE NOT coalesce(regexp_matches(Text, '[^{_WS}]'), false)", ("rv", REVIEW_ROWS_SQL)))
def s10_rejects(spark, sf):
    rows = review_rows(spark, sf)
    return SK.rejects(rows, N.has_text(F.col("Text"))).select("Id", "ProductId", "Text")
