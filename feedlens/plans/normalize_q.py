"""Registered normalisation queries (P1–P6, P8–P15) over review rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import polarity_sql, sql_list, M3_NEGATIVE, M3_NEUTRAL, M3_POSITIVE
from ..operators import normalize as N
from ..operators.profile import label_distribution
from ..sources.derived import REVIEW_ROWS_SQL, review_rows
from ..sources.fixtures import feedback_docs, feedback_events
from .oracle import with_views
from .registry import register

AS_OF = "2024-06-01 00:00:00"
_RV = ("rv", REVIEW_ROWS_SQL)

_NUMBER = "[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_TIME_SQL = f"""coalesce(
    CASE WHEN regexp_full_match(trim(Time), '{_NUMBER}')
           THEN CASE WHEN CAST(trim(Time) AS DOUBLE) >= -62135596800 AND CAST(trim(Time) AS DOUBLE) < 253402300800
                     THEN make_timestamp(CAST(CAST(trim(Time) AS DOUBLE) * 1000000 AS BIGINT)) END
         WHEN regexp_matches(trim(Time), '[zZ]$') THEN TRY_CAST(regexp_replace(trim(Time), '[zZ]$', '') AS TIMESTAMP)
         ELSE TRY_CAST(trim(Time) AS TIMESTAMP) END,
    TIMESTAMP '{AS_OF}')"""
_WS = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: Normalised rows of the non-blank reviews ``rv`` (P1–P8), metadata fields as columns.
FEEDBACK_SQL = f"""SELECT TRY_CAST(Id AS BIGINT) AS id, Text AS text, {_TIME_SQL} AS event_ts,
  nullif(Customer_Type, '') AS team, coalesce(nullif(ProductId, ''), 'unknown') AS product, Score AS rating,
  HelpfulnessNumerator AS helpfulness_numerator, HelpfulnessDenominator AS helpfulness_denominator,
  nullif(ProductName, '') AS product_name, nullif(ProductDescription, '') AS product_description
FROM rv WHERE regexp_matches(Text, '[^{_WS}]')"""

_P1_SQL = with_views(f"""
SELECT TRY_CAST(Id AS BIGINT) AS id, CAST(length(Text) AS INTEGER) AS text_length,
  {_TIME_SQL} AS event_ts,
  nullif(Customer_Type, '') AS team, coalesce(nullif(ProductId, ''), 'unknown') AS product,
  Score AS rating,
  CASE WHEN Score >= 4 THEN 'positive' WHEN Score <= 2 THEN 'negative' WHEN Score IS NOT NULL THEN 'neutral' END
    AS expected_sentiment,
  nullif(Id, '') AS review_id, nullif(UserId, '') AS user_id, nullif(ProfileName, '') AS profile_name,
  HelpfulnessNumerator AS helpfulness_numerator,
  CAST((Score IS NOT NULL)::INT * 2 + (nullif(Id, '') IS NOT NULL)::INT + (nullif(UserId, '') IS NOT NULL)::INT
     + (nullif(ProfileName, '') IS NOT NULL)::INT + (nullif(Summary, '') IS NOT NULL)::INT
     + (HelpfulnessNumerator IS NOT NULL)::INT + (HelpfulnessDenominator IS NOT NULL)::INT
     + (nullif(Suggestions, '') IS NOT NULL)::INT + (nullif(ProductName, '') IS NOT NULL)::INT
     + (nullif(ProductDescription, '') IS NOT NULL)::INT AS INTEGER) AS n_metadata_keys,
  nullif(ProductName, '') AS product_name, nullif(ProductDescription, '') AS product_description
FROM rv""", _RV)


@register("P1_reviews_to_feedback", _P1_SQL)
def p1(spark, sf):
    fb = N.reviews_to_feedback(review_rows(spark, sf), AS_OF)
    m = F.col("metadata")
    return fb.select(
        "id", F.length("text").alias("text_length"), "event_ts", "team", "product",
        F.get_json_object(m, "$.rating").cast("double").alias("rating"),
        F.get_json_object(m, "$.expected_sentiment").alias("expected_sentiment"),
        F.get_json_object(m, "$.review_id").alias("review_id"),
        F.get_json_object(m, "$.user_id").alias("user_id"),
        F.get_json_object(m, "$.profile_name").alias("profile_name"),
        F.get_json_object(m, "$.helpfulness_numerator").cast("int").alias("helpfulness_numerator"),
        F.size(F.json_object_keys(m)).alias("n_metadata_keys"),
        F.get_json_object(m, "$.product_name").alias("product_name"),
        F.get_json_object(m, "$.product_description").alias("product_description"))


@register("P8_nonblank_reviews", with_views(
    f"SELECT CAST(count(*) AS BIGINT) AS kept FROM rv WHERE regexp_matches(Text, '[^{_WS}]')", _RV))
def p8(spark, sf):
    return N.drop_blank_text(review_rows(spark, sf)).agg(F.count(F.lit(1)).alias("kept"))


@register("P9_review_defaults", with_views("""
SELECT Id, coalesce(Score, 3.0e0) AS Score, coalesce(HelpfulnessNumerator, 0) AS HelpfulnessNumerator,
  coalesce(HelpfulnessDenominator, 0) AS HelpfulnessDenominator, coalesce(Customer_Type, 'Normal') AS Customer_Type
FROM rv""", _RV))
def p9(spark, sf):
    return N.fill_review_defaults(review_rows(spark, sf)).select(
        "Id", "Score", "HelpfulnessNumerator", "HelpfulnessDenominator", "Customer_Type")


@register("P10_resolve_columns", with_views(
    "SELECT Id, ProductId, Text, Score, CAST(NULL AS VARCHAR) AS Missing FROM rv", _RV))
def p10(spark, sf):
    r = review_rows(spark, sf)
    lowered = r.toDF(*[c.lower() for c in r.columns])
    return N.resolve_columns(lowered, ["Id", "ProductId", "Text", "Score", "Missing"])


@register("P11_helpfulness_text", with_views(
    "SELECT Id, concat_ws('/', CAST(HelpfulnessNumerator AS VARCHAR), CAST(HelpfulnessDenominator AS VARCHAR)) "
    "AS helpfulness FROM rv", _RV))
def p11(spark, sf):
    r = review_rows(spark, sf)
    return r.select("Id", N.helpfulness_text(F.col("HelpfulnessNumerator"),
                                             F.col("HelpfulnessDenominator")).alias("helpfulness"))


_LABELS = ("lb", "SELECT sentiment_label FROM feedback_events UNION ALL SELECT sentiment_label FROM feedback_docs")


def _labels_df(spark, sf):
    return feedback_events(spark, sf).select("sentiment_label").unionByName(
        feedback_docs(spark, sf, with_rating=False).select("sentiment_label"))


@register("P12_P14_label_maps", with_views(f"""
SELECT sentiment_label, CAST(count(*) AS BIGINT) AS count, lower(sentiment_label) AS label_lower,
  {polarity_sql('sentiment_label', 'm1')} AS m1, {polarity_sql('sentiment_label', 'm1s')} AS m1s,
  {polarity_sql('sentiment_label', 'm2')} AS m2, {polarity_sql('sentiment_label', 'm3')} AS m3
FROM lb GROUP BY sentiment_label""", _LABELS))
def p12(spark, sf):
    return N.label_maps(_labels_df(spark, sf))


@register("P15_dashboard_polarity", with_views(f"""
SELECT CAST(sum(CASE WHEN sentiment_label IN ({sql_list(M3_POSITIVE)}) THEN n ELSE 0 END) AS BIGINT) AS positive,
  CAST(sum(CASE WHEN sentiment_label IN ({sql_list(M3_NEGATIVE)}) THEN n ELSE 0 END) AS BIGINT) AS negative,
  CAST(sum(CASE WHEN sentiment_label IN ({sql_list(M3_NEUTRAL)}) THEN n ELSE 0 END) AS BIGINT) AS neutral,
  CAST(sum(n) AS BIGINT) AS total
FROM (SELECT sentiment_label, count(*) AS n FROM lb GROUP BY 1) d""", _LABELS))
def p15(spark, sf):
    return N.dashboard_polarity(label_distribution(_labels_df(spark, sf)))
