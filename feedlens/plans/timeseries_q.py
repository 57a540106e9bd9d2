"""Registered time-series queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.labels import EMOTIONS, polarity_sql
from ..functions.timefns import bucket_sql
from ..operators import rollups as RU, timeseries as TS
from ..session import scratch_path
from ..sources import layout, readers as RD, sinks as SK
from ..sources.fixtures import feedback_events
from .oracle import with_views
from .registry import register

START, END = "2024-01-05 00:00:00", "2024-01-25 12:00:00"
_WHERE = f"event_ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


def _a6_sql(unit: str, where: str = "TRUE") -> str:
    pol = polarity_sql("sentiment_label", "m1")
    return f"""SELECT {bucket_sql('event_ts', unit)} AS time, team, product,
  CAST(count_if({pol} = 'positive') AS BIGINT) AS positive,
  CAST(count_if({pol} = 'neutral') AS BIGINT) AS neutral,
  CAST(count_if({pol} = 'negative') AS BIGINT) AS negative,
  CAST(count(*) AS BIGINT) AS total, avg(confidence_score) AS avg_confidence
FROM feedback_events WHERE {where} GROUP BY 1, 2, 3"""


@register("A5_label_buckets_hour", with_views(f"""
SELECT {bucket_sql('event_ts', 'hour')} AS time, sentiment_label, team, product,
       CAST(count(*) AS BIGINT) AS count, avg(confidence_score) AS avg_confidence
FROM feedback_events WHERE {_WHERE} GROUP BY 1, 2, 3, 4"""), stable=('avg_confidence',))
def a5(spark, sf):
    return TS.label_buckets(feedback_events(spark, sf), START, END, "hour")


@register("A6_timeseries_hour", with_views(_a6_sql("hour", _WHERE)), stable=('avg_confidence',))
def a6h(spark, sf):
    return TS.sentiment_timeseries(feedback_events(spark, sf), START, END, "hour")


@register("A6_timeseries_day_all", with_views(_a6_sql("day")), stable=('avg_confidence',))
def a6d(spark, sf):
    return TS.sentiment_timeseries(feedback_events(spark, sf), None, None, "day")


@register("A6_timeseries_week_team", with_views(_a6_sql("week", "team = 'Premium'")), stable=('avg_confidence',))
def a6w(spark, sf):
    return TS.sentiment_timeseries(feedback_events(spark, sf), None, None, "week", team="Premium")


@register("A7_emotion_timeseries_day", with_views(
    f"SELECT {bucket_sql('event_ts', 'day')} AS time, "
    + ", ".join(f"CAST(count_if(lower(sentiment_label) = '{e}') AS BIGINT) AS {e}" for e in EMOTIONS)
    + ", CAST(count(*) AS BIGINT) AS total FROM feedback_events GROUP BY 1"))
def a7(spark, sf):
    return TS.emotion_timeseries(feedback_events(spark, sf), None, None, "day")


@register("A8_timeseries_summary", with_views(f"""
SELECT CAST(sum(total) AS BIGINT) AS total_feedback, CAST(sum(positive) AS BIGINT) AS positive_count,
  CAST(sum(negative) AS BIGINT) AS negative_count, CAST(sum(neutral) AS BIGINT) AS neutral_count,
  round_even(CASE WHEN sum(total) > 0 THEN CAST(sum(positive) AS DOUBLE) / sum(total) * 100.0 ELSE 0.0 END, 2) AS positive_percentage,
  round_even(CASE WHEN sum(total) > 0 THEN CAST(sum(negative) AS DOUBLE) / sum(total) * 100.0 ELSE 0.0 END, 2) AS negative_percentage,
  round_even(CASE WHEN sum(total) > 0 THEN CAST(sum(neutral) AS DOUBLE) / sum(total) * 100.0 ELSE 0.0 END, 2) AS neutral_percentage,
  round_even(avg(avg_confidence), 3) AS average_confidence,
  round_even(sum(avg_confidence * total) / sum(total), 3) AS weighted_confidence
FROM ({_a6_sql('day', _WHERE + " AND product = 'P7'")}) s"""))
def a8(spark, sf):
    return TS.timeseries_summary(feedback_events(spark, sf), START, END, product="P7")


@register("J1_top_products_timeseries", with_views(_a6_sql("day", f"""product IN (
  SELECT product FROM feedback_events WHERE product IS NOT NULL AND product <> 'unknown'
  GROUP BY product ORDER BY count(*) DESC, product LIMIT 5)""")), stable=('avg_confidence',))
def j1(spark, sf):
    return TS.products_timeseries(feedback_events(spark, sf), None, limit=5, group_by="day")


@register("J2_product_timeseries", with_views(_a6_sql("hour", _WHERE + " AND product = 'P3'")), stable=('avg_confidence',))
def j2(spark, sf):
    return TS.product_timeseries(feedback_events(spark, sf), "P3", START, END, "hour")


@register("A32_daily_trend", with_views(f"""
SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS day, CAST(sum(positive) AS BIGINT) AS positive,
  CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(negative) AS BIGINT) AS negative,
  CAST(sum(total) AS BIGINT) AS total
FROM ({_a6_sql('hour')}) s GROUP BY 1"""))
def a32(spark, sf):
    return TS.trend(TS.sentiment_timeseries(feedback_events(spark, sf), None, None, "hour"))


@register("R8_chart_series", with_views(f"""
SELECT time, team, product, series, value FROM ({_a6_sql('day')}) s
UNPIVOT (value FOR series IN (positive, neutral, negative, total))"""))
def r8(spark, sf):
    return TS.chart_series(TS.sentiment_timeseries(feedback_events(spark, sf), None, None, "day"))


# A fact table that grows: most days first, then late rows of old days together with the newest days.
SPLIT = "2024-01-20 00:00:00"
ODD_START, ODD_END = "2024-01-03 10:30:00", "2024-01-27 05:15:30"
_ODD = f"event_ts BETWEEN TIMESTAMP '{ODD_START}' AND TIMESTAMP '{ODD_END}'"


def _grown_view(spark, sf, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    facts, view = f"{base}/facts", f"{base}/view"
    rows = feedback_events(spark, sf)
    early = (F.col("event_ts") < F.lit(SPLIT).cast("timestamp_ntz")) & (F.col("id") % 500 != 0)
    SK.write_results(rows.where(early), facts)
    RU.refresh(spark, facts, view)
    SK.write_results(rows.where(~early), facts)
    RU.refresh(spark, facts, view)
    return facts, view


@register("A6_incremental_series_day", with_views(_a6_sql("day")), stable=('avg_confidence',))
def a6_incremental(spark, sf):
    facts, view = _grown_view(spark, sf, "a6-incremental")
    return RU.sentiment_timeseries(RU.pieces(spark, facts, view, unit="day"), "day")


@register("A6_incremental_series_week_range", with_views(_a6_sql("week", _ODD)), stable=('avg_confidence',))
def a6_incremental_week(spark, sf):
    facts, view = _grown_view(spark, sf, "a6-incremental-week")
    return RU.sentiment_timeseries(RU.pieces(spark, facts, view, ODD_START, ODD_END, "week"), "week")


@register("A5_incremental_label_buckets_hour", with_views(f"""
SELECT {bucket_sql('event_ts', 'hour')} AS time, sentiment_label, team, product,
       CAST(count(*) AS BIGINT) AS count, avg(confidence_score) AS avg_confidence
FROM feedback_events WHERE {_ODD} GROUP BY 1, 2, 3, 4"""), stable=('avg_confidence',))
def a5_incremental(spark, sf):
    facts, view = _grown_view(spark, sf, "a5-incremental")
    return RU.label_buckets(RU.pieces(spark, facts, view, ODD_START, ODD_END, "hour"), "hour")


@register("J2_product_timeseries_compacted", with_views(_a6_sql("hour", _WHERE + " AND product = 'P3'")), stable=('avg_confidence',))
def j2_compacted(spark, sf):
    """The series of one product from a table that five imports left in many files and a compaction clustered."""
    path = scratch_path(spark, "j2-compacted")
    rows = feedback_events(spark, sf)
    for k in range(5):
        layout.write_clustered(rows.where(F.pmod("id", F.lit(5)) == k), path)
    layout.compact(spark, path)
    return TS.product_timeseries(RD.read_fact(spark, path), "P3", START, END, "hour")
