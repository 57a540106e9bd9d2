"""Registered streaming queries T1–T3, each drained with ``availableNow`` into a table and
compared with the batch SQL of what a closed-window stream must have emitted."""

from __future__ import annotations


from ..functions.labels import polarity_sql
from ..functions.numeric import pct_sql
from ..operators.scoring import lexicon_scorer_sql
from ..sources import fixtures as fx, readers as RD
from ..session import scratch_path
from ..sources.derived import REVIEW_ROWS_SQL, review_rows
from ..streaming import streams as ST
from .normalize_q import AS_OF, FEEDBACK_SQL
from .oracle import with_views
from .registry import register

_LABEL, _CONF = lexicon_scorer_sql("text")
M1 = polarity_sql("sentiment_label", "m1")


def _docs_stream(spark, sf):
    d = ST.stream_table(spark, sf, "documents").select("doc_id", "text", "source").alias("d")
    exprs = [e.format(ts0="TIMESTAMP_NTZ'2024-01-01 00:00:00'") for e in fx.DOCS_EXPRS]
    return d.selectExpr(*exprs)


@register("T1_stream_scoring", with_views(f"""
SELECT id, text, sentiment_label, confidence_score, event_ts, team, product FROM (
  SELECT *, {_LABEL} AS sentiment_label, {_CONF} AS confidence_score FROM f) x""",
    ("rv", REVIEW_ROWS_SQL), ("f", FEEDBACK_SQL)))
def t1(spark, sf):
    base = scratch_path(spark, "t1-facts")
    reviews = review_rows(spark, sf, ST.stream_table(spark, sf, "documents"))
    ST.stream_reviews(reviews, f"{base}/table", f"{base}/checkpoint", AS_OF).trigger(availableNow=True).start().awaitTermination()
    return RD.read_fact(spark, f"{base}/table", ["id", "text", "sentiment_label", "confidence_score", "event_ts", "team", "product"])


def _t2_sql(unit: str, step: str) -> str:
    return with_views(f"""
SELECT CAST(date_trunc('{unit}', event_ts) AS TIMESTAMP) AS time, team, product,
  CAST(count_if({M1} = 'positive') AS BIGINT) AS positive, CAST(count_if({M1} = 'neutral') AS BIGINT) AS neutral,
  CAST(count_if({M1} = 'negative') AS BIGINT) AS negative, CAST(count(*) AS BIGINT) AS total,
  avg(confidence_score) AS avg_confidence
FROM feedback_events
WHERE date_trunc('{unit}', event_ts) + INTERVAL {step}
      <= (SELECT max(event_ts) FROM feedback_events) - INTERVAL 1 HOUR
GROUP BY 1, 2, 3""")


def _t2(unit: str):
    def build(spark, sf):
        ev = ST.stream_table(spark, sf, "events").selectExpr(*fx.EVENTS_EXPRS)
        return ST.run_to_table(spark, ST.stream_timeseries(ev, unit, "1 hour"), f"t2-timeseries-{unit}")
    return build


for _unit, _step in (("hour", "1 HOUR"), ("day", "1 DAY"), ("week", "7 DAY")):
    register(f"T2_stream_timeseries_{_unit}", _t2_sql(_unit, _step), stable=("avg_confidence",))(_t2(_unit))


def _t3_sql(share: float) -> str:
    return with_views(f"""
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, product, total, negative,
  {pct_sql('negative', 'total')} AS negative_percentage FROM (
  SELECT window_start, product, CAST(count(*) AS BIGINT) AS total, CAST(count_if({M1} = 'negative') AS BIGINT) AS negative
  FROM (SELECT *, CAST(date_trunc('day', event_ts) AS TIMESTAMP) - k * INTERVAL 1 DAY AS window_start
        FROM feedback_docs, range(0, 7) r(k) WHERE product IS NOT NULL AND product <> '') x
  WHERE window_start + INTERVAL 7 DAY <= (SELECT max(event_ts) FROM feedback_docs) - INTERVAL 1 DAY
  GROUP BY 1, 2) g
WHERE total >= 3 AND {pct_sql('negative', 'total')} >= {share}""")


def _t3(share: float):
    def build(spark, sf):
        out = ST.stream_spikes(_docs_stream(spark, sf), 7, 1, "1 day", min_rows=3, min_pct=share)
        return ST.run_to_table(spark, out, "t3-spikes")
    return build


register("T3_stream_spikes", _t3_sql(50.0))(_t3(50.0))
register("T3_stream_spikes_70", _t3_sql(70.0))(_t3(70.0))          # the alert rule's own share
