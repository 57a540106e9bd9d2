"""Registered rule queries: A12–A14, W4, R2 suggestions, A20/A21 + J4 + R3 alerts, A22, R4, R5,
R1 insights, R7 dashboard trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import polarity_sql
from ..functions.numeric import pct_sql, py_fixed_text_sql, py_percent_text_sql
from ..operators import rules as R
from ..operators.scoring import rating_scorer
from ..sources.fixtures import feedback_docs, feedback_events, feedback_orders
from .oracle import with_views
from .products_q import _rollup_select, _rollup_sql
from .registry import register

EV_AS_OF = "2024-01-31 00:00:00"
DOC_AS_OF = "2024-02-15 00:00:00"
M2 = polarity_sql("sentiment_label", "m2")
M1 = polarity_sql("sentiment_label", "m1")


def _m2_cols():
    return (f"CAST(count_if({M2} = 'positive') AS BIGINT) AS positive, "
            f"CAST(count_if({M2} = 'negative') AS BIGINT) AS negative, "
            f"CAST(count_if({M2} = 'neutral') AS BIGINT) AS neutral, CAST(count(*) AS BIGINT) AS total")


@register("A14_overall_m2", with_views(f"""
SELECT *, CASE WHEN total > 0 THEN CAST(positive AS DOUBLE) / total ELSE 0.0e0 END AS positive_ratio,
          CASE WHEN total > 0 THEN CAST(negative AS DOUBLE) / total ELSE 0.0e0 END AS negative_ratio
FROM (SELECT {_m2_cols()} FROM feedback_events) o"""))
def a14(spark, sf):
    return R.overall_m2(feedback_events(spark, sf))


@register("A12_product_m2", with_views(f"SELECT product, {_m2_cols()} FROM feedback_events GROUP BY product"))
def a12(spark, sf):
    return R.by_product_m2(feedback_events(spark, sf))


@register("A13_team_m2", with_views(
    f"SELECT team, {_m2_cols()} FROM feedback_events WHERE team IS NOT NULL AND team <> '' GROUP BY team"))
def a13(spark, sf):
    return R.by_team_m2(feedback_events(spark, sf))


@register("W4_newest_1000", with_views(
    "SELECT id, event_ts, sentiment_label FROM feedback_events ORDER BY event_ts DESC, id DESC LIMIT 1000"))
def w4(spark, sf):
    return R.newest(feedback_events(spark, sf), 1000).select("id", "event_ts", "sentiment_label")


def _sugg_sql(rule, src, where, subject, ratio, points, order):
    category, priority, title, text, actions = rule
    vals = {"subject": subject or "''", "ratio": py_percent_text_sql(ratio)}
    acts = " || ' | ' || ".join(R.render_sql(a, **vals) for a in actions)
    return (f"SELECT '{category}' AS category, '{priority}' AS priority, "
            f"{R.render_sql(title, **vals)} AS title, {R.render_sql(text, **vals)} AS description, "
            f"CAST({points} AS BIGINT) AS data_points, {acts} AS action_items, "
            f"{R.PRIORITY_RANK[priority]} AS priority_rank, {order} AS rule_order, "
            f"{subject or chr(39) * 2} AS subject FROM {src} WHERE {where}")


def _suggestions_sql(source: str) -> str:
    o = (f"SELECT *, CASE WHEN total > 0 THEN CAST(positive AS DOUBLE) / total ELSE 0.0e0 END AS pr, "
         f"CASE WHEN total > 0 THEN CAST(negative AS DOUBLE) / total ELSE 0.0e0 END AS nr "
         f"FROM (SELECT {_m2_cols()} FROM d) x")
    p = (f"SELECT coalesce(product, 'None') AS subj, *, CAST(negative AS DOUBLE) / total AS nr, "
         f"CAST(positive AS DOUBLE) / total AS pr FROM (SELECT product, {_m2_cols()} FROM d GROUP BY product) x "
         f"WHERE total >= {R.PRODUCT_MIN}")
    t = (f"SELECT team AS subj, *, CAST(negative AS DOUBLE) / total AS nr FROM (SELECT team, {_m2_cols()} "
         f"FROM d WHERE team IS NOT NULL AND team <> '' GROUP BY team) x WHERE total >= {R.TEAM_MIN}")
    fired = " UNION ALL ".join([
        _sugg_sql(R.SUGGEST_QUALITY, "o", f"nr > {R.OVERALL_NEG}", None, "nr", "negative", 1),
        _sugg_sql(R.SUGGEST_MARKETING, "o", f"pr > {R.OVERALL_POS}", None, "pr", "positive", 2),
        _sugg_sql(R.SUGGEST_PRODUCT_FIX, "p", f"nr > {R.PRODUCT_NEG}", "subj", "nr", "negative", 3),
        _sugg_sql(R.SUGGEST_PRODUCT_PROMOTE, "p", f"NOT (nr > {R.PRODUCT_NEG}) AND pr > {R.PRODUCT_POS}",
                  "subj", "pr", "positive", 4),
        _sugg_sql(R.SUGGEST_RETENTION, "t", f"nr > {R.TEAM_NEG}", "subj", "nr", "negative", 5),
    ])
    default = _sugg_sql(R.SUGGEST_DEFAULT, "o", "NOT EXISTS (SELECT 1 FROM fired)", None, "0.0e0", "total", 6)
    return with_views("SELECT * FROM fired UNION ALL " + default,
                      ("d", source), ("o", o), ("p", p), ("t", t), ("fired", fired))


def _flat_suggestions(df):
    return df.withColumn("action_items", F.array_join("action_items", " | "))


@register("R2_suggestions_all_rows", _suggestions_sql("SELECT * FROM feedback_events"))
def r2a(spark, sf):
    return _flat_suggestions(R.suggestions(feedback_events(spark, sf), max_rows=None))


@register("R2_suggestions_sadness_filter",
          _suggestions_sql("SELECT * FROM feedback_docs WHERE sentiment_label = 'sadness'"))
def r2b(spark, sf):
    return _flat_suggestions(R.suggestions(feedback_docs(spark, sf), sentiment="sadness", max_rows=None))


@register("R2_suggestions_newest_1000", _suggestions_sql(
    "SELECT * FROM feedback_events ORDER BY event_ts DESC, id DESC LIMIT 1000"))
def r2c(spark, sf):
    return _flat_suggestions(R.suggestions(feedback_events(spark, sf), max_rows=1000))


def _alerts_sql(src: str, as_of: str, threshold: float = 40.0, days: int = 7) -> str:
    recent = f"event_ts >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY"
    neg = f"{M1} = 'negative'"
    b = (f"SELECT product, count(*) AS total, count_if({neg}) AS negative_count, "
         f"min(confidence_score) AS min_confidence, count_if({recent}) AS recent_total, "
         f"count_if({recent} AND {neg}) AS recent_negative FROM {src} "
         f"WHERE product IS NOT NULL AND product <> '' GROUP BY product")
    x = (f"SELECT *, {pct_sql('negative_count', 'total')} AS neg_pct, "
         f"{pct_sql('recent_negative', 'recent_total')} AS rec_pct FROM b")
    crit = f"(total >= {R.ALERT_MIN_ROWS} AND neg_pct >= {R.ALERT_CRITICAL_PCT})"
    nv = {"product": "product", "pct": py_fixed_text_sql("neg_pct"), "neg": "negative_count", "total": "total"}
    sv = {"product": "product", "pct": py_fixed_text_sql("rec_pct"), "neg": "recent_negative",
          "total": "recent_total", "days": f"'{days}'"}

    def sel(kind, title, text, metric, rank, where):
        return (f"SELECT product, '{kind}' AS type, {title} AS title, {text} AS description, "
                f"CAST({metric} AS DOUBLE) AS metric, TIMESTAMP '{as_of}' AS timestamp, "
                f"{rank} AS severity_rank FROM x WHERE {where}")
    body = " UNION ALL ".join([
        sel("critical", R.render_sql(R.ALERT_NEGATIVE_TITLE, product="product"),
            R.render_sql(R.ALERT_NEGATIVE_TEXT, **nv), "neg_pct", 3, crit),
        sel("warning", R.render_sql(R.ALERT_NEGATIVE_TITLE, product="product"),
            R.render_sql(R.ALERT_NEGATIVE_TEXT, **nv), "neg_pct", 2,
            f"total >= {R.ALERT_MIN_ROWS} AND NOT (neg_pct >= {R.ALERT_CRITICAL_PCT}) AND neg_pct >= {threshold}"),
        sel("info", R.render_sql(R.ALERT_LOWCONF_TITLE, product="product"),
            R.render_sql(R.ALERT_LOWCONF_TEXT, product="product",
                         conf=py_percent_text_sql("min_confidence")), "min_confidence", 1,
            f"total >= {R.ALERT_MIN_ROWS} AND min_confidence IS NOT NULL AND min_confidence < {R.ALERT_LOW_CONF}"),
        sel("critical", R.render_sql(R.ALERT_SPIKE_TITLE, product="product"),
            R.render_sql(R.ALERT_SPIKE_TEXT, **sv), "rec_pct", 3,
            f"recent_total >= {R.SPIKE_MIN_ROWS} AND recent_total >= {R.SPIKE_FIRE_ROWS} "
            f"AND rec_pct >= {R.SPIKE_PCT} AND NOT {crit}"),
    ])
    return with_views(body, ("b", b), ("x", x))


@register("R3_alerts_events", _alerts_sql("feedback_events", EV_AS_OF))
def r3a(spark, sf):
    return R.alerts(feedback_events(spark, sf), as_of=EV_AS_OF)


@register("R3_alerts_docs", _alerts_sql("feedback_docs", DOC_AS_OF, 40.0, 7))
def r3b(spark, sf):
    return R.alerts(feedback_docs(spark, sf, with_rating=False), 40.0, 7, as_of=DOC_AS_OF)


@register("R3_alert_summary", with_views(
    "SELECT type, CAST(count(*) AS BIGINT) AS count FROM al GROUP BY type",
    ("al", _alerts_sql("feedback_docs", DOC_AS_OF))))
def r3s(spark, sf):
    return R.alert_summary(R.alerts(feedback_docs(spark, sf, with_rating=False), as_of=DOC_AS_OF))


def _a22(n: int):
    return ("a22", f"""SELECT product, total, positive_count, negative_count,
  CAST(row_number() OVER (ORDER BY total DESC, product) AS INTEGER) AS rank FROM (
  SELECT product, CAST(count(*) AS BIGINT) AS total,
         CAST(count_if({M1} = 'positive') AS BIGINT) AS positive_count,
         CAST(count_if({M1} = 'negative') AS BIGINT) AS negative_count
  FROM feedback_events WHERE product IS NOT NULL AND product <> '' GROUP BY product
  HAVING count(*) >= 3 ORDER BY total DESC, product LIMIT {n}) t""")


@register("A22_business_top", with_views("SELECT * FROM a22", _a22(20)))
def a22(spark, sf):
    return R.business_top(feedback_events(spark, sf))


def _r4_sql(n: int) -> str:
    return with_views(f"""
SELECT rank, product, total, negative_count, {pct_sql('negative_count', 'total')} AS negative_percentage,
  CASE WHEN {pct_sql('negative_count', 'total')} >= 60.0 THEN 'Critical'
       WHEN {pct_sql('negative_count', 'total')} >= 40.0 THEN 'High'
       WHEN {pct_sql('negative_count', 'total')} >= 20.0 THEN 'Medium' ELSE 'Low' END AS severity
FROM a22""", _a22(n))


def _r5_sql(n: int) -> str:
    return with_views("""
SELECT rank, product, positive_count AS positive, negative_count AS negative,
  CAST(round_even(CASE WHEN total > 0 THEN CAST(positive_count AS DOUBLE) / total * 100 ELSE 50.0e0 END, 0)
       AS BIGINT) AS sentiment
FROM a22""", _a22(n))


@register("R4_escalations", _r4_sql(6))
def r4(spark, sf):
    return R.escalations(feedback_events(spark, sf))


@register("R4_escalations_30", _r4_sql(30))
def r4_30(spark, sf):
    return R.escalations(feedback_events(spark, sf), 30)


@register("R5_volume_leaders", _r5_sql(5))
def r5(spark, sf):
    return R.volume_leaders(feedback_events(spark, sf))


@register("R5_volume_leaders_30", _r5_sql(30))
def r5_30(spark, sf):
    return R.volume_leaders(feedback_events(spark, sf), 30)


#: Line items scored by rating: some 200 products.
_ORDERS = ("orders_scored", """SELECT *, CASE WHEN score >= 4 THEN 'positive' WHEN score <= 2 THEN 'negative' ELSE 'neutral' END
  AS sentiment_label, 0.75e0 AS confidence_score FROM feedback_orders""")


def _scored_orders(spark, sf):
    return rating_scorer(feedback_orders(spark, sf))


def _insight_views(src: str):
    return (("page", _rollup_select(_rollup_sql(src, 1))),
            ("q", "SELECT *, positive_percentage / 100 AS pos_ratio, negative_percentage / 100 AS neg_ratio FROM page WHERE total_reviews >= 3"))


def _listing(name, r, bound):
    return (f"SELECT * FROM (SELECT '{name}' AS list, CAST(row_number() OVER (ORDER BY {r} * 100 DESC, total_reviews DESC, product_id) "
            f"AS INTEGER) AS rank, product_id, {r} AS ratio, total_reviews, {r} * 100 AS score FROM q WHERE {r} >= {bound}e0) z WHERE rank <= 5")


_R1 = _listing("top_products", "pos_ratio", R.INSIGHT_POS) + " UNION ALL " + _listing("attention_products", "neg_ratio", R.INSIGHT_NEG)
_R1_COUNTERS = f"""
SELECT CAST(count(*) AS BIGINT) AS total_products_analyzed,
  CAST(count_if(total_reviews >= 3 AND positive_percentage / 100 >= {R.INSIGHT_POS}e0) AS BIGINT)
    AS high_performing_products,
  CAST(count_if(total_reviews >= 3 AND negative_percentage / 100 >= {R.INSIGHT_NEG}e0) AS BIGINT)
    AS products_needing_attention FROM page"""


@register("R1_insights", with_views(_R1, *_insight_views("feedback_docs")))
def r1(spark, sf):
    return R.insights(feedback_docs(spark, sf, with_rating=False))


@register("R1_insights_orders", with_views(_R1, _ORDERS, *_insight_views("orders_scored")))
def r1_orders(spark, sf):
    return R.insights(_scored_orders(spark, sf))


@register("R1_insight_counters", with_views(_R1_COUNTERS, *_insight_views("feedback_docs")))
def r1c(spark, sf):
    return R.insight_counters(feedback_docs(spark, sf, with_rating=False))


@register("R1_insight_counters_orders", with_views(_R1_COUNTERS, _ORDERS, *_insight_views("orders_scored")))
def r1c_orders(spark, sf):
    return R.insight_counters(_scored_orders(spark, sf))


@register("R7_dashboard_statistics", with_views("""
SELECT CAST(count(*) AS BIGINT) AS total_analyses, CAST(count(DISTINCT CAST(event_ts AS DATE)) AS BIGINT) AS days_analyzed,
  avg(confidence_score) AS average_confidence, min(event_ts) AS first_analysis, max(event_ts) AS last_analysis
FROM feedback_events"""), stable=("average_confidence",))
def r7_statistics(spark, sf):
    return R.dashboard(feedback_events(spark, sf), EV_AS_OF)["statistics"]


@register("R7_dashboard_products", with_views(f"""
SELECT p.*, t.total, 20 < t.total AS has_more
FROM ({_rollup_select(_rollup_sql('feedback_events', 1))} ORDER BY total_reviews DESC, product_id LIMIT 20) p,
     (SELECT CAST(count(DISTINCT product) AS BIGINT) AS total FROM feedback_events WHERE product IS NOT NULL AND product <> 'unknown') t"""),
    stable=("avg_confidence",))
def r7_products(spark, sf):
    return R.dashboard(feedback_events(spark, sf), EV_AS_OF)["top_products"]


@register("R7_dashboard_trend", with_views(f"""
SELECT CAST(date_trunc('day', event_ts) AS TIMESTAMP) AS time, team, product,
  CAST(count_if({M1} = 'positive') AS BIGINT) AS positive, CAST(count_if({M1} = 'neutral') AS BIGINT) AS neutral,
  CAST(count_if({M1} = 'negative') AS BIGINT) AS negative, CAST(count(*) AS BIGINT) AS total,
  avg(confidence_score) AS avg_confidence
FROM feedback_events WHERE event_ts BETWEEN TIMESTAMP '{EV_AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{EV_AS_OF}'
GROUP BY 1, 2, 3"""), stable=('avg_confidence',))
def r7(spark, sf):
    return R.dashboard(feedback_events(spark, sf), EV_AS_OF)["recent_trends"]


@register("A20_A21_alert_base", with_views(f"""
SELECT product, CAST(count(*) AS BIGINT) AS total, CAST(count_if({M1} = 'negative') AS BIGINT) AS negative_count,
  avg(confidence_score) AS avg_confidence, min(confidence_score) AS min_confidence,
  CAST(count_if(event_ts >= TIMESTAMP '{EV_AS_OF}' - INTERVAL 7 DAY) AS BIGINT) AS recent_total,
  CAST(count_if(event_ts >= TIMESTAMP '{EV_AS_OF}' - INTERVAL 7 DAY AND {M1} = 'negative') AS BIGINT)
    AS recent_negative
FROM feedback_events WHERE product IS NOT NULL AND product <> '' GROUP BY product"""), stable=('avg_confidence',))
def a20(spark, sf):
    return R.alert_base(feedback_events(spark, sf), EV_AS_OF, 7)


@register("W5_top5_negative_ratio", with_views(f"""
SELECT product_id, negative_percentage / 100 AS ratio, total_reviews FROM (
  {_rollup_select(_rollup_sql('feedback_events', 3))}) r
ORDER BY negative_percentage / 100 DESC, total_reviews DESC, product_id LIMIT 5"""))
def w5(spark, sf):
    from ..operators.products import product_rollup
    r = product_rollup(feedback_events(spark, sf), min_reviews=3)
    return (r.select("product_id", (F.col("negative_percentage") / 100).alias("ratio"), "total_reviews")
             .orderBy(F.col("ratio").desc(), F.col("total_reviews").desc(), "product_id").limit(5))


@register("W7_ordered_series", with_views("""
SELECT CAST(date_trunc('day', event_ts) AS TIMESTAMP) AS time, CAST(count(*) AS BIGINT) AS total
FROM feedback_events GROUP BY 1 ORDER BY time"""))
def w7(spark, sf):
    from ..operators.timeseries import sentiment_timeseries, trend
    return trend(sentiment_timeseries(feedback_events(spark, sf), None, None, "day")) \
        .select(F.col("day").alias("time"), "total")


SPIKE_AS_OF = "2024-02-10 00:00:00"      # a two-day window late in the documents' time range


@register("J4_spikes_without_critical", with_views(
    "SELECT product, title, description, metric FROM al WHERE title LIKE 'Escalation Spike:%'",
    ("al", _alerts_sql("feedback_docs", SPIKE_AS_OF, 40.0, 2))))
def j4(spark, sf):
    a = R.alerts(feedback_docs(spark, sf, with_rating=False), 40.0, 2, as_of=SPIKE_AS_OF)
    return a.where(F.col("title").startswith("Escalation Spike:")).select("product", "title", "description",
                                                                        "metric")
