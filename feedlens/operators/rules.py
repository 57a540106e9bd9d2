"""Rule sets over aggregates: suggestions (R2), alerts (R3), insights (R1), escalations (R4),
volume leaders (R5), dashboard (R7) and their bases A12–A14, A20–A22, J4, U4, W4–W6.

Every rule is a column predicate over one aggregate row, so a rule set costs the aggregate(s) it
reads: alerts fuse the all-time (A20) and recent-window (A21) bases into one ``groupBy(product)``
and emit all alert kinds from that row with ``inline`` (no union of re-scans; the J4
"no critical alert yet" anti-lookup becomes a predicate on the same row).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import count_polarity, polarity
from ..functions.numeric import pct, py_fixed_text, py_percent_text, py_round, ratio
from ..functions.timefns import ntz
from . import filters
from .products import product_rollup, products_page
from .profile import statistics
from .timeseries import sentiment_timeseries

# ---- fixed values (must equal the reference) -------------------------------------------------
PRIORITY_RANK = {"high": 3, "medium": 2, "low": 1}
SEVERITY_RANK = {"critical": 3, "warning": 2, "info": 1}

# Suggestions: category, priority, title, description, action items.  {ratio} renders as "12.3%".
SUGGEST_QUALITY = ("Quality Improvement", "high", "Address Quality Concerns",
                   "High negative sentiment detected ({ratio}). Consider reviewing product quality "
                   "and customer service processes.",
                   ["Review recent negative feedback for common issues",
                    "Implement quality control measures",
                    "Improve customer service response time"])
SUGGEST_MARKETING = ("Marketing Opportunity", "medium", "Leverage Positive Feedback",
                     "High positive sentiment ({ratio}) presents marketing opportunities.",
                     ["Feature positive reviews in marketing materials",
                      "Encourage satisfied customers to leave reviews",
                      "Create case studies from positive feedback"])
SUGGEST_PRODUCT_FIX = ("Product Improvement", "high", "Improve {subject}",
                       "{subject} shows high negative sentiment ({ratio}). Immediate attention required.",
                       ["Investigate specific issues with {subject}",
                        "Consider product redesign or discontinuation",
                        "Implement targeted customer support for this product"])
SUGGEST_PRODUCT_PROMOTE = ("Success Story", "low", "Promote {subject}",
                           "{subject} shows excellent sentiment ({ratio}). Consider featuring prominently.",
                           ["Feature {subject} in marketing campaigns",
                            "Analyze what makes this product successful",
                            "Apply learnings to other products"])
SUGGEST_RETENTION = ("Customer Retention", "medium", "Improve {subject} Customer Experience",
                     "{subject} customers show higher negative sentiment ({ratio}).",
                     ["Create targeted support program for {subject} customers",
                      "Survey this customer segment for specific pain points",
                      "Develop specialized offerings for this segment"])
SUGGEST_DEFAULT = ("General", "low", "Continue Monitoring",
                   "Current sentiment levels are stable. Continue monitoring for trends.",
                   ["Maintain current quality standards",
                    "Regular sentiment analysis reviews",
                    "Proactive customer feedback collection"])
# Suggestion thresholds: overall neg > 0.4 / pos > 0.7; product (>= 5 rows) neg > 0.5 else
# pos > 0.8; customer type (>= 10 rows) neg > 0.4.
OVERALL_NEG, OVERALL_POS = 0.4, 0.7
PRODUCT_MIN, PRODUCT_NEG, PRODUCT_POS = 5, 0.5, 0.8
TEAM_MIN, TEAM_NEG = 10, 0.4

# Alerts: titles and descriptions.  {pct} renders as "12.3", {conf} as "12.3%".
ALERT_NEGATIVE_TITLE = "High Negative Sentiment: {product}"
ALERT_NEGATIVE_TEXT = "{product} has {pct}% negative sentiment ({neg}/{total} reviews)"
ALERT_LOWCONF_TITLE = "Low Confidence Reviews: {product}"
ALERT_LOWCONF_TEXT = "{product} has reviews with confidence as low as {conf}. Manual review recommended."
ALERT_SPIKE_TITLE = "Escalation Spike: {product}"
ALERT_SPIKE_TEXT = ("{product} has {pct}% negative sentiment in the last {days} days "
                    "({neg}/{total} reviews)")
# Alert thresholds: base needs >= 3 rows; critical >= 60 %; warning >= negative_threshold;
# info when min confidence < 0.5; spike base >= 2 rows, fires at >= 70 % with >= 3 rows.
ALERT_MIN_ROWS, ALERT_CRITICAL_PCT, ALERT_LOW_CONF = 3, 60.0, 0.5
SPIKE_MIN_ROWS, SPIKE_FIRE_ROWS, SPIKE_PCT = 2, 3, 70.0

# Escalation severities by negative share (>= 60 Critical, >= 40 High, >= 20 Medium, else Low).
ESCALATION_LEVELS = [(60.0, "Critical"), (40.0, "High"), (20.0, "Medium")]
ESCALATION_DEFAULT = "Low"
# Insights: products with >= 3 reviews; positive ratio >= 0.7 "top", negative ratio >= 0.3 "attention".
INSIGHT_MIN, INSIGHT_POS, INSIGHT_NEG = 3, 0.7, 0.3
# ------------------------------------------------------------------------------------------------

DEFAULT_ORDER = 6       # the default suggestion comes last

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders of a fixed template with string columns."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def render_sql(template: str, **values: str) -> str:
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        parts.append(f"CAST({values[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    if pos < len(template):
        parts.append("'" + template[pos:].replace("'", "''") + "'")
    return "concat(" + ", ".join(parts) + ")"


# ---- W4: newest rows --------------------------------------------------------------------------
def newest(df: DataFrame, n: int | None) -> DataFrame:
    """The n most recent rows (ties by id); ``None`` keeps every row."""
    if n is None:
        return df
    return df.orderBy(F.col("event_ts").desc(), F.col("id").desc()).limit(n)


# ---- A12–A14: suggestion bases (M2) ------------------------------------------------------------
def _m2_counts():
    return [count_polarity("sentiment_label", "positive", "m2").alias("positive"),
            count_polarity("sentiment_label", "negative", "m2").alias("negative"),
            count_polarity("sentiment_label", "neutral", "m2").alias("neutral"),
            F.count(F.lit(1)).alias("total")]


def overall_m2(df: DataFrame) -> DataFrame:
    """Overall M2 counts and ratios (one row, also for empty input)."""
    g = df.agg(*_m2_counts())
    return g.withColumns({"positive_ratio": ratio(F.col("positive"), F.col("total")),
                          "negative_ratio": ratio(F.col("negative"), F.col("total"))})


def by_product_m2(df: DataFrame) -> DataFrame:
    """M2 counts per product (NULL product is its own group)."""
    return df.groupBy("product").agg(*_m2_counts())


def by_team_m2(df: DataFrame) -> DataFrame:
    """M2 counts per customer type; NULL and empty teams skipped."""
    return df.where(F.col("team").isNotNull() & (F.col("team") != "")).groupBy("team").agg(*_m2_counts())


def suggestion_groups(df: DataFrame) -> DataFrame:
    """A12–A14 in one pass: M2 counts for all rows, per product and per customer type in a single
    aggregate (``level`` = overall / product / team).  The three keys of a row are an inline array
    rather than grouping sets, whose shuffle Spark does not recognise as the same in a second use.

    One extra row that no count includes makes sure of an overall row for empty input."""
    extra = df.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in ("product", "team", "_m2")], F.lit(None).cast("int").alias("_real"))
    d = df.select("product", "team", polarity("sentiment_label", "m2").alias("_m2"), F.lit(1).alias("_real")).unionByName(extra)
    keys = F.array(*[F.struct(F.lit(level).alias("level"), key.alias("key")) for level, key in
                     (("overall", F.lit(None).cast("string")), ("product", F.col("product")), ("team", F.col("team")))])
    g = d.select("_m2", "_real", F.inline(keys)).groupBy("level", "key").agg(
        F.count(F.when(F.col("_m2") == "positive", 1)).alias("positive"),
        F.count(F.when(F.col("_m2") == "negative", 1)).alias("negative"),
        F.count(F.when(F.col("_m2") == "neutral", 1)).alias("neutral"),
        F.count("_real").alias("total"))
    return g.where((F.col("level") == "overall") | (F.col("total") > 0)).withColumns(
        {c: F.when(F.col("level") == c, F.col("key")) for c in ("product", "team")}).drop("key")


def _candidate(fire: Column, rule, subject: Column | None, ratio_col: Column, points: Column,
               order: int) -> Column:
    category, priority, title, text, actions = rule
    subj = subject if subject is not None else F.lit("")
    vals = {"subject": subj, "ratio": py_percent_text(ratio_col)}
    return F.struct(
        fire.alias("fire"), F.lit(category).alias("category"), F.lit(priority).alias("priority"),
        render(title, **vals).alias("title"), render(text, **vals).alias("description"),
        points.cast("long").alias("data_points"),
        F.array(*[render(a, **vals) for a in actions]).alias("action_items"),
        F.lit(PRIORITY_RANK[priority]).alias("priority_rank"), F.lit(order).alias("rule_order"),
        subj.alias("subject"))


def suggestions(df: DataFrame, sentiment: str | None = None, customer_type: str | None = None,
                product: str | None = None, max_rows: int | None = None) -> DataFrame:
    """R2 (+U4, W6): rule-based suggestions over the filtered rows (F8), all rule outputs in one list
    (U4), ordered by priority (W6).  ``max_rows`` restricts them to the newest rows (W4) on request.

    One aggregate yields the overall, per-product and per-customer-type rows; every
    rule is a candidate struct on its row and the fired ones are emitted with ``inline``.  The default
    "Continue Monitoring" row is a candidate of the overall row (there is one for empty input too) and
    goes again if any other rule fired.  The facts are read once.
    """
    d = newest(filters.with_all_sentinel(df, sentiment, customer_type, product), max_rows)
    g = suggestion_groups(d)
    lvl, tot = F.col("level"), F.col("total")
    nr, pr = ratio(F.col("negative"), tot), ratio(F.col("positive"), tot)
    prod_subj = F.coalesce(F.col("product"), F.lit("None"))
    is_prod = (lvl == "product") & (tot >= PRODUCT_MIN)
    is_team = (lvl == "team") & F.col("team").isNotNull() & (F.col("team") != "") & (tot >= TEAM_MIN)
    cands = F.array(
        _candidate((lvl == "overall") & (nr > OVERALL_NEG), SUGGEST_QUALITY, None, nr, F.col("negative"), 1),
        _candidate((lvl == "overall") & (pr > OVERALL_POS), SUGGEST_MARKETING, None, pr, F.col("positive"), 2),
        _candidate(is_prod & (nr > PRODUCT_NEG), SUGGEST_PRODUCT_FIX, prod_subj, nr, F.col("negative"), 3),
        _candidate(is_prod & ~(nr > PRODUCT_NEG) & (pr > PRODUCT_POS), SUGGEST_PRODUCT_PROMOTE, prod_subj,
                   pr, F.col("positive"), 4),
        _candidate(is_team & (nr > TEAM_NEG), SUGGEST_RETENTION, F.col("team"), nr, F.col("negative"), 5),
        _candidate(lvl == "overall", SUGGEST_DEFAULT, None, F.lit(0.0), tot, DEFAULT_ORDER))
    fired = g.select(F.inline(F.filter(cands, lambda c: c["fire"]))).drop("fire")
    # Whether anything else fired is a scalar over the same grouped rows, whose shuffle is reused.
    any_rule = g.agg(F.max(F.exists(F.slice(cands, 1, DEFAULT_ORDER - 1), lambda c: c["fire"]))).scalar()
    out = fired.where((F.col("rule_order") < DEFAULT_ORDER) | ~F.coalesce(any_rule, F.lit(False)))
    return out.orderBy(F.col("priority_rank").desc(), "rule_order", "subject")


# ---- A20–A21, J4, R3: alerts -------------------------------------------------------------------
def alert_base(df: DataFrame, as_of, spike_window_days: int = 7) -> DataFrame:
    """A20 + A21 fused: per non-empty product (F6) all-time and recent-window counts."""
    neg = polarity("sentiment_label", "m1") == "negative"
    recent = F.col("event_ts") >= ntz(as_of) - F.make_dt_interval(F.lit(spike_window_days))
    return filters.nonempty_product(df).groupBy("product").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(neg).alias("negative_count"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.min("confidence_score").alias("min_confidence"),
        F.count_if(recent).alias("recent_total"), F.count_if(recent & neg).alias("recent_negative"))


def alerts(df: DataFrame, negative_threshold: float = 40.0, spike_window_days: int = 7,
           as_of=None) -> DataFrame:
    """R3 (+J4, W6): critical / warning / info alerts per product and recent escalation spikes;
    a spike is raised only without a critical alert (J4); rows ordered by severity (W6).

    Output: type, title, description, product, metric, timestamp, severity order (W6).
    """
    b = alert_base(df, as_of, spike_window_days)
    neg_pct = pct(F.col("negative_count"), F.col("total"))
    rec_pct = pct(F.col("recent_negative"), F.col("recent_total"))
    in_base = F.col("total") >= ALERT_MIN_ROWS
    critical = in_base & (neg_pct >= ALERT_CRITICAL_PCT)
    warning = in_base & ~(neg_pct >= ALERT_CRITICAL_PCT) & (neg_pct >= F.lit(float(negative_threshold)))
    info = in_base & F.col("min_confidence").isNotNull() & (F.col("min_confidence") < ALERT_LOW_CONF)
    spike = ((F.col("recent_total") >= SPIKE_MIN_ROWS) & (F.col("recent_total") >= SPIKE_FIRE_ROWS)
             & (rec_pct >= SPIKE_PCT) & ~critical)          # J4: no critical alert for the product
    p = F.col("product")
    neg_vals = {"product": p, "pct": py_fixed_text(neg_pct), "neg": F.col("negative_count"),
                "total": F.col("total")}
    spike_vals = {"product": p, "pct": py_fixed_text(rec_pct), "neg": F.col("recent_negative"),
                  "total": F.col("recent_total"), "days": F.lit(str(spike_window_days))}

    def alert(fire, kind, title, text, metric):
        return F.struct(fire.alias("fire"), F.lit(kind).alias("type"), title.alias("title"),
                        text.alias("description"), metric.cast("double").alias("metric"))
    cands = F.array(
        alert(critical, "critical", render(ALERT_NEGATIVE_TITLE, product=p),
              render(ALERT_NEGATIVE_TEXT, **neg_vals), neg_pct),
        alert(warning, "warning", render(ALERT_NEGATIVE_TITLE, product=p),
              render(ALERT_NEGATIVE_TEXT, **neg_vals), neg_pct),
        alert(info, "info", render(ALERT_LOWCONF_TITLE, product=p),
              render(ALERT_LOWCONF_TEXT, product=p, conf=py_percent_text(F.col("min_confidence"))),
              F.col("min_confidence")),
        alert(spike, "critical", render(ALERT_SPIKE_TITLE, product=p),
              render(ALERT_SPIKE_TEXT, **spike_vals), rec_pct))
    out = b.select("product", F.inline(F.filter(cands, lambda a: a["fire"])))
    sev = F.when(F.col("type") == "critical", 3).when(F.col("type") == "warning", 2).otherwise(1)
    return (out.drop("fire").withColumns({"timestamp": ntz(as_of), "severity_rank": sev})
               .orderBy(F.col("severity_rank").desc(), "product", "title"))


def alert_summary(alert_rows: DataFrame) -> DataFrame:
    """R3 summary: number of alerts per type."""
    return alert_rows.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


# ---- A22, R4, R5: business view ---------------------------------------------------------------
def business_top(df: DataFrame, n: int = 20) -> DataFrame:
    """The n largest non-empty products with >= 3 rows: total, positive, negative, rank."""
    g = filters.nonempty_product(df).groupBy("product").agg(
        F.count(F.lit(1)).alias("total"),
        count_polarity("sentiment_label", "positive", "m1").alias("positive_count"),
        count_polarity("sentiment_label", "negative", "m1").alias("negative_count"))
    top = g.where(F.col("total") >= ALERT_MIN_ROWS).orderBy(F.col("total").desc(), "product").limit(n)
    w = Window.orderBy(F.col("total").desc(), "product")    # at most n rows in this window
    return top.withColumn("rank", F.row_number().over(w))


def escalations(df: DataFrame, n: int = 6) -> DataFrame:
    """Severity of the n largest products by negative share."""
    t = business_top(df, n)
    neg_pct = pct(F.col("negative_count"), F.col("total"))
    sev = F.lit(ESCALATION_DEFAULT)
    for bound, name in reversed(ESCALATION_LEVELS):
        sev = F.when(neg_pct >= bound, name).otherwise(sev)
    return t.select("rank", "product", "total", "negative_count",
                    neg_pct.alias("negative_percentage"), sev.alias("severity"))


def volume_leaders(df: DataFrame, n: int = 5) -> DataFrame:
    """Positives, negatives and rounded positive share of the n largest products."""
    t = business_top(df, n)
    share = F.when(F.col("total") > 0, F.col("positive_count") / F.col("total") * 100).otherwise(F.lit(50.0))
    return t.select("rank", "product", F.col("positive_count").alias("positive"),
                    F.col("negative_count").alias("negative"),
                    py_round(share, 0).cast("long").alias("sentiment"))


# ---- R1: insights ------------------------------------------------------------------------------
def _insight_base(df: DataFrame, limit: int | None) -> DataFrame:
    return product_rollup(df) if limit is None else products_page(df, limit=limit)


def insights(df: DataFrame, limit: int | None = None) -> DataFrame:
    """R1 (+W5): among all known products (or the ``limit`` largest), top (pos >= 0.7) and attention
    (neg >= 0.3) lists, five each, by score; ties go to the larger product, then by name.

    A product is a candidate of either list from its one rollup row; ranks are a window per list, which
    Spark limits to five rows per task before the shuffle.
    """
    q = _insight_base(df, limit).where(F.col("total_reviews") >= INSIGHT_MIN)

    def candidate(name, pct_col, bound):
        r = F.col(pct_col) / 100
        return F.struct((r >= bound).alias("fire"), F.lit(name).alias("list"), r.alias("ratio"), (r * 100).alias("score"))
    cands = F.array(candidate("top_products", "positive_percentage", INSIGHT_POS),
                    candidate("attention_products", "negative_percentage", INSIGHT_NEG))
    rows = q.select("product_id", "total_reviews", F.inline(F.filter(cands, lambda c: c["fire"]))).drop("fire")
    w = Window.partitionBy("list").orderBy(F.col("score").desc(), F.col("total_reviews").desc(), F.col("product_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5).select(
        "list", "rank", "product_id", "ratio", "total_reviews", "score")


def insight_counters(df: DataFrame, limit: int | None = None) -> DataFrame:
    """R1 counters: products analysed (all, or the ``limit`` largest), high performing, needing attention."""
    page = _insight_base(df, limit)
    ok = F.col("total_reviews") >= INSIGHT_MIN
    return page.agg(
        F.count(F.lit(1)).alias("total_products_analyzed"),
        F.count_if(ok & (F.col("positive_percentage") / 100 >= INSIGHT_POS)).alias("high_performing_products"),
        F.count_if(ok & (F.col("negative_percentage") / 100 >= INSIGHT_NEG)).alias("products_needing_attention"))


# ---- R7: dashboard -----------------------------------------------------------------------------
def dashboard(df: DataFrame, as_of, days: int = 30, top: int = 20) -> dict[str, DataFrame]:
    """Statistics (A1), daily trend over the last ``days`` days (A6), top products."""
    start, end = filters.default_window(as_of, days=days)
    return {"statistics": statistics(df),
            "recent_trends": sentiment_timeseries(df, start, end, "day"),
            "top_products": products_page(df, limit=top)}
