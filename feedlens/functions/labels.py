"""Label vocabulary and the reference's polarity maps.

Each map is offered twice from the same constants: as a Spark ``Column`` and as SQL text (used by the
DuckDB oracle), so both engines classify identically.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values (must equal the reference) -------------------------------------------------
# Emotion labels of the default emotion model, in the model's order.
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
# M1 "catch-all" and M1s "strict" class lists (bulk import, metrics, products SQL, keywords).
M1_POSITIVE = ["joy", "positive", "label_2"]
M1_NEGATIVE = ["anger", "disgust", "fear", "sadness", "negative", "label_0"]
M1S_NEUTRAL = ["neutral", "surprise", "label_1"]
# M2 "suggestions" lists.
M2_POSITIVE = ["positive", "joy"]
M2_NEGATIVE = ["negative", "sadness", "disgust"]
# M3 "dashboard" lists (case-sensitive).
M3_POSITIVE = ["positive", "POSITIVE", "joy"]
M3_NEGATIVE = ["negative", "NEGATIVE", "sadness", "disgust"]
M3_NEUTRAL = ["neutral", "surprise"]
# Three-class names used by the model-metrics report.
CLASSES = ["Positive", "Negative", "Neutral"]
# ------------------------------------------------------------------------------------------------

POLARITIES = ["positive", "negative", "neutral"]

# scheme -> (positive list, negative list, neutral list or None for "everything else", lower-case?)
_SCHEMES = {
    "m1": (M1_POSITIVE, M1_NEGATIVE, None, True),
    "m1s": (M1_POSITIVE, M1_NEGATIVE, M1S_NEUTRAL, True),
    "m2": (M2_POSITIVE, M2_NEGATIVE, None, True),
    "m3": (M3_POSITIVE, M3_NEGATIVE, M3_NEUTRAL, False),
}


def polarity(label: Column | str, scheme: str = "m1") -> Column:
    """Positive / negative / neutral (NULL for labels outside a strict map)."""
    pos, neg, neu, lower = _SCHEMES[scheme]
    c = F.col(label) if isinstance(label, str) else label
    if lower:
        c = F.lower(c)
    expr = F.when(c.isin(pos), "positive").when(c.isin(neg), "negative")
    if neu is None:
        return expr.otherwise("neutral")
    return expr.when(c.isin(neu), "neutral")


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def polarity_sql(label: str, scheme: str = "m1") -> str:
    """The same map as SQL text (ANSI CASE) for oracle queries."""
    pos, neg, neu, lower = _SCHEMES[scheme]
    c = f"lower({label})" if lower else label
    tail = "ELSE 'neutral'" if neu is None else f"WHEN {c} IN ({_sql_list(neu)}) THEN 'neutral'"
    return (f"CASE WHEN {c} IN ({_sql_list(pos)}) THEN 'positive' "
            f"WHEN {c} IN ({_sql_list(neg)}) THEN 'negative' {tail} END")


def is_polarity_sql(label: str, which: str, scheme: str = "m1") -> str:
    return f"({polarity_sql(label, scheme)}) = '{which}'"


def count_polarity(label: Column | str, which: str, scheme: str = "m1") -> Column:
    """Number of rows of one polarity (for use inside ``agg``)."""
    return F.count_if(polarity(label, scheme) == F.lit(which))


def count_polarity_weighted(label: Column | str, which: str, scheme: str, rows: str) -> Column:
    """Like ``count_polarity`` over rows that stand for ``rows`` rows each."""
    return F.sum(F.when(polarity(label, scheme) == F.lit(which), F.col(rows)).otherwise(0))


def three_class(label: Column | str) -> Column:
    """Metrics classifier: M1 with a NULL label read as neutral; capitalised class names."""
    c = F.col(label) if isinstance(label, str) else label
    c = F.lower(F.coalesce(c, F.lit("neutral")))
    return (F.when(c.isin(M1_POSITIVE), "Positive")
            .when(c.isin(M1_NEGATIVE), "Negative").otherwise("Neutral"))


def three_class_sql(label: str) -> str:
    c = f"lower(coalesce({label}, 'neutral'))"
    return (f"CASE WHEN {c} IN ({_sql_list(M1_POSITIVE)}) THEN 'Positive' "
            f"WHEN {c} IN ({_sql_list(M1_NEGATIVE)}) THEN 'Negative' ELSE 'Neutral' END")


def sql_list(values: list[str]) -> str:
    return _sql_list(values)
