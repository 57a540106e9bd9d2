"""Model metrics against star ratings: A15–A19 and the zero-filled class grid J6.

Each fact row is reduced to (actual, predicted, confidence) and aggregated once into a single row of nine
conditional counts and the totals per predicted class; every metric is arithmetic on that row, expanded with
``inline``.  The facts are read once, nothing is joined and one row per task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metadata
from ..functions.labels import CLASSES, three_class
from ..functions.numeric import py_round
from ..operators.scoring import RATING_NEG_MAX, RATING_POS_MIN


def _capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def classified(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows with ``predicted`` (M1, NULL label -> Neutral) and ``actual`` class.

    actual = capitalised metadata ``expected_sentiment`` when non-empty, else the rating class
    (>=4 Positive, <=2 Negative, else Neutral); rows whose actual is not a class get NULL.
    ``max_rows`` keeps only the newest rows (the reference evaluates the newest 5000).
    """
    if max_rows is not None:
        df = df.orderBy(F.col("event_ts").desc(), F.col("id").desc()).limit(max_rows)
    cols = set(df.columns)
    expected = (metadata.field(df, "expected_sentiment") if "metadata" in cols
                else F.lit(None).cast("string"))
    rating = F.col("rating").cast("double") if "rating" in cols else \
        metadata.field(df, "rating", "double")
    by_rating = (F.when(rating >= RATING_POS_MIN, "Positive").when(rating <= RATING_NEG_MAX, "Negative")
                 .when(rating.isNotNull(), "Neutral"))
    actual = F.when(F.coalesce(expected, F.lit("")) != "", _capitalize(expected)).otherwise(by_rating)
    return df.select(
        F.when(actual.isin(CLASSES), actual).alias("actual"),
        three_class("sentiment_label").alias("predicted"),
        F.coalesce(F.col("confidence_score"), F.lit(0.0)).alias("confidence"))


def _cell(actual: str, predicted: str) -> Column:
    return F.count_if((F.col("actual") == actual) & (F.col("predicted") == predicted))


def metric_row(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One row with everything A15–A19 need: the nine confusion cells (``n_<actual>_<predicted>``, J6:
    zero when empty), rows per predicted class and the sum of their confidences.  Always one row."""
    c = classified(df, max_rows)
    cells = [_cell(a, p).alias(f"n_{a}_{p}") for a in CLASSES for p in CLASSES]
    cells += [F.count_if(F.col("predicted") == p).alias(f"rows_{p}") for p in CLASSES]
    cells += [F.avg(F.when(F.col("predicted") == p, F.col("confidence"))).alias(f"conf_{p}") for p in CLASSES]
    return c.agg(*cells)


def _n(actual: str, predicted: str) -> Column:
    return F.col(f"n_{actual}_{predicted}")


def _total(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _per_class(cls: str) -> dict[str, Column]:
    """Rounded precision, recall and F1 (x100, 1 dp, half-even) and the support of one class."""
    tp, support = _n(cls, cls), _total([_n(cls, p) for p in CLASSES])
    precision, recall = _share(tp, _total([_n(a, cls) for a in CLASSES])), _share(tp, support)
    f1 = F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return {"precision": py_round(precision * 100, 1), "recall": py_round(recall * 100, 1), "f1_score": py_round(f1 * 100, 1), "support": support}


def _rows(row: DataFrame, structs: list[Column]) -> DataFrame:
    return row.select(F.inline(F.array(*structs)))


def confusion_matrix(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A15 (+J6): counts per (actual, predicted), zero-filled over the 3×3 grid."""
    return _rows(metric_row(df, max_rows), [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), _n(a, p).alias("count"))
                                            for a in CLASSES for p in CLASSES])


def class_metrics(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Per class precision / recall / F1 (×100, 1 dp, half-even) and support."""
    return _rows(metric_row(df, max_rows), [F.struct(F.lit(c).alias("class"), *[v.alias(k) for k, v in _per_class(c).items()]) for c in CLASSES])


def overall_metrics(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 over the rounded class values."""
    per = {c: _per_class(c) for c in CLASSES}
    rows = _total([per[c]["support"] for c in CLASSES])

    def weighted(what):
        return py_round(_share(_total([per[c][what] * per[c]["support"] for c in CLASSES]), rows), 1)
    return metric_row(df, max_rows).select(
        weighted("precision").alias("weighted_precision"), weighted("recall").alias("weighted_recall"), weighted("f1_score").alias("weighted_f1"),
        py_round(_share(_total([_n(c, c) for c in CLASSES]), rows) * 100, 1).alias("accuracy"))


def class_distribution(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Per class, labelled rows by actual class and all rows by predicted class."""
    return _rows(metric_row(df, max_rows), [F.struct(F.lit(c).alias("class"), _total([_n(c, p) for p in CLASSES]).alias("actual_count"),
                                                     F.col(f"rows_{c}").alias("predicted_count")) for c in CLASSES])


def confidence_by_class(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Mean confidence (NULL read as 0) per predicted class, 3 dp; 0 for an empty class."""
    return _rows(metric_row(df, max_rows), [F.struct(F.lit(c).alias("class"), F.coalesce(py_round(F.col(f"conf_{c}"), 3), F.lit(0.0)).alias("avg_confidence"))
                                            for c in CLASSES])
