"""Registered model-metrics queries (A15–A19, J6) on the documents view (rating = actual)."""

from __future__ import annotations

from ..functions.labels import CLASSES, three_class_sql
from ..operators import metrics as M
from ..sources.fixtures import feedback_docs
from .oracle import with_views
from .registry import register

_CLS = ("c", f"SELECT {three_class_sql('sentiment_label')} AS predicted, "
             "CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative' "
             "WHEN rating IS NOT NULL THEN 'Neutral' END AS actual, "
             "coalesce(confidence_score, 0.0e0) AS confidence FROM feedback_docs")
_GRID = ("g", " UNION ALL ".join(f"SELECT '{a}' AS actual, '{p}' AS predicted"
                                 for a in CLASSES for p in CLASSES))
_CLASSES = ("k", " UNION ALL ".join(f"SELECT '{a}' AS class" for a in CLASSES))
_CM = ("cm", "SELECT g.actual, g.predicted, CAST(coalesce(n, 0) AS BIGINT) AS count FROM g LEFT JOIN "
             "(SELECT actual, predicted, count(*) AS n FROM c WHERE actual IS NOT NULL GROUP BY 1, 2) x "
             "ON g.actual = x.actual AND g.predicted = x.predicted")
_PC = ("pc", """SELECT r.class, tp, support, predicted_total,
  CASE WHEN predicted_total > 0 THEN CAST(tp AS DOUBLE) / predicted_total ELSE 0.0e0 END AS p,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0e0 END AS r
FROM (SELECT actual AS class, sum(count) AS support,
             sum(CASE WHEN actual = predicted THEN count ELSE 0 END) AS tp FROM cm GROUP BY 1) r
JOIN (SELECT predicted AS class, sum(count) AS predicted_total FROM cm GROUP BY 1) q ON r.class = q.class""")
_PCR = ("pcr", """SELECT class, round_even(p * 100, 1) AS precision, round_even(r * 100, 1) AS recall,
  round_even(CASE WHEN p + r > 0 THEN 2.0e0 * p * r / (p + r) ELSE 0.0e0 END * 100, 1) AS f1_score,
  CAST(support AS BIGINT) AS support FROM pc""")



@register("A15_confusion_matrix", with_views("SELECT actual, predicted, count FROM cm",
                                             _CLS, _GRID, _CM))
def a15(spark, sf):
    return M.confusion_matrix(feedback_docs(spark, sf))


@register("A16_class_metrics", with_views("SELECT * FROM pcr", _CLS, _GRID, _CM, _PC, _PCR))
def a16(spark, sf):
    return M.class_metrics(feedback_docs(spark, sf))


@register("A17_overall_metrics", with_views("""
SELECT round_even(CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE 0.0e0 END, 1)
         AS weighted_precision,
       round_even(CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE 0.0e0 END, 1)
         AS weighted_recall,
       round_even(CASE WHEN sum(support) > 0 THEN sum(f1_score * support) / sum(support) ELSE 0.0e0 END, 1)
         AS weighted_f1,
       round_even(coalesce((SELECT CAST(sum(CASE WHEN actual = predicted THEN count ELSE 0 END) AS DOUBLE)
                                   / sum(count) FROM cm), 0.0e0) * 100, 1) AS accuracy
FROM pcr""", _CLS, _GRID, _CM, _PC, _PCR))
def a17(spark, sf):
    return M.overall_metrics(feedback_docs(spark, sf))


@register("A18_class_distribution", with_views("""
SELECT k.class, CAST(coalesce(a.n, 0) AS BIGINT) AS actual_count, CAST(coalesce(p.n, 0) AS BIGINT) AS predicted_count
FROM k LEFT JOIN (SELECT actual AS class, count(*) AS n FROM c GROUP BY 1) a ON k.class = a.class
LEFT JOIN (SELECT predicted AS class, count(*) AS n FROM c GROUP BY 1) p ON k.class = p.class""",
    _CLS, _CLASSES))
def a18(spark, sf):
    return M.class_distribution(feedback_docs(spark, sf))


@register("A19_confidence_by_class", with_views("""
SELECT k.class, coalesce(round_even(m, 3), 0.0e0) AS avg_confidence FROM k
LEFT JOIN (SELECT predicted AS class, avg(confidence) AS m FROM c GROUP BY 1) x ON k.class = x.class""",
    _CLS, _CLASSES))
def a19(spark, sf):
    return M.confidence_by_class(feedback_docs(spark, sf))
