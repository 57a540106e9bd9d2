"""Registered text queries: W1 top comments, W2 keywords, U3/R6 key themes, J3/U1/U2 comparison,
J5 product summary (flat)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import polarity_sql
from ..functions.numeric import pct_sql
from ..functions.text import keyword_tokens_sql
from ..functions.timefns import whole_days_between_sql
from ..operators import compare as C, products as P, text as TX
from ..sources.fixtures import feedback_docs
from .oracle import with_views
from .registry import register

AS_OF = "2024-02-15 00:00:00"
PAIR = ("src0", "src1")
POL = polarity_sql("sentiment_label", "m1s")

_SCORES = f"""SELECT id, product, {POL} AS polarity,
  coalesce(confidence_score, 0.0e0) * 0.4e0 AS confidence_part,
  CASE WHEN helpfulness_denominator > 0
       THEN CAST(helpfulness_numerator AS DOUBLE) / helpfulness_denominator * 0.3e0 ELSE 0.0e0 END
    AS helpfulness_part,
  greatest(0.0e0, 1.0e0 - {whole_days_between_sql('event_ts', f"TIMESTAMP '{AS_OF}'")} / 365.0e0) * 0.2e0
    AS recency_part,
  least(1.0e0, length(coalesce(text, '')) / 1000.0e0) * 0.1e0 AS text_part
FROM feedback_docs"""

W1_SQL = with_views(f"""
SELECT id, product, polarity, CAST(rank AS INTEGER) AS rank, ranking_score, confidence_part,
       helpfulness_part, recency_part, text_part FROM (
  SELECT *, row_number() OVER (PARTITION BY product, polarity ORDER BY ranking_score DESC, id) AS rank
  FROM (SELECT *, confidence_part + helpfulness_part + recency_part + text_part AS ranking_score
        FROM s WHERE polarity IS NOT NULL) q) r
WHERE rank <= 10""", ("s", _SCORES))

_W1_COLS = ["id", "product", "polarity", "rank", "ranking_score", "confidence_part",
            "helpfulness_part", "recency_part", "text_part"]


@register("W1_top_comments", W1_SQL)
def w1(spark, sf):
    return TX.rank_comments(feedback_docs(spark, sf, with_rating=False), 10, AS_OF).select(*_W1_COLS)


@register("W1_top_comment_texts", with_views(f"""
SELECT id, product, polarity, CAST(rank AS INTEGER) AS rank, text FROM (
  SELECT *, row_number() OVER (PARTITION BY product, polarity ORDER BY ranking_score DESC, id) AS rank
  FROM (SELECT *, confidence_part + helpfulness_part + recency_part + text_part AS ranking_score
        FROM s WHERE polarity IS NOT NULL) q) r JOIN (SELECT id, text FROM feedback_docs) d USING (id)
WHERE rank <= 10""", ("s", _SCORES)))
def w1_texts(spark, sf):
    return TX.top_comments(feedback_docs(spark, sf, with_rating=False), 10, AS_OF).select("id", "product", "polarity", "rank", "text")


_BLANKS = "\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _kw_ctes(where: str = "TRUE", src: str = "feedback_docs"):
    base = (f"SELECT id, product, {POL} AS polarity, coalesce(text, '') AS text FROM {src} "
            f"WHERE {POL} IS NOT NULL AND {where}")
    return [
        ("kb", base),
        ("ke", "SELECT product, polarity FROM kb GROUP BY 1, 2 "
               "HAVING sum(length(text)) + count(*) - 1"
               f" - arg_min(length(regexp_extract(text, '^[{_BLANKS}]*')), id)"
               f" - arg_max(length(regexp_extract(text, '[{_BLANKS}]*$')), id) >= 50"),
        ("kw", f"SELECT product, polarity, unnest({keyword_tokens_sql('text')}) AS word FROM kb"),
        ("kc", "SELECT product, polarity, word, CAST(count(*) AS BIGINT) AS count FROM kw GROUP BY 1, 2, 3"),
        ("kr", "SELECT kc.*, CAST(row_number() OVER (PARTITION BY product, polarity "
               "ORDER BY count DESC, word) AS INTEGER) AS rank "
               "FROM kc SEMI JOIN ke USING (product, polarity)"),
        ("kt", "SELECT * FROM kr WHERE rank <= 10"),
    ]


@register("W2_keywords", with_views("SELECT product, polarity, word, count, rank FROM kt", *_kw_ctes()))
def w2(spark, sf):
    return TX.keywords(feedback_docs(spark, sf, with_rating=False), 10) \
        .select("product", "polarity", "word", "count", "rank")


_THEMES_BODY = """
SELECT p.product AS product_id,
  coalesce(CASE WHEN t.themes IS NOT NULL THEN 'Key themes: ' || t.themes END,
           'No key themes detected.') AS product_description
FROM (SELECT DISTINCT product FROM {src}) p LEFT JOIN (
  SELECT product, string_agg(word, ', ' ORDER BY k) AS themes FROM (
    SELECT product, word, k, row_number() OVER (PARTITION BY product ORDER BY k) AS n FROM (
      SELECT product, word, min(CASE polarity WHEN 'positive' THEN rank ELSE 100 + rank END) AS k
      FROM kt WHERE polarity IN ('positive', 'negative') GROUP BY 1, 2) a) b
  WHERE n <= 5 GROUP BY product) t ON p.product = t.product"""
_THEMES_SQL = with_views(_THEMES_BODY.format(src="feedback_docs"), *_kw_ctes())


@register("R6_product_description", _THEMES_SQL)
def r6(spark, sf):
    df = feedback_docs(spark, sf, with_rating=False)
    prods = df.select(F.col("product").alias("product_id")).distinct()
    kw = TX.keyword_lists(df, 10).withColumnRenamed("product", "product_id")
    empty = F.array().cast("array<string>")
    j = prods.join(kw, "product_id", "left")
    themes = P.key_themes(F.coalesce("positive_keywords", empty), F.coalesce("negative_keywords", empty))
    return j.select("product_id",
                    P.product_description(F.lit(None).cast("string"), themes).alias("product_description"))


def _summary_sql(where: str) -> str:
    pol = polarity_sql("sentiment_label", "m1")
    return f"""SELECT product AS product_id, CAST(count(*) AS BIGINT) AS total_reviews,
  {pct_sql(f"count_if({pol} = 'positive')", 'count(*)')} AS positive_percentage,
  {pct_sql(f"count_if({pol} = 'negative')", 'count(*)')} AS negative_percentage,
  {pct_sql(f"count_if({pol} = 'neutral')", 'count(*)')} AS neutral_percentage,
  sum(coalesce(confidence_score, 0.0)) / count(*) AS avg_confidence
FROM feedback_docs WHERE {where} GROUP BY product"""


_PAIR_WHERE = f"product IN ('{PAIR[0]}', '{PAIR[1]}')"


@register("J3_compare_products", with_views(f"""
SELECT '{PAIR[0]}' AS product_1, '{PAIR[1]}' AS product_2,
  a.positive_percentage - b.positive_percentage AS positive_percentage_diff,
  a.negative_percentage - b.negative_percentage AS negative_percentage_diff,
  a.neutral_percentage - b.neutral_percentage AS neutral_percentage_diff,
  a.avg_confidence - b.avg_confidence AS confidence_diff,
  a.total_reviews - b.total_reviews AS total_reviews_diff,
  CASE WHEN a.positive_percentage > b.positive_percentage THEN a.product_id ELSE b.product_id END
    AS better_product
FROM s a, s b WHERE a.product_id = '{PAIR[0]}' AND b.product_id = '{PAIR[1]}'""",
    ("s", _summary_sql(_PAIR_WHERE))), stable=('positive_percentage_diff', 'negative_percentage_diff', 'neutral_percentage_diff', 'confidence_diff'))
def j3(spark, sf):
    df = feedback_docs(spark, sf, with_rating=False)
    cmp = C.compare_products(C.comparable_summary(df, list(PAIR)), *PAIR)
    return cmp.select("product_1", "product_2", "positive_percentage_diff", "negative_percentage_diff",
                      "neutral_percentage_diff", "confidence_diff", "total_reviews_diff",
                      "better_product")


def _set(name, a, b, pol, op):
    return (f"SELECT '{name}' AS keyword_set, word AS keyword FROM (SELECT word FROM kt WHERE "
            f"product = '{a}' AND polarity = '{pol}' {op} SELECT word FROM kt WHERE product = '{b}' "
            f"AND polarity = '{pol}') x")


@register("U1_U2_keyword_sets", with_views(" UNION ALL ".join([
    _set("common_positive_keywords", PAIR[0], PAIR[1], "positive", "INTERSECT"),
    _set("common_negative_keywords", PAIR[0], PAIR[1], "negative", "INTERSECT"),
    _set("unique_positive_keywords_p1", PAIR[0], PAIR[1], "positive", "EXCEPT"),
    _set("unique_positive_keywords_p2", PAIR[1], PAIR[0], "positive", "EXCEPT"),
    _set("unique_negative_keywords_p1", PAIR[0], PAIR[1], "negative", "EXCEPT"),
    _set("unique_negative_keywords_p2", PAIR[1], PAIR[0], "negative", "EXCEPT"),
]), *_kw_ctes(_PAIR_WHERE)))
def u12(spark, sf):
    df = feedback_docs(spark, sf, with_rating=False)
    return C.keyword_set_rows(C.compare_products(C.comparable_summary(df, list(PAIR)), *PAIR))


@register("J5_product_summary", with_views(f"""
SELECT s.product_id, s.total_reviews, s.positive_percentage, s.negative_percentage, s.neutral_percentage,
  s.avg_confidence, th.product_description, coalesce(pk.kw, '') AS positive_keywords,
  CAST(least(10, coalesce(nn.n, 0)) AS INTEGER) AS n_top_negative
FROM s LEFT JOIN th ON th.product_id = s.product_id
LEFT JOIN (SELECT product, string_agg(word, ',' ORDER BY rank) AS kw FROM kt WHERE polarity = 'positive'
           GROUP BY product) pk ON pk.product = s.product_id
LEFT JOIN (SELECT product, count(*) AS n FROM feedback_docs WHERE {POL} = 'negative' GROUP BY product) nn
  ON nn.product = s.product_id""", *_kw_ctes(), ("th", _THEMES_BODY.format(src="feedback_docs")), ("s", _summary_sql("TRUE"))), stable=('avg_confidence',))
def j5(spark, sf):
    df = feedback_docs(spark, sf, with_rating=False)
    s = P.product_summary(df, 10, AS_OF)
    return s.select("product_id", "total_reviews", "positive_percentage", "negative_percentage",
                    "neutral_percentage", "avg_confidence", "product_description",
                    F.array_join("positive_keywords", ",").alias("positive_keywords"),
                    F.size("top_negative_comments").alias("n_top_negative"))


@register("U3_key_themes", with_views("""
SELECT product, CAST(n AS INTEGER) AS position, word FROM (
  SELECT product, word, row_number() OVER (PARTITION BY product ORDER BY k) AS n FROM (
    SELECT product, word, min(CASE polarity WHEN 'positive' THEN rank ELSE 100 + rank END) AS k
    FROM kt WHERE polarity IN ('positive', 'negative') GROUP BY 1, 2) a) b WHERE n <= 5""", *_kw_ctes()))
def u3(spark, sf):
    kw = TX.keyword_lists(feedback_docs(spark, sf, with_rating=False), 10)
    empty = F.array().cast("array<string>")
    themes = P.key_themes(F.coalesce("positive_keywords", empty), F.coalesce("negative_keywords", empty))
    return kw.select("product", F.posexplode(themes).alias("pos", "word")) \
             .select("product", (F.col("pos") + 1).alias("position"), "word")
