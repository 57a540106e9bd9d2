"""Registered source/sink round trips S1–S10: derived rows are written in the reference's formats
below the session's checkpoint folder and read back with the library readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefns import parse_event_time
from ..operators import normalize as N
from ..operators import scoring as S
from ..session import scratch_path
from ..sources import layout, readers as RD, sinks as SK
from ..sources.derived import REVIEW_ROWS_SQL, review_rows
from ..sources.fixtures import feedback_docs
from ..sources.schemas import REVIEW_CSV_SCHEMA
from .oracle import with_views
from .registry import register

_RV = ("rv", REVIEW_ROWS_SQL)
_COLS = [f.name for f in REVIEW_CSV_SCHEMA.fields]


# CSV cannot carry '' apart from a missing value: like the reference's loaders, empty fields read
# back as NULL, so the oracle applies NULLIF to the string columns.
_CSV_COLS = [f"nullif({f.name}, '') AS {f.name}" if f.dataType.typeName() == "string" else f.name
             for f in REVIEW_CSV_SCHEMA.fields]


@register("S1_review_csv_roundtrip", with_views("SELECT " + ", ".join(_CSV_COLS) + " FROM rv", _RV))
def s1(spark, sf):
    path = scratch_path(spark, "s1-review-csv")
    SK.write_reviews_csv(review_rows(spark, sf).select(*_COLS), path)
    return RD.read_reviews_csv(spark, path)


@register("S2_enriched_csv_roundtrip", with_views(
    "SELECT " + ", ".join([*_CSV_COLS, "ProductName", "ProductDescription"]) + " FROM rv", _RV))
def s2(spark, sf):
    r = review_rows(spark, sf).withColumnsRenamed({"ProductName": "Product_Name", "ProductDescription": "Product_Description"})
    path = scratch_path(spark, "s2-enriched-csv")
    SK.write_reviews_csv(r, path)
    return RD.read_enriched_csv(spark, path)


@register("S3_review_json_envelope_roundtrip", with_views(
    "SELECT " + ", ".join(_COLS) + ", true AS group_by_product, true AS include_top_comments, "
    "10 AS top_comments_per_category FROM rv", _RV))
def s3(spark, sf):
    path = scratch_path(spark, "s3-review-envelopes")
    SK.write_review_envelopes(review_rows(spark, sf), path)
    return RD.read_reviews_json(spark, path, multiline=False).select(
        *_COLS, "group_by_product", "include_top_comments", "top_comments_per_category")


@register("S4_review_json_array_roundtrip", with_views("SELECT " + ", ".join(_COLS) + " FROM rv", _RV))
def s4(spark, sf):
    path = scratch_path(spark, "s4-review-arrays")
    SK.write_review_arrays(review_rows(spark, sf), path)
    return RD.read_reviews_json_array(spark, path, multiline=False).select(*_COLS)


@register("S5_feedback_csv_roundtrip", with_views("""
SELECT text, product, event_ts, team FROM feedback_docs"""))
def s5(spark, sf):
    d = feedback_docs(spark, sf, with_rating=False)
    out = d.select("text", "product",
                   F.concat(F.to_date("event_ts").cast("string"), F.lit("T"),
                            F.date_format("event_ts", "HH:mm:ss")).alias("timestamp"), "team")
    path = scratch_path(spark, "s5-feedback-csv")
    out.write.mode("overwrite").options(**SK.CSV_WRITE_OPTIONS).csv(path)
    back = RD.read_feedback_csv(spark, path)
    return back.select("text", "product",
                       parse_event_time(F.col("timestamp")).alias("event_ts"), "team")


_LABEL, _CONF = S.lexicon_scorer_sql("text")


@register("S6_S8_fact_append_scan", with_views(
    f"SELECT id, {_LABEL} AS sentiment_label, {_CONF} AS confidence_score, event_ts, product FROM feedback_docs"))
def s6(spark, sf):
    path = scratch_path(spark, "s6-fact")
    scored = S.lexicon_scorer(feedback_docs(spark, sf, with_rating=False))
    SK.write_results(scored, path, mode="append")
    return RD.read_fact(spark, path, ["id", "sentiment_label", "confidence_score", "event_ts", "product"])


@register("S6_compacted_fact_table", with_views(
    f"SELECT id, text, {_LABEL} AS sentiment_label, {_CONF} AS confidence_score, event_ts, team, product FROM feedback_docs"))
def s6_compacted(spark, sf):
    """Five appends in the plain layout, then one compaction into the clustered layout: no row changes."""
    path = scratch_path(spark, "s6-compacted")
    scored = S.lexicon_scorer(feedback_docs(spark, sf, with_rating=False))
    for k in range(5):
        SK.write_results(scored.where(F.pmod("id", F.lit(5)) == k), path)
    layout.compact(spark, path)
    return RD.read_fact(spark, path, ["id", "text", "sentiment_label", "confidence_score", "event_ts", "team", "product"])


@register("S7_fact_overwrite", with_views(
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT CAST(event_ts AS DATE)) AS BIGINT) AS n_dates "
    "FROM feedback_docs"))
def s7(spark, sf):
    path = scratch_path(spark, "s7-fact")
    scored = S.lexicon_scorer(feedback_docs(spark, sf, with_rating=False))
    SK.write_results(scored, path, mode="append")
    SK.overwrite_results(scored, path)            # truncate and reload: no duplicates remain
    f = RD.read_fact(spark, path)
    return f.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_date").alias("n_dates"))


@register("S9_first_n_rows", with_views("SELECT id, product FROM feedback_docs ORDER BY id LIMIT 50"))
def s9(spark, sf):
    return RD.first_n(feedback_docs(spark, sf, with_rating=False), 50).select("id", "product")


_WS = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


@register("S10_ingest_report", with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS received, CAST(count_if(regexp_matches(Text, '[^{_WS}]')) AS BIGINT) AS processed,
  CAST(count(*) - count_if(regexp_matches(Text, '[^{_WS}]')) AS BIGINT) AS failed,
  CASE WHEN count(*) > 0 THEN count_if(regexp_matches(Text, '[^{_WS}]')) * 100.0e0 / count(*) ELSE 0.0e0 END
    AS success_rate
FROM rv""", _RV))
def s10(spark, sf):
    return SK.ingest_report(review_rows(spark, sf), N.has_text(F.col("Text")))


# Files in which every 37th line is broken off and every 41st text is blank, one review per line.
_BROKEN, _BLANK = "doc_id % 37 = 0", "doc_id % 41 = 0"
_CHECKED_SQL = f"""SELECT CASE WHEN {_BROKEN} THEN 'malformed' WHEN {_BLANK} OR NOT regexp_matches(coalesce(text, ''), '[^{_WS}]') THEN 'blank text' END AS reason
FROM documents"""


def _checked(spark, sf, fmt: str):
    """Review rows written line by line in the exchange format, some of them damaged, and read back."""
    path = scratch_path(spark, f"s10-checked-{fmt}")
    rows = review_rows(spark, sf).select(*_COLS).withColumn("Text", F.when(F.col("Id").cast("long") % 41 == 0, "  ").otherwise(F.translate("Text", "\r\n", "  ")))
    if fmt == "csv":
        line = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in _COLS])
        cut = F.concat(F.lit('"'), F.col("Id"), F.lit('","broken"'))
    else:
        line = F.concat(F.lit("["), F.to_json(F.struct(*_COLS)), F.lit("]"))
        cut = F.concat(F.lit('[{"Id": "'), F.col("Id"), F.lit('", "Tex'))
    rows.select(F.when(F.col("Id").cast("long") % 37 == 0, cut).otherwise(line).alias("value")).write.text(path)
    return RD.read_checked(spark, path, fmt, header=False)


@register("S10_checked_report_json", f"""
SELECT CAST(count(*) AS BIGINT) AS received, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS processed,
       CAST(count(reason) AS BIGINT) AS failed, count(*) FILTER (reason IS NULL) * 100.0e0 / count(*) AS success_rate
FROM ({_CHECKED_SQL}) c""")
def s10_checked_json(spark, sf):
    return SK.checked_report(_checked(spark, sf, "json_array"), N.has_text(F.col("Text")))


@register("S10_checked_rejects_csv", f"""
SELECT reason, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (reason = 'malformed') AS BIGINT) AS with_raw_text, true AS named_files
FROM ({_CHECKED_SQL}) c WHERE reason IS NOT NULL GROUP BY reason""")
def s10_checked_csv(spark, sf):
    _, bad = SK.split_rejects(_checked(spark, sf, "csv"), N.has_text(F.col("Text")))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(RD.CORRUPT).alias("with_raw_text"),
                                     F.bool_and(F.col(RD.FILE).contains("s10-checked")).alias("named_files"))
