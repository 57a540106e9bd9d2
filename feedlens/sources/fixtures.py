"""Fact-table views over the driver's parquet tables (see FIXTURES.md §2).

The same SQL fragments define the DuckDB oracle views in ``feedlens.plans.oracle``.  Only the needed
columns are read (parquet column pruning), and ``feedback_docs`` joins ``labels`` only on request,
so text-only operators never shuffle the document text for a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Session setting: deal the rows of ``documents`` to so many partitions when reading it.  Unset, which is
#: the default whatever the size, nothing is shuffled; the bench sets it, as its file is one row group.
INPUT_PARTITIONS = "spark.feedlens.documents.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(INPUT_PARTITIONS, None) if name == "documents" else None
    return df.repartition(int(n)) if n else df


EVENTS_EXPRS = [
    "event_id AS id",
    "CASE event_type WHEN 'purchase' THEN 'joy' WHEN 'signup' THEN 'positive' "
    "WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'surprise' ELSE 'anger' END AS sentiment_label",
    "1.0e0 - (event_id % 60) / 100.0e0 AS confidence_score",
    "ts AS event_ts",
    "CASE user_id % 4 WHEN 0 THEN 'Premium' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Trial' END AS team",
    "CASE user_id % 50 WHEN 49 THEN 'unknown' WHEN 48 THEN '' WHEN 47 THEN NULL "
    "ELSE concat('P', user_id % 50) END AS product",
    "props AS metadata",
]

DOCS_EXPRS = [
    "d.doc_id AS id",
    "d.text AS text",
    "CASE d.doc_id % 7 WHEN 0 THEN 'joy' WHEN 1 THEN 'anger' WHEN 2 THEN 'disgust' WHEN 3 THEN 'fear' "
    "WHEN 4 THEN 'neutral' WHEN 5 THEN 'sadness' ELSE 'surprise' END AS sentiment_label",
    "0.3e0 + ((d.doc_id * 37) % 70) / 100.0e0 AS confidence_score",
    "{ts0} + d.doc_id * INTERVAL '1' HOUR AS event_ts",
    "CASE d.doc_id % 3 WHEN 0 THEN 'Premium' WHEN 1 THEN 'Normal' ELSE 'Trial' END AS team",
    "d.source AS product",
]
DOCS_RATING_EXPR = ("CASE WHEN l.toxic = 1 THEN 1.0e0 WHEN l.quality = 1 THEN 5.0e0 "
                    "WHEN l.quality = 0 THEN 3.0e0 END AS rating")
DOCS_HELPFUL_EXPRS = [
    "d.doc_id % 4 AS helpfulness_numerator",
    "d.doc_id % 4 + d.doc_id % 3 AS helpfulness_denominator",
]

ORDERS_EXPRS = [
    "l.l_orderkey * 100 + l.l_linenumber AS id",
    "concat('P', l.l_partkey % 200) AS product",
    "c.c_mktsegment AS team",
    "l.l_shipdate AS event_ts",
    "CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) AS score",
    "CAST(l.l_quantity AS INT) AS helpfulness_numerator",
    "50 AS helpfulness_denominator",
]


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 rows per 0.01 sf: time series, statistics, alerts, streaming, JSON metadata."""
    return table(spark, sf_dir, "events").selectExpr(*EVENTS_EXPRS)


def feedback_docs(spark: SparkSession, sf_dir: str, with_rating: bool = True) -> DataFrame:
    """1,000 rows per 0.01 sf: keywords, top comments, metrics, comparison."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source").alias("d")
    exprs = [e.format(ts0="TIMESTAMP_NTZ'2024-01-01 00:00:00'") for e in DOCS_EXPRS]
    if with_rating:
        lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").alias("l")
        d = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left")
        exprs.append(DOCS_RATING_EXPR)
    return d.selectExpr(*exprs, *DOCS_HELPFUL_EXPRS)


def feedback_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: rating scorer, profile, bench.  ``id`` is not unique."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity").alias("l")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").alias("o")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").alias("c")
    return (li.join(o, F.col("l.l_orderkey") == F.col("o.o_orderkey"))
              .join(c, F.col("o.o_custkey") == F.col("c.c_custkey"))
              .selectExpr(*ORDERS_EXPRS))
