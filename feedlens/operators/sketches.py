"""Persistent mergeable sketches per day: distinct products, ids and teams over any range of days.

A day's HyperLogLog sketches are a few kilobytes whatever the rows of the day.  Distinct counts over a range merge
them and read no facts.  The exact operators stay; an estimate is within ``error`` of them in two cases out
of three, within three times that almost always.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import readers
from . import rollups

#: log2 of the buckets of a sketch.
LG_K = 14
COLUMNS = ("id", "product", "team")
_SCHEMA = ", ".join([*(f"{c}_sketch binary" for c in COLUMNS), "rows long", "made_of long", "piece_date date"])


def error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(1 << lg_k)


def _read(spark: SparkSession, path: str) -> DataFrame:
    empty = spark.createDataFrame([], _SCHEMA)
    try:
        return spark.read.schema(empty.schema).parquet(f"{path}/sketch")
    except AnalysisException:               # before the first refresh
        return empty


def _value(column: str) -> Column:
    """The value as a sketch takes it: sketches pass over an empty string, which is a value here."""
    return F.concat(F.lit("="), F.col(column).cast("string"))


def refresh(spark: SparkSession, fact_path: str, view_path: str, lg_k: int = LG_K) -> None:
    """Sketch the days whose files changed since the last refresh; other days are not read."""
    days = rollups.changed_days(spark, fact_path, view_path, "sketch")
    log = f"{view_path}/sketched"
    days.write.mode("overwrite").parquet(log)
    days = spark.read.schema("piece_date date, made_of long").parquet(log).where("piece_date >= DATE'0001-01-01'")
    if not days.limit(1).count():
        return
    _, facts = rollups.of_days(readers.read_fact(spark, fact_path), days.select("piece_date"), [*COLUMNS])
    found = facts.groupBy("piece_date").agg(
        *[F.hll_sketch_agg(_value(c), lg_k).alias(f"{c}_sketch") for c in COLUMNS], F.count(F.lit(1)).alias("rows"))
    out = days.join(found, "piece_date", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    out.select(*[f"{c}_sketch" for c in COLUMNS], "rows", "made_of", "piece_date").repartition("piece_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("piece_date").parquet(f"{view_path}/sketch")


def distinct_estimates(spark: SparkSession, view_path: str, first_day=None, last_day=None) -> DataFrame:
    """(rows, distinct_id, distinct_product, distinct_team) over the days from ``first_day`` to ``last_day``;
    ``rows`` is exact, the others are estimates."""
    days = _read(spark, view_path).where("rows > 0")
    if first_day is not None:
        days = days.where(F.col("piece_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        days = days.where(F.col("piece_date") <= F.lit(last_day).cast("date"))
    return days.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")), F.lit(0)).alias(f"distinct_{c}") for c in COLUMNS])
