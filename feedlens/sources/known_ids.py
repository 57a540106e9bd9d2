"""Per-day bitmaps of the ids that a fact table holds, in a folder beside it with a folder per month.

An import asks them first, so that the table itself is read only for ids that may be there.  A bitmap
is written before the rows it speaks for; an import that dies in between leaves bits for rows that
never came, which the exact look into the table settles.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bitmaps import BITMAP, BUCKET, bit_set, slot
from . import readers

#: Bits for the ids of one day: 128 KB, mostly zeros that Parquet packs, for one import.
DAY_BITS = 1 << 20
MONTH = "event_month"
_SCHEMA = f"{BUCKET} long, {BITMAP} binary, event_date date, {MONTH} date"


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}_ids"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_SCHEMA).parquet(_folder(path))
    except AnalysisException:
        return None


def _month(day) -> Column:
    return F.trunc(day, "month")


def add(ids: DataFrame, path: str, mode: str = "append") -> None:
    """Add the (id, event_date) rows to the bitmaps of the table at ``path``.

    The ids' bits are shuffled, by month, not the bitmaps: with few ids a day, a bitmap has hardly more bits than ids."""
    bits = ids.select(_month("event_date").alias(MONTH), "event_date", slot(["id"], DAY_BITS).alias("_slot")).distinct().repartition(MONTH)
    rows = bits.groupBy(MONTH, "event_date", F.bitmap_bucket_number("_slot").alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias(BITMAP))
    rows.write.mode(mode).partitionBy(MONTH).parquet(_folder(path))


def ensure(spark: SparkSession, path: str) -> None:
    """Build the bitmaps of a table that has none, or that was filled by other means (delete them first)."""
    if _read(spark, path) is None:
        add(readers.read_fact(spark, path, ["id", "event_date"]), path)


def compact(spark: SparkSession, path: str) -> None:
    """One file of merged bitmaps per month instead of one per import; takes turns with imports."""
    merged = _read(spark, path).groupBy("event_date", BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP)).withColumn(MONTH, _month("event_date"))
    merged.select(BUCKET, BITMAP, "event_date", MONTH).hint("rebalance", MONTH).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(_folder(path))


def maybe_known(ids: DataFrame, path: str, first_day, last_day) -> DataFrame:
    """Those of the (id, event_date) rows, all between two days, that the table may hold."""
    days = F.col("event_date").between(F.lit(first_day), F.lit(last_day)) | F.col("event_date").isNull()
    first_month, last_month = (_month(F.lit(d).cast("date")) for d in (first_day, last_day))
    months = F.col(MONTH).between(first_month, last_month) | F.col(MONTH).isNull()
    held = _read(ids.sparkSession, path).where(months & days).groupBy(F.col("event_date").alias("_day"), BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))
    asked = ids.withColumn("_slot", slot(["id"], DAY_BITS)).withColumn("_asked", F.bitmap_bucket_number("_slot"))
    same = asked.event_date.eqNullSafe(F.col("_day")) & (F.col("_asked") == F.col(BUCKET))
    return asked.join(held, same).where(bit_set(BITMAP, F.col("_slot"))).select("id", "event_date")
