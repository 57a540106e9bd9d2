"""A rank index over the product rollup (W3): deep pages without sorting everything before them.

The rollup is written once in range partitions of (total descending, product).  A page adds up the
partitions' row counts, reads the partitions that overlap it and sorts only those.  Pages that follow
each other need no index: ``products_after`` continues behind the last row of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import products


def _order() -> list:
    return [F.col("total_reviews").desc(), F.col("product_id").asc()]


def build_rank_index(df: DataFrame, path: str, min_reviews: int = 1, scheme: str = "m1s", parts: int | None = None) -> None:
    """Write the product rollup of ``df`` in range partitions of its page order."""
    roll = products.product_rollup(df, min_reviews, scheme)
    dealt = roll.repartitionByRange(parts, *_order()) if parts else roll.repartitionByRange(*_order())
    dealt.withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(path)


def page_from_index(spark: SparkSession, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """W3 from the index: the same rows, ``total`` and ``has_more`` as ``products_page``."""
    index = spark.read.parquet(path)
    counts = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition of the index; a file holds one partition, so the filter below skips the other files.
    begin = counts.withColumn("begin", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    hit = (F.col("begin") < offset + limit) & (F.col("begin") + F.col("n") > offset)
    first, last, begins, total = begin.agg(F.min(F.when(hit, F.col("part"))), F.max(F.when(hit, F.col("part"))),
                                           F.min(F.when(hit, F.col("begin"))), F.sum("n")).first()
    rows = index.where(F.col("part").between(first, last) if first is not None else F.lit(False)).drop("part")
    page = rows.orderBy(*_order()).offset(offset - (begins or 0)).limit(limit) if offset > (begins or 0) else rows.orderBy(*_order()).limit(limit)
    return page.withColumns({"total": F.lit(total or 0).cast("long"), "has_more": F.lit(offset + limit < (total or 0))})


def products_after(df: DataFrame, last_total: int | None = None, last_product: str | None = None, limit: int = 100, min_reviews: int = 1,
                   scheme: str = "m1s") -> DataFrame:
    """The ``limit`` products behind (last_total, last_product) in page order; the first page without them.
    Every task keeps ``limit`` rows at most."""
    roll = products.product_rollup(df, min_reviews, scheme)
    if last_total is not None:
        total = F.col("total_reviews")
        roll = roll.where((total < last_total) | ((total == last_total) & (F.col("product_id") > F.lit(last_product))))
    return roll.orderBy(*_order()).limit(limit)
