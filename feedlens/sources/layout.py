"""Clustered layout of the fact table, and the compaction of its many small files.

Within a day, rows are laid along a space-filling curve over (product, time of day): the leading bits of the
product's hash alternate with a few bits of the time, so a stretch of the curve holds few products and
few hours.  Files are cut by range partitioning along the curve, also inside a hot day or product, and
carry Bloom filters on ``product``; a query for one product skips the other row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import readers, sinks
from .schemas import DAY, MONTH

#: Bits of the product's hash and of the time of day on the curve; they alternate, product first.
PRODUCT_BITS, TIME_BITS = 16, 4
#: Bytes of a row group, and files of a day from which on it is compacted.
ROW_GROUP_BYTES, SMALL_FILES = 32 << 20, 4


def curve_key(product: str = "product", ts: str = "event_ts") -> Column:
    """Morton key of (product hash, time of day); a null product or time counts as its smallest value."""
    p = F.pmod(F.xxhash64(F.coalesce(F.col(product), F.lit(""))), F.lit(1 << PRODUCT_BITS))
    seconds = F.coalesce(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts), F.lit(0)).cast("long")
    t = F.floor(seconds * (1 << TIME_BITS) / F.lit(86400)).cast("long")
    key = F.shiftright(p, PRODUCT_BITS - TIME_BITS)            # leading product bits, to be spread
    mixed = F.lit(0).cast("long")
    for k in range(TIME_BITS):
        mixed = mixed.bitwiseOR(F.shiftleft(F.shiftright(key, k).bitwiseAND(F.lit(1)), 2 * k + 1)).bitwiseOR(
            F.shiftleft(F.shiftright(t, k).bitwiseAND(F.lit(1)), 2 * k))
    rest = p.bitwiseAND(F.lit((1 << (PRODUCT_BITS - TIME_BITS)) - 1))
    return F.shiftleft(mixed, PRODUCT_BITS - TIME_BITS).bitwiseOR(rest)


def write_clustered(df: DataFrame, path: str, mode: str = "append", files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES,
                    products: int = 10_000, replace_days: bool = False) -> None:
    """S6/S7 in the clustered layout.

    ``files`` is the number of range partitions (default: Spark's shuffle partitions, merged by size),
    ``products`` the distinct products a row group's Bloom filter is sized for.  ``replace_days`` overwrites the
    days that ``df`` has and leaves the others.
    """
    keyed, folder = sinks.with_folder(sinks.with_date(df), path, anew=mode == "overwrite" and not replace_days)
    if replace_days and folder == MONTH and sinks.folder_column(df.sparkSession, path):
        keyed = sinks.with_other_days(keyed, path)
    _write(keyed, folder, path, mode, files, row_group_bytes, products, replace_days)


def _write(dated: DataFrame, folder: str, path: str, mode: str, files: int | None, row_group_bytes: int, products: int, replace: bool) -> None:
    """``replace`` overwrites the folders that the rows are in and leaves the others."""
    order = [DAY, "_curve"] if folder == DAY else [MONTH, DAY, "_curve"]
    keyed = dated.withColumn("_curve", curve_key())
    dealt = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    w = (dealt.sortWithinPartitions(*order).drop("_curve").write.mode("overwrite" if replace else mode).partitionBy(folder)
         .option("parquet.block.size", row_group_bytes).option("parquet.bloom.filter.enabled#product", "true")
         .option("parquet.bloom.filter.expected.ndv#product", products))
    if replace:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def files_per_day(spark: SparkSession, path: str) -> DataFrame:
    """(event_date, files, bytes) of a fact table; reads no column of it, unless its folders are months, whose days
    share files."""
    return _files_per(readers.read_fact(spark, path), DAY)


def _files_per(facts: DataFrame, folder: str) -> DataFrame:
    files = facts.select(folder, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy(folder, "file").agg(F.max("bytes").alias("bytes")).groupBy(folder).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def compact(spark: SparkSession, path: str, small_files: int = SMALL_FILES, files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES,
            products: int = 10_000) -> None:
    """Rewrite the days (months, if folders are months) that lie in ``small_files`` files or more, clustered, and leave
    the others alone.

    Only those are opened.  The new files take the place of the old ones when the whole job commits, so
    a task that is run again still finds its input.  Rows that are appended meanwhile to such a day
    would be lost: compaction takes turns with imports.
    """
    # The table's files are listed once, and opened once to be counted.
    facts = readers.read_fact(spark, path)
    folder = MONTH if MONTH in facts.columns else DAY
    many = _files_per(facts, folder).where(F.col("files") >= small_files).select(folder).persist()
    try:
        if many.count():
            # One row per folder of the table.
            rows = sinks.with_date(facts.join(F.broadcast(many), folder, "left_semi"))
            if folder == MONTH:
                rows = rows.withColumn(MONTH, F.trunc(DAY, "month"))
            _write(rows, folder, path, "overwrite", files, row_group_bytes, products, replace=True)
    finally:
        many.unpersist()
