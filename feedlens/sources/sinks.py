"""Sinks S6, S7 and the ingest report S10.

Writes are one job per batch (not one transaction per row).  The fact table is partitioned by
``event_date`` so time-range queries prune whole directories.  A table of many days with few rows each has a
folder per month instead (``event_month``), its rows laid by day: it would be nothing but folders otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import metadata
from .readers import CORRUPT, FILE, read_fact
from .schemas import DAY, MONTH

FACT_COLUMNS = ["id", "text", "sentiment_label", "confidence_score", "event_ts", "team", "product",
                "metadata"]
#: The first write of a table gives it a folder per month if it has more days than this, with fewer rows each on average.
SPARSE_DAYS, SPARSE_ROWS = 1000, 1000


def with_date(df: DataFrame) -> DataFrame:
    """Fact columns plus the text's length, so that ranking by it need not read the text, and the day."""
    out = df.select(*[c for c in FACT_COLUMNS if c in df.columns])
    if "text" in out.columns:
        out = out.withColumn("text_length", F.length("text"))
    return out.withColumn("event_date", F.to_date("event_ts"))


def folder_column(spark: SparkSession, path: str) -> str | None:
    """The column that names the folders of the table at ``path``; None if there is no table."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = fs.listStatusIterator(root)
    while found.hasNext():
        name = found.next().getPath().getName().split("=")[0]
        if name in (DAY, MONTH):
            return name
    return DAY


def with_folder(df: DataFrame, path: str, anew: bool = False) -> tuple[DataFrame, str]:
    """Rows of ``with_date`` with the column that names their folders, and that column: the table's own, or if it is
    written ``anew`` the one that suits the rows (one narrow pass)."""
    folder = None if anew else folder_column(df.sparkSession, path)
    if folder is None:
        n = df.groupBy(DAY).count().agg(F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
        folder = MONTH if n.days > SPARSE_DAYS and n.rows < n.days * SPARSE_ROWS else DAY
    return (df.withColumn(MONTH, F.trunc(DAY, "month")) if folder == MONTH else df), folder


def with_other_days(df: DataFrame, path: str) -> DataFrame:
    """The rows, and those of the other days of their months in the table at ``path``, which has a folder per month."""
    variant = "metadata" in df.columns and df.schema["metadata"].dataType.typeName() == "variant"
    table = read_fact(df.sparkSession, path, variant=variant)
    # One row per day and per month is broadcast.
    days = df.select(F.col(DAY).alias("_day")).distinct()
    months = df.select(F.col(MONTH).alias("_month")).distinct()
    old = table.join(F.broadcast(months), F.col(MONTH).eqNullSafe(F.col("_month")), "left_semi").join(
        F.broadcast(days), F.col(DAY).eqNullSafe(F.col("_day")), "left_anti")
    return df.unionByName(old, allowMissingColumns=True)


def _write_folders(df: DataFrame, folder: str, path: str, mode: str, dynamic: bool = False) -> None:
    """Cluster rows by folder for few files in each, while letting AQE split a hot one over several
    writer tasks (a plain ``repartition(folder)`` would give it one task)."""
    dealt = df.hint("rebalance", folder)
    if folder == MONTH:
        dealt = dealt.sortWithinPartitions(MONTH, DAY)
    w = dealt.write.mode(mode).partitionBy(folder)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_results(df: DataFrame, path: str, mode: str = "append", dedupe_on: list[str] | None = None,
                  by_date: bool = True, variant: bool = False) -> None:
    """Append scored rows to the fact table (``mode='overwrite'`` is S7).

    ``by_date=False`` writes plain files without folders, for a table that is read whole.

    ``variant=True`` parses ``metadata`` once and stores it as a VARIANT (read it with ``read_fact(variant=True)``);
    text that is no JSON is stored as null.

    ``dedupe_on`` (e.g. ``["id"]``) drops re-imported copies within the batch first; batch
    ``dropDuplicates`` aggregates map-side, so even a hot group of copies is combined per task."""
    if dedupe_on:
        df = df.dropDuplicates(dedupe_on)
    if variant:
        df = metadata.parsed(df)
    if by_date:
        dated, folder = with_folder(with_date(df), path, anew=mode == "overwrite")
        _write_folders(dated, folder, path, mode)
    else:
        with_date(df).write.mode(mode).parquet(path)


def overwrite_results(df: DataFrame, path: str, dynamic: bool = False) -> None:
    """Truncate-and-reload; ``dynamic=True`` replaces only the dates present in ``df``."""
    dated, folder = with_folder(with_date(df), path, anew=not dynamic)
    if dynamic and folder == MONTH and folder_column(df.sparkSession, path):
        dated = with_other_days(dated, path)
    _write_folders(dated, folder, path, "overwrite", dynamic)


def ingest_report(raw: DataFrame, valid: Column) -> DataFrame:
    """Received, processed, failed and success rate (%) of one ingest; ``valid`` is the condition a
    row has to meet.  One pass over the rows."""
    out = raw.agg(F.count(F.lit(1)).alias("received"), F.count_if(valid).alias("processed"))
    received, processed = F.col("received"), F.col("processed")
    return out.select(received, processed, (received - processed).alias("failed"),
                      F.when(received > 0, processed * F.lit(100.0) / received).otherwise(F.lit(0.0)).alias("success_rate"))


def reject_reason(valid: Column, reason: str = "blank text") -> Column:
    """Why a row of ``readers.read_checked`` is not taken: 'malformed', or ``reason`` if ``valid`` is not true; null if it is."""
    return F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")).when(~F.coalesce(valid, F.lit(False)), F.lit(reason))


def split_rejects(checked: DataFrame, valid: Column, reason: str = "blank text") -> tuple[DataFrame, DataFrame]:
    """(rows to take, rejects) of ``readers.read_checked``.  A reject has its reason, its file and, if it is malformed,
    its raw text, beside the columns that could be read."""
    told = checked.withColumn("reason", reject_reason(valid, reason))
    return told.where("reason IS NULL").drop("reason", CORRUPT, FILE), told.where("reason IS NOT NULL")


def checked_report(checked: DataFrame, valid: Column, reason: str = "blank text") -> DataFrame:
    """S10 of checked rows: malformed ones count as received and failed.  One pass."""
    return ingest_report(checked.select(reject_reason(valid, reason).alias("_why")), F.col("_why").isNull())


def rejects(raw: DataFrame, valid: Column) -> DataFrame:
    """Rows failing validation (a condition that is not true, NULL included), as a quarantine DataFrame."""
    return raw.where(~F.coalesce(valid, F.lit(False)))


# ---- writers for the reference's exchange formats ----------------------------------------------
CSV_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true",
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
ENVELOPE_SIZE = 100


def write_reviews_csv(reviews: DataFrame, path: str) -> None:
    """Review rows as header CSV with every field quoted ("" escapes), one file per task."""
    reviews.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).csv(path)


def _packed_lines(columns: Iterator[pa.Array], size: int, head: str, tail: str) -> Iterator[str]:
    """Lines of ``size`` items each, the last one fewer; no more than one line's items are held as strings."""
    held: list[str] = []
    for column in columns:
        at = 0
        while at < len(column):
            some = column.slice(at, size - len(held)).to_pylist()
            at += len(some)
            held += some
            if len(held) == size:
                yield head + ",".join(held) + tail
                held = []
    if held:
        yield head + ",".join(held) + tail


def _json_lines(reviews: DataFrame, size: int, head: str, tail: str) -> DataFrame:
    """Lines holding ``size`` reviews each (fewer at the end of a task) between ``head`` and ``tail``.

    Every task packs its own rows as they come: no shuffle, and a task that is rerun replaces its file."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _packed_lines((b.column(0) for b in batches), size, head, tail):
            yield pa.RecordBatch.from_pydict({"value": pa.array([line], pa.string())})

    return reviews.select(F.to_json(F.struct(*reviews.columns)).alias("item")).mapInArrow(pack, "value string")


def write_review_envelopes(reviews: DataFrame, path: str, size: int = ENVELOPE_SIZE,
                           include_top_comments: bool = True, top_comments_per_category: int = 10) -> None:
    """S3 format: JSON lines, each an envelope ``{"reviews": [...], flags}`` of at most ``size`` reviews."""
    flags = {"group_by_product": True, "include_top_comments": include_top_comments, "top_comments_per_category": top_comments_per_category}
    _json_lines(reviews, size, '{"reviews":[', "]," + json.dumps(flags)[1:]).write.mode("overwrite").text(path)


def write_review_arrays(reviews: DataFrame, path: str, size: int = ENVELOPE_SIZE) -> None:
    """S4 format: text files, one per task, whose lines are JSON arrays of at most ``size`` reviews each
    (read them with ``multiline=False``)."""
    _json_lines(reviews, size, "[", "]").write.mode("overwrite").text(path)
