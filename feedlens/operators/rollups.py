"""Incremental series (A5–A8, A32) over a growing fact table.

Mergeable partials (rows, sum and number of confidences) per hour, team, product and label are kept in a view
beside the fact table, and from them pieces per day and per week.  A refresh compares, day by day, the
files a day has now with those its pieces were made of, and recomputes only the days that differ.  A range
is answered from the largest whole pieces inside it; only the two broken hours at its ends are read
from the facts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.labels import EMOTIONS, count_polarity_weighted
from ..functions.timefns import bucket, ntz
from ..sources import readers
from ..sources.schemas import DAY, MONTH

#: Levels of pieces, each a folder of the view partitioned by the day (of a week: its Monday).
LEVELS = ("hour", "day", "week")
_KEYS = ["team", "product", "sentiment_label"]
_SUMS = {"rows": F.sum, "confidence_sum": F.sum, "confidences": F.sum}
_PIECE = ("piece timestamp_ntz, team string, product string, sentiment_label string, rows long, confidence_sum double, confidences long, "
          "made_of long, piece_date date")


def _read(spark: SparkSession, path: str, level: str) -> DataFrame:
    empty = spark.createDataFrame([], _PIECE)
    try:
        return spark.read.schema(empty.schema).parquet(f"{path}/{level}")
    except AnalysisException:               # before the first refresh
        return empty


def _partials(facts: DataFrame, *keys) -> DataFrame:
    return facts.groupBy(*keys, *_KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("confidence_score").alias("confidence_sum"), F.count("confidence_score").alias("confidences"))


def _merged(pieces: DataFrame, *keys) -> DataFrame:
    return pieces.groupBy(*keys, *_KEYS).agg(*[f(c).alias(c) for c, f in _SUMS.items()])


def _write(pieces: DataFrame, path: str, level: str) -> None:
    (pieces.select("piece", *_KEYS, *_SUMS, "made_of", "piece_date").hint("rebalance", "piece_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("piece_date").parquet(f"{path}/{level}"))


def changed_days(spark: SparkSession, fact_path: str, view_path: str, level: str = "hour") -> DataFrame:
    """(piece_date, made_of) of the days whose files are not those the pieces of ``level`` were made of; a day that
    the facts no longer have comes with 0.  Reads no column of the facts, but the day if their folders are months."""
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = readers.read_fact(spark, fact_path).select(F.col("event_date").alias("piece_date"), file.alias("file")).distinct()
    now = files.groupBy("piece_date").agg(F.bit_xor("file").alias("made_of"), F.count("*").alias("n")).select(
        "piece_date", F.xxhash64("made_of", "n").alias("made_of"))
    then = _read(spark, view_path, level).groupBy("piece_date").agg(F.max("made_of").alias("was"))
    both = now.join(then, now.piece_date.eqNullSafe(then.piece_date), "full")
    return both.select(F.coalesce(now.piece_date, then.piece_date).alias("piece_date"), F.coalesce("made_of", F.lit(0)).cast("long").alias("made_of"), "was").where(
        ~F.col("made_of").eqNullSafe(F.col("was"))).drop("was")


def of_days(table: DataFrame, days: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns and ``piece_date`` of a fact table's rows, and those rows of the days in ``days``, with its columns."""
    facts = table.select(*columns, F.col(DAY).alias("piece_date"))
    # One row per day is broadcast; the condition, true for every day, lets Spark prune the folders by it.
    some = days.where("piece_date >= DATE'0001-01-01'")
    if MONTH not in table.columns:
        return facts, facts.join(F.broadcast(some), "piece_date")
    by_month = table.select(*columns, F.col(DAY).alias("piece_date"), MONTH)
    return facts, by_month.join(F.broadcast(some.withColumn(MONTH, F.trunc("piece_date", "month"))), ["piece_date", MONTH]).drop(MONTH)


def refresh(spark: SparkSession, fact_path: str, view_path: str) -> DataFrame:
    """Bring the view up to date; returns the days that were recomputed (in a table beside the pieces).

    Only days whose files changed are read from the facts, and only the weeks they lie in are rebuilt, from
    day pieces.  A refresh that dies is simply run again: a level is replaced when its job commits, and the
    days of the hour pieces, which say what is done, are replaced last.
    """
    log = f"{view_path}/refreshed"
    changed_days(spark, fact_path, view_path).write.mode("overwrite").parquet(log)
    days = spark.read.schema("piece_date date, made_of long").parquet(log)
    if not days.limit(1).count():
        return days
    facts, dated = of_days(readers.read_fact(spark, fact_path), days, ["event_ts", "team", "product", "sentiment_label", "confidence_score"])
    undated = facts.where("piece_date IS NULL").join(F.broadcast(days.where("piece_date IS NULL").withColumnRenamed("piece_date", "_none")),
                                                     F.col("piece_date").eqNullSafe(F.col("_none"))).drop("_none")
    facts = dated.unionByName(undated)
    hours = _partials(facts, bucket("event_ts", "hour").alias("piece"), "piece_date", "made_of")
    # A day without rows any more keeps one row of none, so that its old pieces go.
    gone = days.where("made_of = 0").selectExpr("CAST(piece_date AS timestamp_ntz) AS piece", "piece_date", "made_of", "CAST(NULL AS string) AS team",
                                                "CAST(NULL AS string) AS product", "CAST(NULL AS string) AS sentiment_label", "0L AS rows",
                                                "CAST(NULL AS double) AS confidence_sum", "0L AS confidences")
    staged = f"{view_path}/staged"
    hours.unionByName(gone).write.mode("overwrite").parquet(staged)
    hours = spark.read.schema(_PIECE).parquet(staged)
    _write(_merged(hours.withColumn("piece", F.col("piece_date").cast("timestamp_ntz")), "piece", "piece_date", "made_of"), view_path, "day")
    monday = F.trunc("piece_date", "week")
    weeks = days.select(monday.alias("week")).distinct()
    whole = _read(spark, view_path, "day").withColumn("monday", monday)
    whole = whole.join(F.broadcast(weeks), whole.monday.eqNullSafe(weeks.week), "left_semi").withColumnRenamed("monday", "week")
    _write(_merged(whole.withColumn("piece", F.col("week").cast("timestamp_ntz")), "piece", "week").withColumnRenamed("week", "piece_date")
           .withColumn("made_of", F.lit(0).cast("long")), view_path, "week")
    _write(hours, view_path, "hour")
    return days


def _up(t: dt.datetime, level: str) -> dt.datetime:
    """The first start of a piece of the level at or after ``t``."""
    down = _down(t, level)
    step = {"hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1), "week": dt.timedelta(days=7)}[level]
    return down if down == t else down + step


def _down(t: dt.datetime, level: str) -> dt.datetime:
    t = t.replace(minute=0, second=0, microsecond=0)
    if level != "hour":
        t = t.replace(hour=0)
    return t - dt.timedelta(days=t.weekday()) if level == "week" else t


def cover(start: dt.datetime, end: dt.datetime, levels: tuple[str, ...]) -> list[tuple[str, dt.datetime, dt.datetime]]:
    """Half-open stretches (level or 'facts', from, to) that make up [start, end), largest pieces inside."""
    if not levels:
        return [("facts", start, end)] if start < end else []
    level = levels[-1]
    lo, hi = _up(start, level), _down(end, level)
    if lo >= hi:
        return cover(start, end, levels[:-1])
    return [*cover(start, lo, levels[:-1]), (level, lo, hi), *cover(hi, end, levels[:-1])]


def _moment(t) -> dt.datetime:
    return t if isinstance(t, dt.datetime) else dt.datetime.fromisoformat(str(t))


def pieces(spark: SparkSession, fact_path: str, view_path: str, start=None, end=None, unit: str = "hour") -> DataFrame:
    """(piece, team, product, sentiment_label, rows, confidence_sum, confidences) of the rows in [start, end]
    (F1: both ends belong to it), from pieces no larger than ``unit``."""
    levels = LEVELS[:LEVELS.index(unit) + 1]
    columns = ["piece", *_KEYS, *_SUMS]
    if start is None and end is None:
        return _read(spark, view_path, unit).where("rows > 0").select(columns)
    bottom, top = dt.datetime(1, 1, 1), dt.datetime(9999, 1, 3)          # a Monday and a Sunday of the calendar
    lo = _moment(start) if start is not None else bottom
    hi = _moment(end) + dt.timedelta(microseconds=1) if end is not None else top
    out = None
    for level, a, b in cover(lo, hi, levels):
        if level == "facts":
            rows = readers.read_fact(spark, fact_path)
            if MONTH in rows.columns:
                rows = rows.where((F.col(MONTH) >= F.trunc(F.lit(a.date()), "month")) & (F.col(MONTH) <= F.lit(b.date())))
            rows = rows.where((F.col("event_date") >= F.lit(a.date())) & (F.col("event_date") <= F.lit(b.date()))).where(
                (F.col("event_ts") >= ntz(str(a))) & (F.col("event_ts") < ntz(str(b))))
            part = _partials(rows, bucket("event_ts", "hour").alias("piece"))
        else:
            part = _read(spark, view_path, level).where("rows > 0")
            if a > bottom:
                part = part.where((F.col("piece_date") >= F.lit(a.date())) & (F.col("piece") >= ntz(str(a))))
            if b < top:
                part = part.where((F.col("piece_date") <= F.lit(b.date())) & (F.col("piece") < ntz(str(b))))
        out = part.select(columns) if out is None else out.unionByName(part.select(columns))
    return out if out is not None else _read(spark, view_path, "hour").limit(0).select(columns)


def _average() -> Column:
    return F.try_divide(F.sum("confidence_sum"), F.sum("confidences"))


def label_buckets(parts: DataFrame, unit: str = "hour") -> DataFrame:
    """A5 from pieces."""
    return parts.groupBy(bucket("piece", unit).alias("time"), "sentiment_label", "team", "product").agg(
        F.sum("rows").alias("count"), _average().alias("avg_confidence"))


def sentiment_timeseries(parts: DataFrame, unit: str = "hour", scheme: str = "m1") -> DataFrame:
    """A6 from pieces."""
    return parts.groupBy(bucket("piece", unit).alias("time"), "team", "product").agg(
        *[count_polarity_weighted("sentiment_label", p, scheme, "rows").alias(p) for p in ("positive", "neutral", "negative")],
        F.sum("rows").alias("total"), _average().alias("avg_confidence"))


def emotion_timeseries(parts: DataFrame, unit: str = "hour") -> DataFrame:
    """A7 from pieces."""
    lab = F.lower(F.col("sentiment_label"))
    return parts.groupBy(bucket("piece", unit).alias("time")).agg(
        *[F.sum(F.when(lab == e, F.col("rows")).otherwise(0)).alias(e) for e in EMOTIONS], F.sum("rows").alias("total"))
