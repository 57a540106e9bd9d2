"""Streaming re-aims of the reference's per-request paths.

* T1 ``stream_reviews``    continuous import: each micro-batch of review rows is normalised (P1–P6, P8),
                           de-duplicated, scored and appended to the fact table.  A review that is
                           already in the table on the same day is not appended again; nothing is
                           dropped for coming late.
* T2 ``stream_timeseries`` tumbling hour / day / week windows with M1 counts; state is bounded by
                           the watermark and each window is emitted once, when it closes.
* T3 ``stream_spikes``     sliding per-product windows (default 7 days every day) raising the
                           escalation-spike rule of R3; day panes are counted once and then shared
                           by the windows that cover them.

Event time stays TIMESTAMP_NTZ in the data; the watermark needs an instant, so ``event_time`` is
derived without touching the session time zone and windows are reported back as NTZ.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.bitmaps import flagged
from ..functions.labels import count_polarity, polarity
from ..functions.numeric import pct
from ..functions.timefns import instant_to_ntz, ntz_to_instant
from ..operators import normalize, scoring
from ..operators.filters import DATE_COLUMN
from ..session import scratch_path
from ..sources import known_ids, readers, sinks
from ..sources.schemas import FACT_SCHEMA

WINDOW_OF = {"hour": ("1 hour", None), "day": ("1 day", None), "week": ("7 days", "4 days")}


def with_event_time(sdf: DataFrame, delay: str, col: str = "event_ts") -> DataFrame:
    return sdf.withColumn("event_time", ntz_to_instant(F.col(col))).withWatermark("event_time", delay)


def first_per_day(facts: DataFrame) -> DataFrame:
    """The first row of each (id, event_date).  Ids are counted by a narrow aggregate; rows whose id comes once, nearly all
    as a rule, pass as they are, and only copies are shuffled and ranked."""
    keys = ["id", DATE_COLUMN]
    twice = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = flagged(facts, twice, keys, "_copy")
    order = Window.partitionBy(*keys).orderBy("event_ts", F.xxhash64("text", "product", "team", "metadata"))
    copies = split.where("_copy").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return split.where("NOT _copy").unionByName(copies).drop("_copy")


def new_reviews(facts: DataFrame, path: str) -> DataFrame:
    """The first of each (id, day) among normalised rows that the fact table at ``path`` does not have.

    The ids' bitmaps beside the table say which ids it may have; it is read only if there are any, and for
    the days of the batch (their bounds are one row on the driver)."""
    spark = facts.sparkSession
    keys = ["id", DATE_COLUMN]
    one = first_per_day(facts.withColumn(DATE_COLUMN, F.to_date("event_ts")))
    first, last = facts.agg(F.to_date(F.min("event_ts")), F.to_date(F.max("event_ts"))).first()
    maybe = known_ids.maybe_known(one.select(*keys), path, first, last)
    if not maybe.limit(1).count():
        return one.drop(DATE_COLUMN)
    days = F.col(DATE_COLUMN).between(F.lit(first), F.lit(last)) | F.col(DATE_COLUMN).isNull()
    table = readers.read_fact(spark, path, keys).where(days)
    same = maybe.id.eqNullSafe(table.id) & maybe[DATE_COLUMN].eqNullSafe(table[DATE_COLUMN])
    known = maybe.join(table, same, "left_semi")
    split = flagged(one, known, keys, "_known")
    known = known.select(F.col("id").alias("_id"), F.col(DATE_COLUMN).alias("_day"))
    fresh = split.where("_known").join(known, F.col("id").eqNullSafe(F.col("_id")) & F.col(DATE_COLUMN).eqNullSafe(F.col("_day")), "left_anti")
    return split.where("NOT _known").unionByName(fresh).drop("_known", DATE_COLUMN)


def import_batch(reviews: DataFrame, path: str, as_of, scorer: str = "lexicon") -> None:
    """One micro-batch of T1 (or one batch import): P8, P1–P6, de-duplication, score, append.

    Running a batch again after a failure appends only what is missing."""
    facts = normalize.reviews_to_feedback(normalize.drop_blank_text(reviews), as_of)
    known_ids.ensure(facts.sparkSession, path)
    fresh = new_reviews(facts, path)                # from the bitmaps as they are now
    known_ids.add(facts.select("id", F.to_date("event_ts").alias(DATE_COLUMN)), path)
    if scorer == "lexicon":
        scored = scoring.lexicon_scorer(fresh)
    else:
        scored = scoring.rating_scorer(fresh.withColumn("score", F.get_json_object("metadata", "$.rating").cast("double")))
    sinks.write_results(scored, path)


def stream_reviews(sdf: DataFrame, path: str, checkpoint: str, as_of, scorer: str = "lexicon"):
    """A stream of review rows into the fact table at ``path``; returns the ``DataStreamWriter``.

    There is no watermark and no state: de-duplication looks into the table itself."""
    spark = sdf.sparkSession
    empty = spark.createDataFrame([], FACT_SCHEMA)
    sinks.write_results(empty.drop("text_length"), path)                # so that the first batch has a table to read
    return sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: import_batch(batch, path, as_of, scorer))


def stream_timeseries(sdf: DataFrame, group_by: str = "hour", delay: str = "1 hour") -> DataFrame:
    """Windowed A6 counts per (window, team, product), emitted when the window closes."""
    dur, start = WINDOW_OF[group_by]
    w = F.window("event_time", dur, startTime=start) if start else F.window("event_time", dur)
    g = with_event_time(sdf, delay).groupBy(w.alias("w"), "team", "product").agg(
        count_polarity("sentiment_label", "positive", "m1").alias("positive"),
        count_polarity("sentiment_label", "neutral", "m1").alias("neutral"),
        count_polarity("sentiment_label", "negative", "m1").alias("negative"),
        F.count(F.lit(1)).alias("total"), F.avg("confidence_score").alias("avg_confidence"))
    return g.select(instant_to_ntz(F.col("w.start")).alias("time"), "team", "product", "positive",
                    "neutral", "negative", "total", "avg_confidence")


def stream_spikes(sdf: DataFrame, window_days: int = 7, slide_days: int = 1, delay: str = "1 day",
                  min_rows: int = 3, min_pct: float = 70.0) -> DataFrame:
    """Per product and sliding window, rows and negative share; keeps the spiking windows.

    Two chained stateful aggregates: rows are counted once in panes (tumbling windows as long as both the
    window and the slide are multiples of), and a closed pane, one row per product, enters the windows that
    cover it.  So a row touches one state entry instead of one per window."""
    pane = F.window("event_time", f"{math.gcd(window_days, slide_days)} days")
    d = with_event_time(sdf.where(F.col("product").isNotNull() & (F.col("product") != "")), delay)
    panes = d.groupBy(pane.alias("pane"), "product").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(polarity("sentiment_label", "m1") == "negative").alias("negative"))
    w = F.window(F.window_time("pane"), f"{window_days} days", f"{slide_days} days")
    g = panes.groupBy(w.alias("w"), "product").agg(F.sum("total").alias("total"), F.sum("negative").alias("negative"))
    neg_pct = pct(F.col("negative"), F.col("total"))
    return (g.where((F.col("total") >= min_rows) & (neg_pct >= min_pct))
             .select(instant_to_ntz(F.col("w.start")).alias("window_start"),
                     instant_to_ntz(F.col("w.end")).alias("window_end"), "product", "total", "negative",
                     neg_pct.alias("negative_percentage")))


def run_to_table(spark: SparkSession, result: DataFrame, name: str,
                 output_mode: str = "append") -> DataFrame:
    """Drain every available input of a streaming query into a parquet table below the
    checkpoint folder (exactly-once file sink + checkpoint) and return a batch read of it."""
    base = scratch_path(spark, name)
    q = (result.writeStream.outputMode(output_mode).format("parquet")
         .option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/table")


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A parquet table of the driver's folder as a file stream (schema from the batch reader)."""
    path = f"{sf_dir.rstrip('/')}/{name}[.]parquet"        # glob: the stream source needs a pattern
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)
