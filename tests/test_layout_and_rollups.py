"""Clustered layout, compaction and incremental series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from feedlens.operators import rollups as RU, timeseries as TS
from feedlens.session import scratch_path
from feedlens.sources import layout, readers as RD, sinks as SK

SCHEMA = "id long, text string, sentiment_label string, confidence_score double, event_ts timestamp_ntz, team string, product string"
LABELS = ["joy", "anger", "neutral", "sadness", None]


def _rows(n, days, seed=1, first=0):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(first + i, f"text {i}", r.choice(LABELS), r.choice([None, r.random()]), start + dt.timedelta(seconds=r.randrange(days * 86400)),
             r.choice(["a", "b", None]), r.choice([f"P{k}" for k in range(40)] + ["hot"] * 40 + [None])) for i in range(n)]


def _files(spark, path):
    return {r.file: str(r.event_date) for r in RD.read_fact(spark, path).select("event_date", F.col("_metadata.file_path").alias("file")).distinct().collect()}


def _scanned(df) -> int:
    """Rows that the file scan handed on: those of the row groups it had to read."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    while node.getClass().getSimpleName() != "FileSourceScanExec":
        node = node.plan() if node.getClass().getSimpleName().endswith("QueryStageExec") else node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


def _canon(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_compaction_keeps_rows_and_prunes_row_groups(spark):
    path = scratch_path(spark, "t-compact")
    rows = spark.createDataFrame(_rows(60_000, 2), SCHEMA).cache()
    for k in range(6):
        SK.write_results(rows.where(F.col("id") % 6 == k), path)
    SK.write_results(spark.createDataFrame(_rows(50, 1, 3, 10 ** 6), SCHEMA).withColumn("event_ts", F.expr("event_ts + INTERVAL 30 DAY")), path)
    before, old = _canon(RD.read_fact(spark, path)), _files(spark, path)
    one = RD.read_fact(spark, path).where("product = 'P7'").select("id", "product")
    assert _scanned(one) > 55_000                                    # every row group holds the product
    layout.compact(spark, path, files=4, row_group_bytes=8 << 10, products=100)
    new = _files(spark, path)
    assert _canon(RD.read_fact(spark, path)) == before
    alone = [f for f, day in old.items() if day == "2024-01-31"]
    assert alone and all(f in new for f in alone)                    # a day of one file is left alone
    assert not set(new) & {f for f, day in old.items() if day != "2024-01-31"} and len(new) < len(old)
    one = RD.read_fact(spark, path).where("product = 'P7'").select("id", "product")
    found = _scanned(one)
    assert one.count() == rows.where("product = 'P7'").count() and found < 60_000 / 5, found
    layout.compact(spark, path, small_files=100)                     # nothing to do
    assert _files(spark, path) == new
    rows.unpersist()


def test_a_hot_product_is_cut_over_files(spark):
    """A product with half of all rows of one day spreads over the range partitions."""
    path = scratch_path(spark, "t-hot-files")
    rows = spark.createDataFrame(_rows(20_000, 1), SCHEMA)
    layout.write_clustered(rows, path, files=8)
    sizes = [r["count"] for r in RD.read_fact(spark, path).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2.2 * 20_000 / 8


def _same_series(spark, facts, view, start=None, end=None):
    table = RD.read_fact(spark, facts)
    for unit in RU.LEVELS:
        parts = RU.pieces(spark, facts, view, start, end, unit)
        nine = lambda df: df.withColumn("avg_confidence", F.round("avg_confidence", 9))
        assert _canon(nine(RU.sentiment_timeseries(parts, unit))) == _canon(nine(TS.sentiment_timeseries(table, start, end, unit)))
    assert _canon(nine(RU.label_buckets(parts, unit))) == _canon(nine(TS.label_buckets(table, start, end, unit)))
    assert _canon(RU.emotion_timeseries(parts, unit)) == _canon(TS.emotion_timeseries(table, start, end, unit))


def test_incremental_series(spark):
    base = scratch_path(spark, "t-rollup")
    facts, view = f"{base}/facts", f"{base}/view"
    SK.write_results(spark.createDataFrame(_rows(3000, 20), SCHEMA).union(spark.createDataFrame(_rows(5, 1, 9, 9000), SCHEMA).withColumn(
        "event_ts", F.lit(None).cast("timestamp_ntz"))), facts)
    assert RU.refresh(spark, facts, view).count() == 21              # 20 days and the rows without a time
    _same_series(spark, facts, view)
    pieces = lambda: {r.f for r in spark.read.parquet(f"{view}/hour").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    old = pieces()
    late = [(10_000 + i, "late", "joy", 0.5, dt.datetime(2024, 1, 4, i % 24, 30), "a", "P1") for i in range(30)]
    SK.write_results(spark.createDataFrame(late + _rows(200, 2, 5, 20_000), SCHEMA).withColumn(
        "event_ts", F.when(F.col("id") >= 20_000, F.expr("event_ts + INTERVAL 25 DAY")).otherwise(F.col("event_ts"))), facts)
    days = {str(r.piece_date) for r in RU.refresh(spark, facts, view).collect()}
    assert days == {"2024-01-04", "2024-01-26", "2024-01-27"}        # only days that changed
    kept = [f for f in old if not any(d in f for d in days)]
    assert kept and set(kept) <= pieces()                            # the pieces of the others were not touched
    assert RU.refresh(spark, facts, view).count() == 0
    for start, end in ((None, None), ("2024-01-03 10:30:00", "2024-01-27 05:15:30"), ("2024-01-05 00:00:00", "2024-01-05 00:00:00"),
                       ("2024-01-09 03:00:00", None), (None, "2024-01-20 23:59:59.999999"), ("2024-01-04 03:10:00", "2024-01-04 03:50:00")):
        _same_series(spark, facts, view, start, end)
    # A day whose rows were replaced, and the table written anew without some days.
    SK.overwrite_results(RD.read_fact(spark, facts).where("event_date = DATE'2024-01-06' AND id % 2 = 0"), facts, dynamic=True)
    assert [str(r.piece_date) for r in RU.refresh(spark, facts, view).collect()] == ["2024-01-06"]
    _same_series(spark, facts, view)
    SK.overwrite_results(spark.createDataFrame(_rows(100, 3, 7), SCHEMA), facts)
    RU.refresh(spark, facts, view)
    _same_series(spark, facts, view)
    assert RU.refresh(spark, facts, view).count() == 0


def test_incremental_series_of_a_table_by_month(spark, monkeypatch):
    monkeypatch.setattr(SK, "SPARSE_DAYS", 10)
    base = scratch_path(spark, "t-rollup-months")
    facts, view = f"{base}/facts", f"{base}/view"
    SK.write_results(spark.createDataFrame(_rows(600, 100), SCHEMA).union(spark.createDataFrame(_rows(5, 1, 9, 9000), SCHEMA).withColumn(
        "event_ts", F.lit(None).cast("timestamp_ntz"))), facts)
    assert "event_month" in RD.read_fact(spark, facts).columns
    RU.refresh(spark, facts, view)
    _same_series(spark, facts, view)
    SK.write_results(spark.createDataFrame([(10_000, "late", "joy", 0.5, dt.datetime(2024, 2, 4, 3, 30), "a", "P1")], SCHEMA), facts)
    assert [str(r.piece_date) for r in RU.refresh(spark, facts, view).collect()] == ["2024-02-04"]
    for start, end in ((None, None), ("2024-01-03 10:30:00", "2024-02-27 05:15:30"), ("2024-02-04 03:10:00", "2024-02-04 03:50:00")):
        _same_series(spark, facts, view, start, end)
    assert RU.refresh(spark, facts, view).count() == 0


@pytest.mark.parametrize("start,end", [((2024, 1, 3, 10, 30), (2024, 2, 20, 5, 15)), ((2024, 1, 1), (2024, 1, 8)), ((2024, 1, 1, 5, 1), (2024, 1, 1, 5, 2)),
                                       ((2024, 1, 2), (2024, 1, 2))])
def test_cover(start, end):
    start, end = dt.datetime(*start), dt.datetime(*end)
    got = RU.cover(start, end, RU.LEVELS)
    at = start
    for level, a, b in got:
        assert a == at and a < b
        at = b
        if level == "week":
            assert a.weekday() == 0 and b.weekday() == 0
        if level in ("day", "week"):
            assert a.hour == b.hour == 0
        if level != "facts":
            assert a.minute == b.minute == 0
    assert at == end or not got and start == end
    assert all((b - a) < dt.timedelta(hours=1) for level, a, b in got if level == "facts")
