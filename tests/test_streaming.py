"""Stateful streaming semantics across two availableNow runs sharing one checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from feedlens.operators import normalize as N
from feedlens.session import scratch_path
from feedlens.sources import known_ids, readers as RD, sinks as SK
from feedlens.sources.schemas import FACT_SCHEMA
from feedlens.streaming import streams as ST

SCHEMA = ("id long, text string, sentiment_label string, confidence_score double, "
          "event_ts timestamp_ntz, team string, product string")


def _drain(spark, sdf, base):
    q = (sdf.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()


def _batch(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


REVIEWS = "Id string, ProductId string, UserId string, ProfileName string, HelpfulnessNumerator int, HelpfulnessDenominator int, " \
          "Score double, Time string, Summary string, Text string, Customer_Type string"


def _review(k, text, time):
    return (str(k), f"P{k % 3}", "u", "n", 1, 2, 4.0, time, "s", text, "Normal")


def _import(spark, files, base):
    """Each list of reviews as one file and one micro-batch."""
    src = f"{base}/src"
    for rows in files:
        spark.createDataFrame(rows, REVIEWS).coalesce(1).write.mode("append").json(src)
    sdf = spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", 1).json(src)
    ST.stream_reviews(sdf, f"{base}/table", f"{base}/ck", "2024-06-01 00:00:00").trigger(availableNow=True).start().awaitTermination()
    return RD.read_fact(spark, f"{base}/table")


def test_import_loses_no_late_review(spark):
    days = [[_review(10 * d + k, f"great day {d} {k}", f"2024-01-{10 + 3 * d:02d}T0{k}:00:00Z") for k in range(5)] for d in range(4)]
    days[2].append(_review(1000, "  ", "2024-01-01T00:00:00Z"))                       # blank: P8
    out = []
    for name, order in (("asc", days), ("desc", days[::-1])):
        f = _import(spark, order, scratch_path(spark, f"t-import-{name}"))
        out.append(sorted((r.id, r.text, r.sentiment_label, str(r.event_ts), r.product) for r in f.collect()))
    assert out[0] == out[1] and len(out[0]) == 20


def test_import_takes_a_review_once_per_day(spark):
    base = scratch_path(spark, "t-import-again")
    first = [_review(1, "great product", "2024-01-01T10:00:00Z"), _review(2, "awful", "2024-01-01T10:00:00Z"), _review(1, "great product", "2024-01-01T10:00:00Z")]
    again = [_review(1, "great product", "2024-01-01T11:00:00Z"), _review(3, "fine", "2024-01-01T11:00:00Z"), _review(1, "next day", "2024-01-02T11:00:00Z")]
    f = _import(spark, [first, again], base)
    assert sorted((r.id, str(r.event_date)) for r in f.collect()) == [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-01"), (3, "2024-01-01")]


def test_windows_close_once_and_late_rows_are_dropped(spark):
    base = scratch_path(spark, "t-stream-late")
    src = f"{base}/src"
    h = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    _batch(spark, [(i, "x", "joy", 1.0, h(i), "t", "p") for i in range(6)], src)
    sdf = lambda: ST.stream_timeseries(spark.readStream.schema(SCHEMA).parquet(src), "hour", "1 hour")
    _drain(spark, sdf(), base)
    first = {r.time: r.total for r in spark.read.parquet(f"{base}/out").collect()}
    assert max(first) == h(3)          # watermark = 05:00 - 1h: windows ending <= 04:00 closed
    # a late row for 01:00 (behind the watermark) and new rows moving time on
    _batch(spark, [(100, "late", "anger", 1.0, h(1) + dt.timedelta(minutes=5), "t", "p")]
           + [(200 + i, "y", "joy", 1.0, h(6 + i), "t", "p") for i in range(3)], src)
    _drain(spark, sdf(), base)
    out = spark.read.parquet(f"{base}/out").groupBy("time").agg(F.sum("total").alias("n"),
                                                               F.count(F.lit(1)).alias("emits"))
    got = {r.time: (r.n, r.emits) for r in out.collect()}
    assert got[h(1)] == (1, 1)         # late row ignored, window emitted exactly once
    assert max(got) == h(6)


def test_import_again_appends_nothing_and_reads_by_bitmap(spark):
    """A batch that runs again after it died between the bitmaps and the rows, and once more when all is done."""
    base = scratch_path(spark, "t-import-rerun")
    table = f"{base}/table"
    rows = [_review(k, f"great {k}", f"2024-01-1{k % 3}T0{k % 10}:00:00Z") for k in range(40)] + [_review(3, "great 3", "2024-01-10T03:00:00Z")]
    reviews = spark.createDataFrame(rows, REVIEWS)
    SK.write_results(spark.createDataFrame([], FACT_SCHEMA).drop("text_length"), table)
    facts = N.reviews_to_feedback(N.drop_blank_text(reviews), "2024-06-01 00:00:00")
    known_ids.ensure(spark, table)
    known_ids.add(facts.select("id", F.to_date("event_ts").alias("event_date")), table)         # died here
    for _ in range(2):
        ST.import_batch(reviews, table, "2024-06-01 00:00:00")
        got = sorted((r.id, r.text) for r in RD.read_fact(spark, table).collect())
        assert got == [(k, f"great {k}") for k in range(40)]
    maybe = lambda ids: known_ids.maybe_known(spark.createDataFrame([(i, dt.date(2024, 1, 10)) for i in ids], "id long, event_date date"),
                                              table, dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    assert {r.id for r in maybe([0, 3, 6]).collect()} == {0, 3, 6} and maybe(range(1000, 1100)).count() <= 2
    known_ids.compact(spark, table)
    assert {r.id for r in maybe([0, 3, 6]).collect()} == {0, 3, 6}
    ST.import_batch(reviews, table, "2024-06-01 00:00:00")
    assert RD.read_fact(spark, table).count() == 40


def test_import_sorts_no_unique_reviews(spark):
    """Only copies are ranked: no aggregate or sort carries the texts of all rows."""
    base = scratch_path(spark, "t-import-plan")
    rows = [_review(k, f"t {k}", "2024-01-10T03:00:00Z") for k in range(50)] + [_review(7, "copy", "2024-01-10T01:00:00Z")]
    facts = N.reviews_to_feedback(N.drop_blank_text(spark.createDataFrame(rows, REVIEWS)), "2024-06-01 00:00:00")
    one = ST.first_per_day(facts.withColumn("event_date", F.to_date("event_ts")))
    p = one._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in p and not [x for x in p.splitlines() if "SortAggregate" in x and "text#" in x]
    assert sorted((r.id, r.text) for r in one.collect()) == sorted([(k, f"t {k}") for k in range(50) if k != 7] + [(7, "copy")])


def test_spikes_count_a_row_once(spark):
    """Rows enter day panes, and only panes enter the seven windows; late rows behind the watermark stay out."""
    base = scratch_path(spark, "t-panes")
    src = f"{base}/src"
    day = lambda k, h=1: dt.datetime(2024, 1, 1) + dt.timedelta(days=k, hours=h)
    rows = [(100 * d + i, "x", "anger" if i % 4 else "joy", 1.0, day(d, i % 20), "t", f"P{i % 2}") for d in range(20) for i in range(40)]
    _batch(spark, rows, src)
    _batch(spark, [(9000, "late", "joy", 1.0, day(2), "t", "P0")], src)
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.stream_spikes(sdf, 7, 1, "1 day").writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    updated = [[s["numRowsUpdated"] for s in p["stateOperators"]] for p in q.recentProgress]
    panes = max(u[1] for u in updated if len(u) == 2), max(u[0] for u in updated if len(u) == 2)
    assert min(panes) <= 20 * 2 + 1                                     # one entry per (day, product), not per row or window
    got = {(r.window_start, r.product): (r.total, r.negative) for r in spark.read.parquet(f"{base}/out").collect()}
    want = {}
    for _, _, label, _, ts, _, product in rows:
        for k in range(7):
            key = (dt.datetime(ts.year, ts.month, ts.day) - dt.timedelta(days=k), product)
            n, neg = want.get(key, (0, 0))
            want[key] = (n + 1, neg + (label == "anger"))
    end = max(r[4] for r in rows) - dt.timedelta(days=1)
    want = {k: v for k, v in want.items() if k[0] + dt.timedelta(days=7) <= end and v[0] >= 3 and v[1] / v[0] >= 0.7}
    assert got == want and got


def test_id_bitmaps_take_a_folder_per_month(spark):
    """Many days of few ids, rows without a day among them: folders grow with the months, and the answers stay."""
    path = f"{scratch_path(spark, 't-id-months')}/table"
    day = lambda i: None if i % 400 == 0 else dt.date(2024, 1, 1) + dt.timedelta(days=i % 400)
    rows = [(i, day(i)) for i in range(800)]
    known_ids.add(spark.createDataFrame(rows, "id long, event_date date"), path)
    folders = {f.rsplit("/", 2)[1] for f in spark.read.parquet(f"{path}_ids").inputFiles()}
    assert len(folders) <= 15
    for _ in range(2):
        asked = spark.createDataFrame(rows + [(i + 1, day(i)) for i, _ in rows], "id long, event_date date")
        got = {(r.id, r.event_date) for r in known_ids.maybe_known(asked, path, dt.date(2024, 2, 10), dt.date(2024, 11, 20)).collect()}
        want = {(i, d) for i, d in rows if d is None or dt.date(2024, 2, 10) <= d <= dt.date(2024, 11, 20)}
        assert want <= got and len(got) <= len(want) + 2
        known_ids.compact(spark, path)
