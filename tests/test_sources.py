"""Readers on small files in the reference's exchange formats; sinks and partition pruning."""

import json
import os

from pyspark.sql import functions as F

from feedlens.operators import filters as FL, normalize as N, scoring as S
from feedlens.session import scratch_path
from feedlens.sources import layout, readers as RD, sinks as SK

CSV = (
    'Id,ProductId,UserId,ProfileName,HelpfulnessNumerator,HelpfulnessDenominator,Score,Time,Summary,Text,'
    'Customer_Type,Suggestions\n'
    '71,KETTLE-7,U90,"Ola, from the north",2,3,4,1700000000,Boils,"Quick, quiet and easy to clean",Trial,Longer cord\n'
    '72,LAMP-2,U91,"The ""lamp"" person",0,0,2,1700090000,Dim,"First line\nsecond ""quoted"" line",Premium,\n'
    '73,,U92,nobody,0,0,,some day,S,   ,Normal,\n')


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def _local(spark, name):
    p = scratch_path(spark, name)
    return p[len("file:"):] if p.startswith("file:") else p


def test_review_csv_quotes_commas_newlines(spark):
    d = _local(spark, "t-csv")
    _write(f"{d}/r.csv", CSV)
    df = RD.read_reviews_csv(spark, d)
    rows = {r.Id: r for r in df.collect()}
    assert len(rows) == 3
    assert rows["71"].Text == "Quick, quiet and easy to clean"
    assert rows["72"].ProfileName == 'The "lamp" person' and rows["72"].Text == 'First line\nsecond "quoted" line'
    kept = N.drop_blank_text(df)
    assert kept.count() == 2
    fb = {r.id: r for r in N.reviews_to_feedback(df, "2030-01-01 00:00:00").collect()}
    assert fb[73].product == "unknown" and str(fb[73].event_ts) == "2030-01-01 00:00:00"


def test_json_envelope_and_array(spark):
    d = _local(spark, "t-json")
    reviews = [{"Id": "1", "ProductId": "B1", "Score": 5.0, "Time": "1700000000", "Text": "great"},
               {"Id": "2", "ProductId": "B1", "Score": 1.0, "Text": "awful", "ProductName": "Widget"}]
    _write(f"{d}/env/e.json", json.dumps({"reviews": reviews, "group_by_product": True,
                                          "include_top_comments": True, "top_comments_per_category": 3},
                                         indent=2))
    _write(f"{d}/arr/a.json", json.dumps(reviews, indent=2))
    env = RD.read_reviews_json(spark, f"{d}/env")
    assert env.count() == 2 and env.first().top_comments_per_category == 3
    arr = RD.read_reviews_json_array(spark, f"{d}/arr")
    assert sorted(r.Text for r in arr.collect()) == ["awful", "great"]
    meta = json.loads(N.reviews_to_feedback(arr.where("Id = '2'"), "2030-01-01").first().metadata)
    assert meta["product_name"] == "Widget"


def test_feedback_csv(spark):
    d = _local(spark, "t-fcsv")
    _write(f"{d}/f.csv", 'text,product,timestamp,team\n"Great, really",ProductA,2024-01-15T10:30:00,sales\n')
    r = RD.read_feedback_csv(spark, d).first()
    assert r.text == "Great, really" and r.team == "sales"


def test_fact_append_overwrite_and_partition_pruning(spark):
    base = spark.createDataFrame(
        [(i, f"text {i}", "2024-01-0%d 10:00:00" % (1 + i % 3), "p") for i in range(9)],
        "id long, text string, ts string, product string") \
        .select("id", "text", F.col("ts").cast("timestamp_ntz").alias("event_ts"), "product",
                F.lit(None).cast("string").alias("team"), F.lit("{}").alias("metadata"))
    scored = S.lexicon_scorer(base)
    path = scratch_path(spark, "t-fact")
    SK.write_results(scored, path)
    SK.write_results(scored, path)
    assert RD.read_fact(spark, path).count() == 18
    SK.overwrite_results(scored, path)
    f = RD.read_fact(spark, path)
    assert f.count() == 9
    pruned = f.where(F.col("event_date") == F.lit("2024-01-02").cast("date"))
    assert pruned.count() == 3
    assert "PartitionFilters: [isnotnull(event_date" in pruned._jdf.queryExecution().executedPlan().toString()
    rep = SK.ingest_report(base, F.col("id") < 6).first()
    assert (rep.received, rep.processed, rep.failed) == (9, 6, 3)
    assert sorted(r.id for r in SK.rejects(base, F.col("id") < 6).collect()) == [6, 7, 8]


def test_dynamic_overwrite_replaces_only_its_days(spark):
    def rows(day, n):
        return spark.range(n).select("id", F.lit("great").alias("text"), F.lit(f"{day} 10:00:00").cast("timestamp_ntz").alias("event_ts"),
                                     F.lit("p").alias("product"), F.lit(None).cast("string").alias("team"), F.lit("{}").alias("metadata"))
    path = scratch_path(spark, "t-dynamic")
    SK.write_results(S.lexicon_scorer(rows("2024-01-01", 3).union(rows("2024-01-02", 4))), path)
    SK.overwrite_results(S.lexicon_scorer(rows("2024-01-02", 1)), path, dynamic=True)
    counts = {str(r.event_date): r["count"] for r in RD.read_fact(spark, path).groupBy("event_date").count().collect()}
    assert counts == {"2024-01-01": 3, "2024-01-02": 1}


def _days(spark, n, first="2024-01-01"):
    return spark.range(n).select("id", F.lit("great").alias("text"), F.expr(f"TIMESTAMP_NTZ'{first} 10:00:00' + id * INTERVAL '1' DAY").alias("event_ts"),
                                 F.lit("p").alias("product"), F.lit(None).cast("string").alias("team"), F.lit("{}").alias("metadata"))


def test_folders_are_listed_in_few_tasks(spark):
    """a few tasks per core list the folders, not one task each."""
    path = scratch_path(spark, "t-listing")
    cores = spark.sparkContext.defaultParallelism
    n = 4 * cores + 40
    SK.write_results(S.lexicon_scorer(_days(spark, n)), path)
    spark.sparkContext.setJobGroup("t-listing", "listing")
    try:
        RD.read_fact(spark, path)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    track = spark.sparkContext.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("t-listing") for s in track.getJobInfo(j).stageIds]
    assert stages and sum(s.numTasks for s in stages) <= 4 * cores
    assert spark.conf.get(RD.LISTING_TASKS, None) is None            # the session is as it was
    spark.conf.set(RD.LISTING_TASKS, "3")
    try:
        assert RD.read_fact(spark, path).count() == n and spark.conf.get(RD.LISTING_TASKS) == "3"
    finally:
        spark.conf.unset(RD.LISTING_TASKS)


def _contents(spark, path):
    return sorted((r.id, str(r.event_date), r.text) for r in RD.read_fact(spark, path).collect())


def test_many_days_of_few_rows_share_folders(spark, monkeypatch):
    """a folder per month if there are many days of few rows; every later write keeps to the table's folders."""
    path = scratch_path(spark, "t-months")
    monkeypatch.setattr(SK, "SPARSE_DAYS", 90)
    rows = _days(spark, 400).withColumn("event_ts", F.when(F.col("id") < 399, F.col("event_ts")))       # one without a time
    scored = S.lexicon_scorer(rows)
    folders = lambda: sorted(d for d in os.listdir(path) if "=" in d)
    SK.write_results(scored, path)
    assert len(folders()) == 15 and all(d.startswith("event_month=") for d in folders())                # 14 months and no month
    once = _contents(spark, path)
    assert [i for i, _, _ in once] == list(range(400)) and once[31][1] == "2024-02-01"
    SK.write_results(scored.where("id < 5"), path)                   # few days, but the table has months
    assert len(folders()) == 15 and RD.read_fact(spark, path).count() == 405
    SK.overwrite_results(scored, path)
    assert _contents(spark, path) == once
    # Only the days that the rows have are replaced, not their months.
    new = scored.where("id IN (3, 40, 399)").withColumn("text", F.lit("new"))
    expect = [(i, d, "new" if i in (3, 40, 399) else t) for i, d, t in once]
    SK.overwrite_results(new, path, dynamic=True)
    assert _contents(spark, path) == expect
    layout.write_clustered(new.withColumn("text", F.lit("clustered")), path, replace_days=True)
    expect = [(i, d, "clustered" if i in (3, 40, 399) else t) for i, d, t in expect]
    assert _contents(spark, path) == expect and len(folders()) == 15
    for k in range(1, 4):                                            # February lies in four files
        SK.write_results(scored.where("id BETWEEN 31 AND 59").withColumn("id", F.col("id") + 1000 * k), path)
    before, files = _contents(spark, path), lambda: {r.f: str(r.m) for r in RD.read_fact(spark, path).select(
        F.col("_metadata.file_path").alias("f"), F.col("event_month").alias("m")).distinct().collect()}
    old = files()
    layout.compact(spark, path, files=1)
    assert _contents(spark, path) == before and {m for f, m in old.items() if f not in files()} == {"2024-02-01"}
    assert list(files().values()).count("2024-02-01") == 1
    # Bounds on the time prune the months.
    some = FL.time_range(RD.read_fact(spark, path), "2024-03-05 00:00:00", "2024-04-02 23:00:00")
    assert some.count() == 29
    assert "PartitionFilters: [isnotnull(event_month" in some._jdf.queryExecution().executedPlan().toString()
    # Written anew with few days, or with many rows a day, it has a folder per day again.
    SK.overwrite_results(scored.where("id < 5"), path)
    assert folders() == [f"event_date=2024-01-0{k}" for k in range(1, 6)]
    monkeypatch.setattr(SK, "SPARSE_ROWS", 1)
    SK.overwrite_results(scored, path)
    assert len(folders()) == 400


def test_clear_scratch(spark):
    from feedlens.session import clear_scratch
    path = scratch_path(spark, "t-clear")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    other = _local(spark, "x")
    clear_scratch(spark)
    assert not os.path.exists(os.path.dirname(other))


def test_write_results_dedupe(spark):
    base = spark.createDataFrame(
        [(i % 3, f"t{i}", "2024-01-01 10:00:00", "p") for i in range(12)],
        "id long, text string, ts string, product string") \
        .select("id", "text", F.col("ts").cast("timestamp_ntz").alias("event_ts"), "product",
                F.lit(None).cast("string").alias("team"), F.lit("{}").alias("metadata"))
    path = scratch_path(spark, "t-dedupe")
    SK.write_results(S.lexicon_scorer(base), path, dedupe_on=["id"])
    assert RD.read_fact(spark, path).count() == 3


def _make_scorer():
    return S.PandasLexiconScorer()


def test_scorer_and_factories_agree(spark):
    df = spark.createDataFrame([(i, "great" if i % 2 else "sad") for i in range(40)], "id long, text string").repartition(4)
    want = {i: "joy" if i % 2 else "sadness" for i in range(40)}
    for kw in ({"factory": S.PandasLexiconScorer}, {"factory": _make_scorer}, {"factory": lambda: S.PandasLexiconScorer()},
               {"scorer": S.PandasLexiconScorer()}, {}):
        out = S.score_with(df, keep_scores=True, **kw).collect()
        assert {r.id: r.sentiment_label for r in out} == want
        assert all(abs(r.all_scores[r.sentiment_label] - r.confidence_score) < 1e-12 for r in out)


def test_json_lines_hold_every_review(spark):
    rows = spark.createDataFrame([(str(i % 7), f"text {i % 3}") for i in range(25)], "Id string, Text string")
    path = scratch_path(spark, "t-lines")
    SK.write_review_envelopes(rows.coalesce(2), f"{path}/env", size=4)
    SK.write_review_arrays(rows.coalesce(2), f"{path}/arr", size=4)
    want = sorted((r.Id, r.Text) for r in rows.collect())
    assert sorted((r.Id, r.Text) for r in RD.read_reviews_json(spark, f"{path}/env", multiline=False).collect()) == want
    assert sorted((r.Id, r.Text) for r in RD.read_reviews_json_array(spark, f"{path}/arr", multiline=False).collect()) == want


def test_packing_lines_holds_one_line(spark):
    """A batch is packed line by line; its items are never all held as strings."""
    import tracemalloc

    import pyarrow as pa

    items = [pa.array([f'"{k}-{i}' + "x" * 5_000 + '"' for i in range(4_001)]) for k in range(2)]
    tracemalloc.start()
    sizes = [len(json.loads(line)) for line in SK._packed_lines(iter(items), 10, "[", "]")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [10] * 800 + [2] and peak < 1 << 20
    path = scratch_path(spark, "t-lines")
    SK.write_review_arrays(spark.range(0, 25, 1, 2).select(F.col("id").cast("string").alias("Id")), path, size=10)
    assert sorted(len(json.loads(r.value)) for r in spark.read.text(path).collect()) == [2, 3, 10, 10]
