"""Malformed input rows, deep pages and per-day sketches."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from feedlens.operators import normalize as N, products as P, ranking as RK, sketches as SKT
from feedlens.session import scratch_path
from feedlens.sources import readers as RD, sinks as SK


def _file(spark, name, text):
    path = scratch_path(spark, name)
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/part.txt", "w") as fh:
        fh.write(text)
    return path


HEADER = "Id,ProductId,UserId,ProfileName,HelpfulnessNumerator,HelpfulnessDenominator,Score,Time,Summary,Text,Customer_Type,Suggestions"


def test_malformed_csv_rows_are_told(spark):
    path = _file(spark, "t-checked-csv", f'{HEADER}\n1,P,u,n,1,2,5,0,s,"good, text",Normal,x\n2,P,u\n3,P,u,n,many,2,5,0,s,text,Normal,x\n'
                                         '4,P,u,n,1,2,5,0,s,   ,Normal,x\n5,P,u,n,1,2,5,0,s,a,Normal,x,one too many\n6,P,u,n,1,2,5,0,s,"b ""c""",Normal,x\n')
    checked = RD.read_checked(spark, path, "csv")
    good, bad = SK.split_rejects(checked, N.has_text(F.col("Text")))
    assert sorted(r.Id for r in good.collect()) == ["1", "6"] and good.columns == HEADER.split(",")
    told = {(r.reason, (r[RD.CORRUPT] or "").split(",")[0], r[RD.FILE].split("/")[-1]) for r in bad.collect()}
    assert told == {("malformed", k, "part.txt") for k in "235"} | {("blank text", "", "part.txt")}
    r = SK.checked_report(checked, N.has_text(F.col("Text"))).first()
    assert (r.received, r.processed, r.failed) == (6, 2, 4) and abs(r.success_rate - 100 / 3) < 1e-9


def test_malformed_json_lines_are_told(spark):
    item = {"Id": "1", "Text": "fine"}
    arrays = [json.dumps([item, {"Id": "2", "Text": " "}]), '[{"Id": "3", "Te', "", json.dumps([])]
    checked = RD.read_checked(spark, _file(spark, "t-checked-array", "\n".join(arrays)), "json_array")
    assert sorted((r.Id or "", r[RD.CORRUPT] or "") for r in checked.collect()) == [("", '[{"Id": "3", "Te'), ("1", ""), ("2", "")]
    envelopes = [json.dumps({"reviews": [item], "group_by_product": True}), "not json", '{"reviews": [{"Id": 7}']
    checked = RD.read_checked(spark, _file(spark, "t-checked-envelope", "\n".join(envelopes)), "json")
    r = SK.checked_report(checked, N.has_text(F.col("Text"))).first()
    assert (r.received, r.processed, r.failed) == (3, 1, 2)


ROWS = "id long, sentiment_label string, confidence_score double, event_ts timestamp_ntz, team string, product string"


def test_deep_pages(spark):
    """Thousands of products with equal totals; any page equals the slice of the whole order."""
    r = random.Random(2)
    rows = [(i, "joy", 0.5, dt.datetime(2024, 1, 1), "a", f"P{r.randrange(3000)}") for i in range(9000)]
    df = spark.createDataFrame(rows, ROWS)
    path = scratch_path(spark, "t-rank")
    RK.build_rank_index(df, path, parts=12)
    whole = [(x.product_id, x.total_reviews) for x in P.products_page(df, limit=10_000).collect()]
    for limit, offset in ((10, 0), (25, 1490), (40, len(whole) - 15), (5, len(whole) + 7)):
        page = RK.page_from_index(spark, path, limit, offset).collect()
        assert [(x.product_id, x.total_reviews) for x in page] == whole[offset:offset + limit]
        assert all(x.total == len(whole) and x.has_more == (offset + limit < len(whole)) for x in page)
    page = RK.page_from_index(spark, path, 20, 1500)
    assert "part" not in page.columns
    sizes = {x.part: x["count"] for x in spark.read.parquet(path).groupBy("part").count().collect()}
    assert len(sizes) >= 10 and max(sizes.values()) < 3 * len(whole) / len(sizes)
    seen, last = [], (None, None)
    for _ in range(4):
        page = RK.products_after(df, *last, limit=300).collect()
        seen += [(x.product_id, x.total_reviews) for x in page]
        last = page[-1].total_reviews, page[-1].product_id
    assert seen == whole[:1200]
    RK.build_rank_index(df.limit(0), path)
    assert RK.page_from_index(spark, path, 10, 0).count() == 0


def test_sketches_over_days(spark):
    base = scratch_path(spark, "t-sketch")
    facts, view = f"{base}/facts", f"{base}/view"
    make = lambda first, n, days: spark.range(first, first + n).select(
        "id", F.lit("joy").alias("sentiment_label"), F.lit(0.5).alias("confidence_score"),
        F.expr(f"timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, CAST(id % {days} AS INT))").alias("event_ts"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("team"), F.concat(F.lit("P"), F.col("id") % 5000).alias("product"))
    SK.write_results(make(0, 40_000, 8), facts)
    SKT.refresh(spark, facts, view)
    files = lambda: {r.f for r in spark.read.parquet(f"{view}/sketch").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    old = files()
    SK.write_results(make(100_000, 3000, 2), facts)
    SKT.refresh(spark, facts, view)
    assert len(old & files()) == 6                                   # six of eight days did not change
    table = RD.read_fact(spark, facts)
    for first, last in ((None, None), ("2024-01-02", "2024-01-04"), ("2024-01-08", None), ("2025-01-01", None)):
        days = table.where(F.col("event_date").between(F.lit(first or "2000-01-01").cast("date"), F.lit(last or "2100-01-01").cast("date")))
        want = days.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in SKT.COLUMNS]).first()
        got = SKT.distinct_estimates(spark, view, first, last).first()
        assert got.rows == want.rows and got.distinct_team == want.distinct_team
        for c in ("distinct_id", "distinct_product"):
            assert abs(got[c] - want[c]) <= 3 * SKT.error() * want[c]
