"""Physical-plan properties that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from feedlens import api
from feedlens.operators import filters as FL, positions, rules as R, scoring as S, text as TX
from feedlens.plans import all_queries
from feedlens.session import scratch_path
from feedlens.sources import readers as RD, sinks as SK
from feedlens.sources.fixtures import feedback_docs

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> list[str]:
    """Descriptions of the file scans that ran, after adaptive execution; reused shuffles count once."""
    out = []

    def items(seq):
        return [seq.apply(k) for k in range(seq.size())]

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind.startswith("Reused"):
            return
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            out.append(node.simpleString(1000))
        for child in [*items(node.children()), *items(node.subqueries())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return out


@pytest.fixture(scope="module")
def q():
    return all_queries()


def test_top_n_uses_partial_group_limit(spark, q):
    p = plan(q["W1_top_comments"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_keywords_prune_before_shuffle(spark, q):
    p = plan(q["W2_keywords"](spark, SF_SMALL))
    assert "partial_count" in p                    # map-side combine of (product, polarity, word)
    assert "INSET" in p.upper()                    # stop words as a hash-set filter
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_column_pruning(spark, q):
    p = plan(q["A3_product_rollup"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


def test_time_filter_pushed_to_scan(spark, q):
    p = plan(q["A6_timeseries_hour"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p


def test_top_products_semi_join_is_broadcast(spark, q):
    p = plan(q["J1_top_products_timeseries"](spark, SF_SMALL))
    assert "LeftSemi" in p and "Broadcast" in p


def test_alerts_single_aggregate(spark, q):
    p = plan(q["R3_alerts_events"](spark, SF_SMALL))
    assert p.count("Exchange hashpartitioning(product") == 1   # A20 + A21 fused


def test_no_python_outside_c2(spark, q):
    for name, build in q.items():
        if name.startswith(("C2_", "S", "T")):
            continue
        p = plan(build(spark, SF_SMALL))
        assert "PythonUDF" not in p and "MapInPandas" not in p and "BatchEvalPython" not in p, name


def test_c2_sends_only_the_text_to_python(spark, q):
    p = plan(q["C2_pandas_batch_scorer"](spark, SF_SMALL))
    assert "ArrowEvalPython" in p and "MapInPandas" not in p
    call = re.search(r"ArrowEvalPython \[run\(([^)]*)\)", p)
    assert call and call.group(1).startswith("text#") and "," not in call.group(1)


def test_keywords_read_the_texts_once(spark, q):
    df = q["W2_keywords"](spark, SF_SMALL)
    assert plan(df).count("WindowGroupLimit") >= 2                   # partial limit before the shuffle
    df.collect()
    assert len(scans(df)) == 1                                       # words and markers share one exchange


def test_top_comments_never_sort_the_texts(spark):
    facts = scratch_path(spark, "t-plan-facts")
    SK.write_results(S.lexicon_scorer(feedback_docs(spark, SF_SMALL, with_rating=False)), facts, by_date=False)
    df = api.top_comments(RD.read_fact(spark, facts), 5, "2024-03-01 00:00:00")
    df.collect()
    assert sum("text:string" in s for s in scans(df)) == 1           # ranks come from the stored length
    assert "WindowGroupLimit" in plan(df)


def _exchanged_texts(df) -> list[int]:
    """Rows written by each exchange that carries a text column."""
    out = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec" and "text#" in node.output().toString():
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_top_comments_shuffle_no_other_texts(spark):
    """One product has most rows; without broadcast joins, only the winners' texts cross an exchange."""
    docs = feedback_docs(spark, SF_SMALL, with_rating=False)
    hot = docs.withColumn("product", F.when(F.col("id") % 10 < 6, F.lit("hot")).otherwise(F.col("product")))
    facts = scratch_path(spark, "t-plan-hot")
    SK.write_results(S.lexicon_scorer(hot), facts, by_date=False)
    table = RD.read_fact(spark, facts)
    keys = ("spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        df = TX.top_comments(table, 3, "2024-03-01 00:00:00")
        got = sorted((r.product, r.polarity, r["rank"], r.id, r.text) for r in df.collect())
        assert sum(_exchanged_texts(df)) == len(got) < table.count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # The same rows from a frame without positions, and with a bitmap far too small.
    rows = spark.createDataFrame(table.collect(), table.schema)
    assert positions.with_position(rows) is None and positions.with_position(table.join(table.select("id"), "id")) is None
    assert got == sorted((r.product, r.polarity, r["rank"], r.id, r.text) for r in TX.top_comments(rows, 3, "2024-03-01 00:00:00").collect())
    placed = positions.with_position(table)
    few = positions.fetch(TX.rank_comments(placed, 3, "2024-03-01 00:00:00"), placed, ["text"], bits=8)
    assert got == sorted((r.product, r.polarity, r["rank"], r.id, r.text) for r in few.collect())


@pytest.fixture(scope="module")
def fact_table(spark):
    path = scratch_path(spark, "t-plan-by-date")
    SK.write_results(S.lexicon_scorer(feedback_docs(spark, SF_SMALL, with_rating=False)), path)
    return path


def _partition_filters(df) -> str:
    return " ".join(re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(df)))


def test_time_ranges_prune_days(spark, fact_table):
    f = RD.read_fact(spark, fact_table)
    start, end = "2024-01-02 00:00:00", "2024-01-03 12:00:00"
    for df in (api.timeseries(f, start, end, "day"), FL.recent_days(f, end, 2), api.dashboard(f, end, days=1)["recent_trends"],
               api.products_timeseries(f, ["src1"], start=start, end=end), api.timeseries_summary(f, start, end)):
        assert "event_date" in _partition_filters(df)
    got = FL.time_range(f, start, end).count()
    assert got == feedback_docs(spark, SF_SMALL).where(f"event_ts BETWEEN TIMESTAMP_NTZ'{start}' AND TIMESTAMP_NTZ'{end}'").count()


@pytest.mark.parametrize("name", ["A24_score_distribution", "A24_expected_sentiment_distribution", "A28_top_products_share", "A33_team_share",
                                  "S10_ingest_report", "R2_suggestions_all_rows", "A15_confusion_matrix", "A16_class_metrics",
                                  "A17_overall_metrics", "A18_class_distribution", "A19_confidence_by_class", "R1_insights", "W2_keywords"])
def test_facts_are_read_once(spark, q, name):
    df = q[name](spark, SF_SMALL)
    df.collect()
    tables = [re.search(r"(\w+)\.parquet", s).group(1) for s in scans(df)]
    assert tables and len(tables) == len(set(tables)), tables


def test_no_caps_by_default(spark):
    rows = [(i, f"p{i // 4}", "negative" if i % 2 else "positive", 0.9) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, product string, sentiment_label string, confidence_score double") \
        .withColumn("event_ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("team", F.lit("a"))
    assert R.insight_counters(df).first().total_products_analyzed == 300
    assert R.escalations(df, 30).count() == 30 and R.volume_leaders(df, 250).count() == 250
    assert R.suggestions(df).where("category = 'Quality Improvement'").first().data_points == 600
