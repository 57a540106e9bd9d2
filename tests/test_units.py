"""Hand-computed cases (the reference's 8-review bulk-import case) and SURVEY §7.3 edge cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from feedlens.functions import labels as L
from feedlens.functions.timefns import bucket, parse_event_time, whole_days_between, ntz
from feedlens.operators import (compare as C, filters as FL, metrics as M, normalize as N,
                                products as P, profile as PR, rules as R, scoring as S, text as TX,
                                timeseries as TS)

# (ProductId, Score, Time, HelpfulnessNumerator, HelpfulnessDenominator, Text): three products of three,
# three and two reviews with the outcomes worked out below.
EIGHT = [
    ("KETTLE-7", 4.0, "1700000000", 2, 5, "Boils quickly and pours well, a great kettle for two people"),
    ("KETTLE-7", 5.0, "1700090000", 6, 6, "Excellent handle, stays cool, happy with this kettle"),
    ("KETTLE-7", 2.0, "1700180000", 1, 9, "The lid broke in a week, poor hinge and a sad sight"),
    ("LAMP-2", 1.0, "1700270000", 7, 7, "Flickers all evening, awful light, returned at once"),
    ("LAMP-2", 3.0, "1700360000", 0, 2, "Neither bright nor dim, a lamp like any other"),
    ("LAMP-2", 5.0, "1700450000", 3, 4, "Wonderful warm light on my desk, best lamp so far"),
    ("TENT-9", 5.0, "1700540000", 11, 13, "Dry through a storm, amazing seams"),
    ("TENT-9", 4.0, "1700630000", 5, 8, "Good space, takes a while to pitch"),
]
AS_OF = "2023-11-25 00:00:00"


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(str(i + 1), p, f"U{i}", f"name {i}", n, d, s, t, f"summary {i}", txt, "Premium", None)
            for i, (p, s, t, n, d, txt) in enumerate(EIGHT)]
    from feedlens.sources.schemas import REVIEW_CSV_SCHEMA
    return spark.createDataFrame(rows, REVIEW_CSV_SCHEMA)


@pytest.fixture(scope="module")
def facts(reviews):
    fb = N.reviews_to_feedback(reviews, AS_OF)
    fb = fb.withColumn("score", F.get_json_object("metadata", "$.rating").cast("double"))
    return S.rating_scorer(fb)


def test_bulk_summary_matches_hand_computed(facts):
    got = {r.product_id: r for r in P.bulk_summary(facts).collect()}
    assert got["KETTLE-7"].total_reviews == 3
    assert (got["KETTLE-7"].positive_count, got["KETTLE-7"].negative_count,
            got["KETTLE-7"].neutral_count) == (2, 1, 0)
    assert got["KETTLE-7"].positive_percentage == pytest.approx(66.6667, abs=1e-4)
    assert got["KETTLE-7"].avg_confidence == pytest.approx((0.85 + 0.95 + 0.80) / 3)
    assert (got["LAMP-2"].positive_count, got["LAMP-2"].negative_count,
            got["LAMP-2"].neutral_count) == (1, 1, 1)
    assert got["LAMP-2"].positive_percentage == pytest.approx(33.3333, abs=1e-4)
    assert got["LAMP-2"].avg_confidence == pytest.approx((0.90 + 0.75 + 0.95) / 3)
    assert got["TENT-9"].positive_percentage == pytest.approx(100.0)
    assert got["TENT-9"].avg_confidence == pytest.approx(0.90)


def test_event_time_is_parsed_epoch(facts):
    ts = {r.id: r.event_ts for r in facts.select("id", "event_ts").collect()}
    assert ts[1] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_metadata_keeps_present_keys_in_order(facts):
    m = json.loads(facts.where("id = 1").select("metadata").first()[0])
    assert list(m)[:3] == ["rating", "expected_sentiment", "review_id"]
    assert m["expected_sentiment"] == "positive" and "suggestion" not in m


def test_product_summary_lists(facts):
    s = {r.product_id: r for r in P.product_summary(facts, top_n=3, as_of=AS_OF).collect()}
    a = s["KETTLE-7"]
    assert a.emotion_counts == {"negative": 1, "positive": 2}
    assert len(a.top_positive_comments) == 2 and len(a.top_negative_comments) == 1
    assert a.top_positive_comments[0].rank == 1
    assert a.product_description.startswith("Key themes: ")


def test_top_comments_score_parts(spark):
    df = spark.createDataFrame(
        [(1, "x" * 500, "joy", 0.5, dt.datetime(2024, 1, 1), "p", 3, 4),
         (2, "y" * 2000, "joy", 1.0, dt.datetime(2024, 1, 31), "p", 0, 0),
         (3, "z", "joy", 0.9, dt.datetime(2025, 3, 1), "p", 1, 1)],
        "id long, text string, sentiment_label string, confidence_score double, event_ts timestamp_ntz, "
        "product string, helpfulness_numerator int, helpfulness_denominator int")
    r = {x.id: x for x in TX.top_comments(df, 10, "2024-01-31 00:00:00").collect()}
    assert r[1].confidence_part == pytest.approx(0.2)
    assert r[1].helpfulness_part == pytest.approx(0.225)
    assert r[1].recency_part == pytest.approx((1 - 30 / 365) * 0.2)
    assert r[1].text_part == pytest.approx(0.05)
    assert r[2].helpfulness_part == 0.0 and r[2].text_part == pytest.approx(0.1)
    assert r[3].recency_part > 0.2                      # future review: no upper clamp (decision 10)
    assert TX.top_comments(df, 0, "2024-01-31").count() == 0


def test_keywords_rules(spark):
    df = spark.createDataFrame(
        [(1, "p", "joy", "The cable cable works; cable is fine and the café was nice nice nice"),
         (2, "p", "joy", "Works well, cable ok"),
         (3, "q", "joy", "too short")],
        "id long, product string, sentiment_label string, text string")
    k = TX.keywords(df, 2).orderBy("product", "rank").collect()
    assert [(x.product, x.word, x["count"]) for x in k] == [("p", "cable", 4), ("p", "nice", 3)]
    # 'caf' is not a keyword (accented letter continues the token); q fails the 50-character rule


def test_polarity_maps_disagree_as_in_reference(spark):
    df = spark.createDataFrame([("anger",), ("Surprise",), ("POSITIVE",), ("other",)], "l string")
    r = df.select("l", L.polarity("l", "m1").alias("m1"), L.polarity("l", "m1s").alias("m1s"),
                  L.polarity("l", "m2").alias("m2"), L.polarity("l", "m3").alias("m3")).collect()
    got = {x.l: (x.m1, x.m1s, x.m2, x.m3) for x in r}
    assert got["anger"] == ("negative", "negative", "neutral", None)
    assert got["Surprise"] == ("neutral", "neutral", "neutral", None)
    assert got["POSITIVE"] == ("positive", "positive", "positive", "positive")
    assert got["other"] == ("neutral", None, "neutral", None)


def test_time_cascade_and_buckets(spark):
    df = spark.createDataFrame([("1700000000",), ("2024-01-03T05:06:07Z",), ("2024-01-03T05:06:07+02:00",),
                                ("2024-01-03 05:06:07.5",), ("garbage",), (None,)], "t string")
    r = [x.p for x in df.select(parse_event_time("t", "2030-01-01 00:00:00").alias("p")).collect()]
    assert r == [dt.datetime(2023, 11, 14, 22, 13, 20), dt.datetime(2024, 1, 3, 5, 6, 7), dt.datetime(2024, 1, 3, 3, 6, 7),
                 dt.datetime(2024, 1, 3, 5, 6, 7, 500000), dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 1)]
    b = spark.createDataFrame([(dt.datetime(2024, 1, 7, 23, 30),)], "ts timestamp_ntz").select(
        bucket("ts", "hour").alias("h"), bucket("ts", "day").alias("d"), bucket("ts", "week").alias("w"),
        whole_days_between(F.col("ts"), ntz("2024-01-07 00:00:00")).alias("neg")).first()
    assert b.h == dt.datetime(2024, 1, 7, 23) and b.d == dt.datetime(2024, 1, 7)
    assert b.w == dt.datetime(2024, 1, 1)                    # Monday-based week
    assert b.neg == -1                                       # floor, like timedelta.days


def test_numeric_times(spark):
    rows = ["99999999999999999999", "-99999999999999999999", "1e9", "1.7E+9", ".5", "1e400", "nan", "Infinity", "12d", " 1700000000 ", "-1"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    got = {r.t: r.p for r in df.select("t", parse_event_time("t", "2030-01-01 00:00:00").alias("p")).collect()}
    late = dt.datetime(2030, 1, 1)
    assert [got[x] for x in rows] == [late, late, dt.datetime(2001, 9, 9, 1, 46, 40), dt.datetime(2023, 11, 14, 22, 13, 20),
                                      dt.datetime(1970, 1, 1, 0, 0, 0, 500000), late, late, late, late,
                                      dt.datetime(2023, 11, 14, 22, 13, 20), dt.datetime(1969, 12, 31, 23, 59, 59)]


def test_outer_blanks_do_not_make_a_text_long_enough(spark):
    rows = [(1, "a", "joy", " " * 60 + "hello world"), (2, "b", "joy", "hello world" + "\u2003" * 60), (3, "c", "joy", "hello " + " " * 60 + "world"),
            (4, "d", "joy", " " * 30 + "hello world, here are some"), (5, "d", "joy", "more words to reach fifty" + " " * 30), (6, "e", "joy", " " * 80)]
    df = spark.createDataFrame(rows, "id long, product string, sentiment_label string, text string")
    assert {r.product for r in TX.keywords(df, 5).collect()} == {"c", "d"}


def test_suggestions_default_on_empty_input(facts):
    s = R.suggestions(facts.where("1 = 0"), max_rows=None).collect()
    assert [(x.title, x.data_points) for x in s] == [("Continue Monitoring", 0)]


def test_suggestions_fire_and_sort(facts):
    neg = facts.withColumn("sentiment_label", F.lit("sadness"))
    s = R.suggestions(neg, max_rows=None).collect()
    assert s[0].category in ("Quality Improvement", "Product Improvement")
    assert s[0].description.endswith("Consider reviewing product quality and customer service processes.") \
        or "100.0%" in s[0].description
    assert all(x.title != "Continue Monitoring" for x in s)


def test_alerts_rules(spark):
    rows = [(i, "neg", "anger", 0.4, dt.datetime(2024, 1, 30), "A") for i in range(4)] + \
           [(10 + i, "pos", "joy", 0.9, dt.datetime(2024, 1, 1), "B") for i in range(3)] + \
           [(20, "x", "anger", 0.9, dt.datetime(2024, 1, 30), "B")]
    df = spark.createDataFrame(rows, "id long, text string, sentiment_label string, confidence_score double, "
                                     "event_ts timestamp_ntz, product string")
    a = {(x.product, x.type, x.title.split(":")[0]) for x in R.alerts(df, as_of="2024-01-31 00:00:00").collect()}
    assert ("A", "critical", "High Negative Sentiment") in a
    assert ("A", "info", "Low Confidence Reviews") in a
    assert not any(t == "Escalation Spike" and p == "A" for p, _, t in a)    # J4: already critical
    assert not any(p == "B" and k == "critical" for p, k, _ in a)


def test_metrics_confusion_grid_zero_filled(facts):
    cm = M.confusion_matrix(facts.withColumn("rating", F.col("score"))).collect()
    assert len(cm) == 9 and sum(x["count"] for x in cm) == 8
    assert {x.actual for x in cm if x.actual == x.predicted and x["count"] > 0} == {"Positive", "Negative", "Neutral"}
    ov = M.overall_metrics(facts.withColumn("rating", F.col("score"))).first()
    assert ov.accuracy == 100.0


def test_compare_products(facts):
    summ = C.comparable_summary(facts, ["KETTLE-7", "TENT-9"])
    c = C.compare_products(summ, "KETTLE-7", "TENT-9").first()
    assert c.better_product == "TENT-9"
    assert c.total_reviews_diff == 1
    assert c.positive_percentage_diff == pytest.approx(66.6667 - 100.0, abs=1e-3)


def test_pandas_scorer_equals_native(spark):
    df = spark.createDataFrame([(1, "I love it, great!"), (2, "so sad and disappointed"), (3, ""), (4, None)],
                               "id long, text string")
    a = {r.id: (r.sentiment_label, round(r.confidence_score, 9)) for r in S.lexicon_scorer(df).collect()}
    b = {r.id: (r.sentiment_label, round(r.confidence_score, 9))
         for r in S.score_with(df, S.PandasLexiconScorer()).collect()}
    assert a == b and a[1][0] == "joy" and a[2][0] == "sadness" and a[3][0] == "neutral"


def test_profile_and_filters(facts):
    assert PR.dataset_profile(facts, ["product"]).first().n_distinct_product == 3
    assert FL.products_in(facts, "KETTLE-7, TENT-9 ").count() == 5
    assert FL.recent_days(facts, AS_OF, 7).count() == 5
    d = PR.value_distribution(facts, "product", 1).collect()
    assert sum(x.percentage for x in d) == pytest.approx(100.0, abs=0.11)


def test_timeseries_counts(facts):
    s = TS.sentiment_timeseries(facts, None, None, "day").collect()
    assert sum(x.total for x in s) == 8 and all(x.positive + x.neutral + x.negative == x.total for x in s)


def test_api_surface(spark, reviews):
    from feedlens import api
    facts = api.score(api.normalize(reviews, AS_OF), "lexicon")
    assert api.products(facts, limit=2).count() == 2
    assert api.statistics(facts).first().total_analyses == 8
    c = api.compare_products(facts, "KETTLE-7", "LAMP-2").first()
    assert c.product_1 == "KETTLE-7"
    assert api.alerts(facts, as_of=AS_OF).count() >= 0


def test_approximate_distinct_option(facts):
    exact = PR.dataset_profile(facts, ["product"]).first().n_distinct_product
    approx = PR.dataset_profile(facts, ["product"], exact=False).first().n_distinct_product
    assert exact == 3 and abs(approx - exact) <= 1          # HyperLogLog++ may be off by a little
    assert abs(PR.statistics(facts, exact=False).first().days_analyzed - 8) <= 1
