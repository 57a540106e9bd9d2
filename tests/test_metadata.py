"""Metadata as text and as VARIANT give the same answers."""

import datetime as dt

from pyspark.sql import functions as F

from feedlens.functions import metadata
from feedlens.operators import filters as FL, metrics as M, products as P, profile as PR, text as TX
from feedlens.session import scratch_path
from feedlens.sources import readers as RD, sinks as SK

META = ['{"rating": 5, "product_name": "Lamp", "helpfulness_numerator": 1, "helpfulness_denominator": 2}', '{"rating": "2.5", "k": null, "nested": {"a": 1}}',
        '{"expected_sentiment": "negative", "rating": 4.0}', "{}", "not json", None, "[1, 2]", '"text"', '{"rating": "many", "product_name": null}', '{"rating": true}']


def _facts(spark):
    rows = [(i, f"text {i} " * 5, ["joy", "anger", None][i % 3], 0.1 * i, dt.datetime(2024, 1, 1, i), "a", f"P{i % 2}", m) for i, m in enumerate(META)]
    df = spark.createDataFrame(rows, "id long, text string, sentiment_label string, confidence_score double, event_ts timestamp_ntz, team string, product string, metadata string")
    text, variant = scratch_path(spark, "t-meta-text"), scratch_path(spark, "t-meta-variant")
    SK.write_results(df, text)
    SK.write_results(df, variant, variant=True)
    return RD.read_fact(spark, text), RD.read_fact(spark, variant, variant=True)


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    return a


def test_both_forms_agree(spark):
    text, variant = _facts(spark)
    assert metadata.is_variant(variant) and not metadata.is_variant(text)
    keys = {r.key: r.rows_with_key for r in _same(PR.metadata_key_census(text), PR.metadata_key_census(variant)).collect()}
    assert keys["rating"] == 5 and keys["k"] == 1 and "a" not in keys
    for key in ("k", "rating", "nested", "missing"):
        _same(FL.has_metadata_key(text, key).select("id"), FL.has_metadata_key(variant, key).select("id"))
    assert FL.has_metadata_key(variant, "k").count() == 1             # a JSON null is a value of its key
    _same(M.confusion_matrix(text), M.confusion_matrix(variant))
    cols = ["id", "product", "polarity", "rank", "ranking_score", "text"]
    _same(TX.top_comments(text, 3, "2024-02-01 00:00:00").select(cols), TX.top_comments(variant, 3, "2024-02-01 00:00:00").select(cols))
    _same(P.product_summary(text, 3, "2024-02-01 00:00:00").select("product_id", "product_name", "product_description"),
          P.product_summary(variant, 3, "2024-02-01 00:00:00").select("product_id", "product_name", "product_description"))


def test_merged_schema(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2.5}',), (None,), ("broken",)], "metadata string")
    assert metadata.schema(df).first().schema == "OBJECT<a: DECIMAL(21,1), b: STRING>"
    assert metadata.parsed(metadata.parsed(df)).where(F.col("metadata").isNotNull()).count() == 2
