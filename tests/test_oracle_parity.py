"""Every registered query with oracle SQL returns the same rows as DuckDB (sf0.001)."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from feedlens.plans import all_queries, oracle_sqls

from .conftest import SF_SMALL

QUERIES = all_queries()
SQLS = oracle_sqls()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _canon(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


def test_every_query_has_an_oracle():
    rows_only = set(QUERIES) - set(SQLS)
    assert not rows_only, rows_only
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_parity(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQLS[name]).df()
    gc, gr = _canon(got)
    wc, wr = _canon(want)
    assert gc == wc
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["product_id", "total_reviews"]
    assert "product_description" in df.columns
