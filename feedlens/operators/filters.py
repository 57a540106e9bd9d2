"""Filters and predicates F1–F13.  Each returns a filtered DataFrame (pushed to the scan when the
predicate touches only scan columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metadata
from ..functions.labels import polarity
from ..functions.timefns import ntz
from ..sources.schemas import DAY, MONTH

#: The fact table's partition column: the day of ``event_ts``.
DATE_COLUMN = DAY


def time_range(df: DataFrame, start=None, end=None, col: str = "event_ts") -> DataFrame:
    """inclusive [start, end] on the event timestamp (either bound optional).

    On a fact table the same bounds go to its partition column, so other days (months) are not opened."""
    c = F.col(col)
    if start is not None:
        df = _from_day(df.where(c >= ntz(start)), ntz(start), col)
    if end is not None:
        df = df.where(c <= ntz(end))
        if col == "event_ts" and DATE_COLUMN in df.columns:
            df = df.where(F.col(DATE_COLUMN) <= F.to_date(ntz(end)))
            if MONTH in df.columns:
                df = df.where(F.col(MONTH) <= F.trunc(F.to_date(ntz(end)), "month"))
    return df


def _from_day(df: DataFrame, start, col: str) -> DataFrame:
    if col == "event_ts" and DATE_COLUMN in df.columns:
        df = df.where(F.col(DATE_COLUMN) >= F.to_date(start))
        if MONTH in df.columns:
            df = df.where(F.col(MONTH) >= F.trunc(F.to_date(start), "month"))
    return df


def default_window(as_of, days: float = 1.0, start=None, end=None):
    """missing bounds default to [end - days, end] with end = as_of (explicit, never "now")."""
    import datetime as dt
    end = end if end is not None else as_of
    if start is None and end is not None:
        e = dt.datetime.fromisoformat(str(end)) if not isinstance(end, dt.datetime) else end
        start = e - dt.timedelta(days=days)
    return start, end


def date_bounds(start_date: str | None, end_date: str | None):
    """'YYYY-MM-DD' bounds read as midnight (the end day itself is excluded except 00:00)."""
    s = f"{start_date} 00:00:00" if start_date else None
    e = f"{end_date} 00:00:00" if end_date else None
    return s, e


def equals_if_given(df: DataFrame, **conds) -> DataFrame:
    """optional equality filters; a falsy value means "no filter"."""
    for col, val in conds.items():
        if val:
            df = df.where(F.col(col) == F.lit(val))
    return df


def known_product(df: DataFrame) -> DataFrame:
    """product IS NOT NULL AND product != 'unknown'."""
    return df.where(F.col("product").isNotNull() & (F.col("product") != "unknown"))


def nonempty_product(df: DataFrame) -> DataFrame:
    """product IS NOT NULL AND product != '' (keeps 'unknown')."""
    return df.where(F.col("product").isNotNull() & (F.col("product") != ""))


def products_in(df: DataFrame, product_ids: str | list[str]) -> DataFrame:
    """product in a comma-separated (trimmed) list or a Python list."""
    if isinstance(product_ids, str):
        product_ids = [p.strip() for p in product_ids.split(",") if p.strip()]
    return df.where(F.col("product").isin(list(product_ids)))


def with_all_sentinel(df: DataFrame, sentiment: str | None = None, customer_type: str | None = None,
                      product: str | None = None) -> DataFrame:
    """F8: label / customer type / product filters; None and 'all' (label, type) mean no filter."""
    if sentiment and sentiment != "all":
        df = df.where(F.col("sentiment_label") == sentiment)
    if customer_type and customer_type != "all":
        df = df.where(F.col("team") == customer_type)
    if product:
        df = df.where(F.col("product") == product)
    return df


def min_group_size(g: DataFrame, count_col: str, minimum: int) -> DataFrame:
    """HAVING count >= minimum on an aggregated frame."""
    return g.where(F.col(count_col) >= minimum) if minimum and minimum > 1 else g


def of_polarity(df: DataFrame, which: str, scheme: str = "m1s") -> DataFrame:
    """rows of one polarity class."""
    return df.where(polarity("sentiment_label", scheme) == which)


def recent_days(df: DataFrame, as_of, days: int, col: str = "event_ts") -> DataFrame:
    """rows at or after as_of - days."""
    start = ntz(as_of) - F.make_dt_interval(F.lit(days))
    return _from_day(df.where(F.col(col) >= start), start, col)


def has_metadata_key(df: DataFrame, key: str) -> DataFrame:
    """metadata JSON holds the key (a real JSON lookup rather than a substring match)."""
    return df.where(metadata.has_key(df, key))


def positive_counts(df: DataFrame, count_col: str = "count") -> DataFrame:
    """only rows whose count is above zero."""
    return df.where(F.col(count_col) > 0)
