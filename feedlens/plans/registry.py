"""Query registry.  Each plan module registers ``(name, build, sql)``; ``build(spark, sf_dir)``
returns a DataFrame.  Most are lazy; the round trips (S), the streams (T) and the bulk import write a
scratch table first, so building them runs jobs.  ``sql`` is the DuckDB oracle (None when not SQL-expressible)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Build, str | None]] = {}

_MODULES = ["products_q", "profile_q", "timeseries_q", "text_q", "metrics_q", "rules_q", "filters_q",
            "normalize_q", "scoring_q", "io_q", "streaming_q", "bulk_q"]


STABLE_DIGITS = 9


def register(name: str, sql: str | None = None, stable: tuple[str, ...] = ()):
    """Register a query.  ``stable`` names floating columns that are sums/averages of doubles:
    their last bits depend on summation order (partitioning), so both the Spark result and the
    oracle round them to ``STABLE_DIGITS`` decimals in the final projection."""
    def deco(fn: Build) -> Build:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        build, text = fn, sql
        if stable:
            def build(spark, sf, _fn=fn):
                from pyspark.sql import functions as F
                df = _fn(spark, sf)
                return df.withColumns({c: F.round(c, STABLE_DIGITS) for c in stable})
            if sql is not None:
                repl = ", ".join(f"round({c}, {STABLE_DIGITS}) AS {c}" for c in stable)
                text = f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) stable_q"
        _QUERIES[name] = (build, text)
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        import_module(f"{__package__}.{m}")


def all_queries() -> dict[str, Build]:
    _load()
    return {k: v[0] for k, v in _QUERIES.items()}


def oracle_sqls() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _QUERIES.items() if v[1] is not None}
