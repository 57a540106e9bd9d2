"""Registered queries: one Spark plan per operator ID, with DuckDB oracle SQL where expressible."""

from .registry import all_queries, oracle_sqls  # noqa: F401
