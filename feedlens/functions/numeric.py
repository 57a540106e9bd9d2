"""Guarded arithmetic and the reference's rounding/formatting conventions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pct(part: Column, total: Column) -> Column:
    """Part / total * 100, or 0 when total is 0."""
    return F.when(total > 0, part.cast("double") / total * F.lit(100.0)).otherwise(F.lit(0.0))


def pct_sql(part: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST({part} AS DOUBLE) / {total} * 100.0 ELSE 0.0 END"


def ratio(part: Column, total: Column) -> Column:
    return F.when(total > 0, part.cast("double") / total).otherwise(F.lit(0.0))


def py_round(x: Column, digits: int = 0) -> Column:
    """Python's ``round``: half-to-even."""
    return F.bround(x, digits)


def py_percent_text(fraction: Column, digits: int = 1) -> Column:
    """Python ``f'{x:.1%}'``: fraction times 100, half-even, fixed decimals, percent sign."""
    return F.format_string(f"%.{digits}f%%", F.bround(fraction * F.lit(100.0), digits))


def py_percent_text_sql(fraction: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f%%', round_even(({fraction}) * 100.0, {digits}))"


def py_fixed_text(x: Column, digits: int = 1) -> Column:
    """Python ``f'{x:.1f}'``."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def py_fixed_text_sql(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', round_even({x}, {digits}))"
