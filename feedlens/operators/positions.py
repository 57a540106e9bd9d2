"""Late materialisation by row position: rank narrow rows first, fetch wide columns of the winners afterwards.

A row of a Parquet table has a position, its file and its index in the file.  Ranking carries the position
instead of the wide columns.  The winners' positions then fill a bitmap of a fixed number of bits, which
is broadcast, and the second scan keeps the rows whose bit is set: the winners and, rarely, a row
that shares a bit.  Only those rows are shuffled, to the join on the position, which is exact.  More winners
than the bitmap has bits make it less selective, never wrong.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..functions import bitmaps

FILE, ROW = "_file", "_row"
#: Plan nodes that keep one output row per row of a file.
_ROW_BY_ROW = {"Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Union"}


def _nodes(plan) -> list[str]:
    children = plan.children()
    out = [plan.getClass().getSimpleName()]
    for i in range(children.size()):
        out += _nodes(children.apply(i))
    return out


def with_position(df: DataFrame) -> DataFrame | None:
    """``df`` with the position of each row, or None if its rows are not rows of Parquet files one by one
    (a join, an aggregate, rows made in memory, another format)."""
    if not set(_nodes(df._jdf.queryExecution().analyzed())) <= _ROW_BY_ROW:
        return None
    try:
        return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        return None


def fetch(winners: DataFrame, table: DataFrame, columns: list[str], bits: int = bitmaps.BITS) -> DataFrame:
    """``winners`` (with positions) and, of the rows of ``table`` (with positions) they name, ``columns``."""
    likely = bitmaps.flagged(table.select(FILE, ROW, *columns), winners, [FILE, ROW], "_likely", bits).where("_likely").drop("_likely")
    return winners.join(likely, [FILE, ROW]).drop(FILE, ROW)
