"""Exact de-duplication: a tree merge of digest runs, in DataFrame operations only.

Every document becomes one digest row and belongs to one of ``runs`` runs.  Runs meet in binomial
rounds: each round merges ``2**steps`` neighbouring runs by one aggregation on (digest, run group), so
a digest with a third of all rows is thinned to one row per run group at every level and no task ever
holds all of its rows.  A merge keeps the smallest identifier, the row count and the verification
values, and fails the job if two texts under one digest differ in length or in a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, durable, fresh_name


def _normal(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RE, " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, length, check) of every row; texts are compared after each run of white space has
    become one space, a null text counts as empty."""
    return (df.select(F.col(id_col).alias("id"), _normal(text_col).alias("norm"))
            .select("id", F.unhex(F.sha2("norm", 256)).alias("digest"),
                    F.octet_length("norm").alias("length"), F.xxhash64("norm").alias("check")))


def merge_runs(rows: DataFrame, runs: int = 64, steps: int = 2) -> DataFrame:
    """Merge digest rows to one row per digest: (digest, keep_id, group_size).

    ``runs`` is a power of two; a round merges ``2**steps`` runs, so the tree has
    ``log2(runs) / steps`` levels whatever the input size.
    """
    level = rows.select("digest", "length", "check", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                        F.pmod(F.xxhash64("id"), F.lit(runs)).alias("run"))
    left = max(1, runs.bit_length() - 1)
    while left > 0:
        down = min(steps, left)
        left -= down
        merged = level.groupBy("digest", F.shiftright("run", down).alias("run")).agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
            F.min("length").alias("length"), F.max("length").alias("length_hi"),
            F.min("check").alias("check"), F.max("check").alias("check_hi"))
        same = (F.col("length") == F.col("length_hi")) & (F.col("check") == F.col("check_hi"))
        level = merged.select("digest", "run", "keep_id", "length", "check",
                              F.when(same, F.col("group_size")).otherwise(
                                  F.raise_error(F.lit("different texts share a digest")).cast("long")).alias("group_size"))
    return level.select("digest", "keep_id", "group_size")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    ``keep_id`` is the smallest id among the rows with an equal text and ``kept`` says that the row
    has it.  Rows that repeat one id with one text are one document: all are marked kept and all
    count.  A null id loses against any other; a group of null ids keeps them.  Empty input gives no
    rows.  Other columns of ``df`` are not read, so their names do not matter.
    """
    rows = durable(digests(df, id_col, text_col))
    groups = durable(merge_runs(rows).where("group_size > 1"))
    out = rows.join(groups, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      F.col("id").eqNullSafe(keep).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, without those whose text a row with a smaller id has.  A row goes by
    its id and its text, so other texts under the same or a null id stay."""
    name, mine, copied = (fresh_name(df, n) for n in ("dropped_id", "text_digest", "dropped_digest"))
    dropped = exact_duplicates(df, id_col, text_col).where(~F.col("kept")).select(
        F.col(id_col).alias(name), F.unhex("text_sha256").alias(copied)).distinct()
    rows = df.withColumn(mine, F.unhex(F.sha2(_normal(text_col), 256)))
    same = F.col(id_col).eqNullSafe(F.col(name)) & (F.col(mine) == F.col(copied))
    return rows.join(dropped, same, "left_anti").drop(mine)
