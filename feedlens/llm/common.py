"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts spell it, and a word between such characters.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a purely local session
    that names none gets a temporary folder; on a cluster such a folder would be invisible to the
    other machines, so there the missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-ckpt-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def checkpoint_folder(spark: SparkSession) -> str:
    """This session's own folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: compute once and store in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str) -> Column:
    """The evaluation fold: crc32 of the decimal id, modulo 5, is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_bytes(df: DataFrame, text: str) -> int:
    """Total size of a text column in bytes; one scan of that column."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def pow2_at_least(x: float, least: int = 1) -> int:
    n = least
    while n < x:
        n *= 2
    return n


def chunks_by_bytes(batches: Iterable[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that one slice holds about ``most`` bytes of text (one row at least)."""
    for b in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < b.num_rows:
            yield b.slice(start)
