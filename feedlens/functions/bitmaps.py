"""Membership bitmaps: a set of keys as a few rows of 4 KB, which may say yes wrongly but never no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a bitmap: 2**23 are 1 MB, in rows of 4 KB.
BITS = 1 << 23
BUCKET, BITMAP = "_bucket", "_bitmap"


def slot(keys: list[str], bits: int = BITS) -> Column:
    """The place of a key, from 1."""
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def bitmap(df: DataFrame, keys: list[str], bits: int = BITS, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bucket, bitmap) of the keys of ``df``, at most bits / 32768 rows for each value of ``by``."""
    at = df.select(*by, slot(keys, bits).alias("_slot"))
    return at.groupBy(*by, F.bitmap_bucket_number("_slot").alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias(BITMAP))


def bit_set(bitmap: str, at: Column) -> Column:
    """Whether the bit of a place (in its bucket) is set; null without a bitmap."""
    bit = F.bitmap_bit_position(at)
    byte = F.substr(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (bit % 8).cast("int")) == 1


def flagged(df: DataFrame, keys_of: DataFrame, keys: list[str], flag: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``flag``: false if the row's keys are surely not among those of ``keys_of``.  A bitmap of at most
    bits / 32768 rows is broadcast; ``df`` is not shuffled."""
    at = slot(keys, bits)
    held = F.broadcast(bitmap(keys_of, keys, bits))
    return df.withColumn(BUCKET, F.bitmap_bucket_number(at)).join(held, BUCKET, "left").withColumn(
        flag, F.coalesce(bit_set(BITMAP, at), F.lit(False))).drop(BUCKET, BITMAP)
