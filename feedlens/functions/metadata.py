"""Fields of the ``metadata`` column, which is JSON text or, parsed once at ingest, a VARIANT.

Every operator that looks into metadata goes through these helpers, so a fact table may hold either form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import VariantType

COLUMN = "metadata"


def is_variant(df: DataFrame, col: str = COLUMN) -> bool:
    return isinstance(df.schema[col].dataType, VariantType)


def parsed(df: DataFrame, col: str = COLUMN) -> DataFrame:
    """``df`` with the column as a VARIANT; text that is no JSON becomes null, as lookups in such text are."""
    return df if is_variant(df, col) else df.withColumn(col, F.try_parse_json(col))


def field(df: DataFrame, key: str, kind: str = "string", col: str = COLUMN) -> Column:
    """One top-level field as ``kind``; null if it is missing, a JSON null, or no such value."""
    text = F.try_variant_get(F.col(col), f"$.{key}", "string") if is_variant(df, col) else F.get_json_object(col, f"$.{key}")
    return text if kind == "string" else text.try_cast(kind)


def has_key(df: DataFrame, key: str, col: str = COLUMN) -> Column:
    """Whether the top-level object has the key, a JSON null as its value included."""
    if is_variant(df, col):
        return F.try_variant_get(F.col(col), f"$.{key}", "variant").isNotNull()
    return F.array_contains(F.json_object_keys(col), key)


def keys(df: DataFrame, col: str = COLUMN) -> DataFrame:
    """(key): every top-level key of every row."""
    if is_variant(df, col):
        fields = df.select(F.col(col).alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT")).lateralJoin(
            df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        return fields.select("key")
    return df.select(F.explode(F.json_object_keys(col)).alias("key"))


def schema(df: DataFrame, col: str = COLUMN) -> DataFrame:
    """(schema): the merged type of the column over all rows, as SQL text; one pass, no keys listed in advance."""
    return parsed(df, col).agg(F.schema_of_variant_agg(col).alias("schema"))
