"""Review-shaped rows derived from the driver's ``documents`` and ``labels`` tables.

They exercise the ingest path (readers, P1–P11, S6–S10) on data that grows with the tables: one
review per document, whole text, rating from the labels, and the reference's mix of time formats
(epoch seconds, ISO with ``Z``, ISO without zone, unparseable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import table

T0_EPOCH = 1704067200          # 2024-01-01 00:00:00 UTC; review k is stamped k hours later
_TIME_KINDS = 4
#: Products with a description; names come in two spellings, which often tie.
DESCRIBED = ("src1", "src2", "src3", "src4", "src5", "src6", "src7")


def review_rows(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """One review per document; ``documents`` may be a stream of that table."""
    d = documents if documents is not None else table(spark, sf_dir, "documents")
    d = d.select("doc_id", "text", "lang", "source").alias("d")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").alias("l")
    j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    k = F.col("d.doc_id")
    ts = F.timestamp_add("HOUR", k, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    iso = F.concat(F.to_date(ts).cast("string"), F.lit("T"),
                   F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":"),
                   F.lpad(F.minute(ts).cast("string"), 2, "0"), F.lit(":"),
                   F.lpad(F.second(ts).cast("string"), 2, "0"))
    kind = k % _TIME_KINDS
    time = (F.when(kind == 0, (F.lit(T0_EPOCH) + k * 3600).cast("string"))
            .when(kind == 1, F.concat(iso, F.lit("Z"))).when(kind == 2, iso).otherwise(F.lit("n/a")))
    rating = (F.when(F.col("l.toxic") == 1, F.lit(1.0)).when(F.col("l.quality") == 1, F.lit(5.0))
              .when(F.col("l.quality") == 0, F.lit(3.0)))
    return j.select(
        k.cast("string").alias("Id"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.col("d.source")).alias("ProductId"),
        F.concat(F.lit("U"), (k % 97).cast("string")).alias("UserId"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit('user "'), (k % 97).cast("string"), F.lit('", reviewer'))).alias("ProfileName"),
        (k % 4).cast("int").alias("HelpfulnessNumerator"),
        (k % 4 + k % 3).cast("int").alias("HelpfulnessDenominator"),
        rating.alias("Score"),
        time.alias("Time"),
        F.col("d.lang").alias("Summary"),
        F.col("d.text").alias("Text"),
        F.when(k % 3 == 0, "Premium").when(k % 3 == 1, "Normal").otherwise("Trial").alias("Customer_Type"),
        F.when(k % 2 == 0, F.concat(F.lit("Suggestion for "), F.col("d.source"))).alias("Suggestions"),
        F.when(k % 3 != 1, F.concat(F.lit("Item "), F.col("d.source"), F.lit(" v"), (k % 2).cast("string"))).alias("ProductName"),
        F.when((k % 4 == 1) & F.col("d.source").isin(*DESCRIBED), F.concat(F.lit("About "), F.col("d.lang"))).alias("ProductDescription"))


REVIEW_ROWS_SQL = f"""SELECT CAST(d.doc_id AS VARCHAR) AS Id,
  CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE d.source END AS ProductId,
  concat('U', CAST(d.doc_id % 97 AS VARCHAR)) AS UserId,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE concat('user "', CAST(d.doc_id % 97 AS VARCHAR), '", reviewer') END
    AS ProfileName,
  CAST(d.doc_id % 4 AS INTEGER) AS HelpfulnessNumerator,
  CAST(d.doc_id % 4 + d.doc_id % 3 AS INTEGER) AS HelpfulnessDenominator,
  CASE WHEN l.toxic = 1 THEN 1.0e0 WHEN l.quality = 1 THEN 5.0e0 WHEN l.quality = 0 THEN 3.0e0 END AS Score,
  CASE d.doc_id % {_TIME_KINDS}
    WHEN 0 THEN CAST({T0_EPOCH} + d.doc_id * 3600 AS VARCHAR)
    WHEN 1 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' HOUR, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 2 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' HOUR, '%Y-%m-%dT%H:%M:%S')
    ELSE 'n/a' END AS Time,
  d.lang AS Summary, d.text AS Text,
  CASE d.doc_id % 3 WHEN 0 THEN 'Premium' WHEN 1 THEN 'Normal' ELSE 'Trial' END AS Customer_Type,
  CASE WHEN d.doc_id % 2 = 0 THEN concat('Suggestion for ', d.source) END AS Suggestions,
  CASE WHEN d.doc_id % 3 <> 1 THEN concat('Item ', d.source, ' v', CAST(d.doc_id % 2 AS VARCHAR)) END AS ProductName,
  CASE WHEN d.doc_id % 4 = 1 AND d.source IN ({", ".join(f"'{x}'" for x in DESCRIBED)}) THEN concat('About ', d.lang) END
    AS ProductDescription
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
