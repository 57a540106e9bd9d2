"""Explicit schemas for every input and the fact table (no schema inference anywhere)."""

from pyspark.sql import types as T

# Review CSV / JSON review item (12 CSV columns; JSON adds ProductName, ProductDescription).
REVIEW_CSV_SCHEMA = T.StructType([
    T.StructField("Id", T.StringType()),
    T.StructField("ProductId", T.StringType()),
    T.StructField("UserId", T.StringType()),
    T.StructField("ProfileName", T.StringType()),
    T.StructField("HelpfulnessNumerator", T.IntegerType()),
    T.StructField("HelpfulnessDenominator", T.IntegerType()),
    T.StructField("Score", T.DoubleType()),
    T.StructField("Time", T.StringType()),
    T.StructField("Summary", T.StringType()),
    T.StructField("Text", T.StringType()),
    T.StructField("Customer_Type", T.StringType()),
    T.StructField("Suggestions", T.StringType()),
])

ENRICHED_CSV_SCHEMA = T.StructType(REVIEW_CSV_SCHEMA.fields + [
    T.StructField("Product_Name", T.StringType()),
    T.StructField("Product_Description", T.StringType()),
])

REVIEW_SCHEMA = T.StructType(REVIEW_CSV_SCHEMA.fields + [
    T.StructField("ProductName", T.StringType()),
    T.StructField("ProductDescription", T.StringType()),
])

REVIEW_ENVELOPE_SCHEMA = T.StructType([
    T.StructField("reviews", T.ArrayType(REVIEW_SCHEMA)),
    T.StructField("group_by_product", T.BooleanType()),
    T.StructField("include_top_comments", T.BooleanType()),
    T.StructField("top_comments_per_category", T.IntegerType()),
])

# Simple feedback CSV: text,product,timestamp,team
FEEDBACK_CSV_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("team", T.StringType()),
])

# Normalised feedback rows (input of scoring).
FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("team", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

# The fact table: one scored row per feedback text.
# Columns that name the folders of a fact table: the day of a row, or in a table of many days with few rows its month.
DAY, MONTH = "event_date", "event_month"

FACT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("team", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("text_length", T.IntegerType()),
])

ALL_SCORES_TYPE = T.MapType(T.StringType(), T.DoubleType())
