"""Top comments (W1), keywords (W2) and their per-product list forms (inputs of J5/U3/R6/J3).

Scale notes
* W1 ranks narrow rows (no text, no metadata) with ``row_number() <= N``: Spark plans a partial
  WindowGroupLimit before the shuffle, so even a product holding a third of all rows ships at most N
  narrow rows per map task.  The winners' texts are fetched afterwards by their position in the
  table's files (``positions``), so no exchange carries the texts of other rows.
* W2 reads the texts once.  A word is counted by (product, polarity, word) with map-side partial
  aggregation.  Every text adds one marker, a word no text can hold, that carries its length and outer
  blanks; markers pass the same exchange and answer the 50-character rule in a second, small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import metadata
from ..functions.labels import POLARITIES, polarity
from ..functions.text import MIN_JOINED_CHARS, UNIQUE_STOP_WORDS, candidate_keywords
from ..functions.timefns import ntz, whole_days_between
from . import positions

# ---- fixed values (must equal the reference) -------------------------------------------------
# Ranking weights of a comment: confidence, helpfulness, recency, text length.
W_CONFIDENCE, W_HELPFUL, W_RECENCY, W_TEXT = 0.4, 0.3, 0.2, 0.1
RECENCY_DAYS, TEXT_CHARS = 365.0, 1000.0
# ------------------------------------------------------------------------------------------------

#: The characters that Python's ``strip`` removes.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _polarity_is(p: str):
    return lambda x: x["polarity"] == p


def _helpfulness(df: DataFrame):
    if "helpfulness_numerator" in df.columns and "helpfulness_denominator" in df.columns:
        return F.col("helpfulness_numerator"), F.col("helpfulness_denominator")
    num = metadata.field(df, "helpfulness_numerator", "double")
    den = metadata.field(df, "helpfulness_denominator", "double")
    return F.coalesce(num, F.lit(0)), F.coalesce(den, F.lit(0))


def _text_length(df: DataFrame) -> Column:
    """Characters of the text; a fact table has them stored, which saves reading the text."""
    return F.coalesce(F.col("text_length") if "text_length" in df.columns else F.length("text"), F.lit(0))


def comment_scores(df: DataFrame, as_of, scheme: str = "m1s") -> DataFrame:
    """W1 scoring: polarity plus the four weighted parts and their sum (``ranking_score``)."""
    num, den = _helpfulness(df)
    conf = F.coalesce(F.col("confidence_score"), F.lit(0.0))
    days = whole_days_between(F.col("event_ts"), ntz(as_of))
    parts = {
        "confidence_part": conf * F.lit(W_CONFIDENCE),
        "helpfulness_part": F.when(den > 0, num.cast("double") / den * F.lit(W_HELPFUL))
                             .otherwise(F.lit(0.0)),
        "recency_part": F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(RECENCY_DAYS))
                         * F.lit(W_RECENCY),
        "text_part": F.least(F.lit(1.0), _text_length(df) / F.lit(TEXT_CHARS)) * F.lit(W_TEXT),
    }
    out = df.withColumn("polarity", polarity("sentiment_label", scheme)).where(F.col("polarity").isNotNull())
    out = out.withColumns(parts)
    return out.withColumn("ranking_score", F.col("confidence_part") + F.col("helpfulness_part")
                          + F.col("recency_part") + F.col("text_part"))


#: Columns that ranking leaves out and the winners get back.
WIDE = ("text", "metadata")


def rank_comments(df: DataFrame, top_n: int = 10, as_of=None, scheme: str = "m1s") -> DataFrame:
    """W1 without the texts: the ``top_n`` best rows per product × polarity (rank 1 = best; ties by id) with
    their narrow columns.  One scan, and one exchange of at most ``top_n`` rows per group and task."""
    s = comment_scores(df, as_of, scheme).drop(*WIDE)
    if top_n <= 0:
        return s.limit(0).withColumn("rank", F.lit(0))
    w = Window.partitionBy("product", "polarity").orderBy(F.col("ranking_score").desc(), F.col("id").asc())
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def top_comments(df: DataFrame, top_n: int = 10, as_of=None, scheme: str = "m1s") -> DataFrame:
    """The ``top_n`` best comments per product × polarity, with all columns of ``df``.

    Over Parquet tables the wide columns of the winners are fetched by position.  Other frames are read
    a second time, where only rows at or above the N-th best key of their group go on.
    """
    wide = [c for c in WIDE if c in df.columns]
    order = [*df.columns, "polarity", "confidence_part", "helpfulness_part", "recency_part", "text_part", "ranking_score", "rank"]
    placed = positions.with_position(df)
    if placed is not None and top_n > 0:
        return positions.fetch(rank_comments(placed, top_n, as_of, scheme), placed, wide).select(*order)
    if top_n <= 0:
        return comment_scores(df, as_of, scheme).limit(0).withColumn("rank", F.lit(0))
    s = comment_scores(df, as_of, scheme)
    w = Window.partitionBy("product", "polarity").orderBy(F.col("ranking_score").desc(), F.col("id").asc())
    key = F.struct((-F.col("ranking_score")).alias("k"), F.col("id").alias("id"))       # ascending: best first
    last = rank_comments(df, top_n, as_of, scheme).groupBy(F.col("product").alias("_product"), F.col("polarity").alias("_polarity")).agg(F.max(key).alias("_last"))
    near = s.join(last, s.product.eqNullSafe(F.col("_product")) & (s.polarity == F.col("_polarity")) & (key <= F.col("_last")))
    return near.drop("_product", "_polarity", "_last").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select(*order)


def top_comment_lists(df: DataFrame, top_n: int = 10, as_of=None) -> DataFrame:
    """Per product: top_positive/negative/neutral_comments arrays (each at most ``top_n``)."""
    t = top_comments(df, top_n, as_of)
    item = F.struct("rank", "id", "text", "sentiment_label", "confidence_score", "event_ts",
                    "ranking_score", "confidence_part", "helpfulness_part", "recency_part", "text_part")
    g = t.groupBy("product").agg(F.collect_list(F.struct(F.col("polarity"), item.alias("c"))).alias("_all"))
    cols = {}
    for p in POLARITIES:
        arr = F.transform(F.filter("_all", _polarity_is(p)), lambda x: x["c"])
        cols[f"top_{p}_comments"] = F.array_sort(arr)
    return g.withColumns(cols).drop("_all")


#: Begins a marker; keywords consist of letters.
_MARK = "\u0001"


def _word_counts(df: DataFrame, scheme: str) -> DataFrame:
    """(product, polarity, word, count, mark): counts of keywords; besides, for every text, its marker
    ``mark|length|leading blanks|trailing blanks|id`` as a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = df.select("product", polarity("sentiment_label", scheme).alias("polarity"), text.alias("text"),
                     (F.col("id") if "id" in df.columns else F.lit(0)).alias("id")).where(F.col("polarity").isNotNull())
    # Built below the explode: beside it, the marker would be evaluated again for every word.
    blank = F.lit(BLANKS)
    size = F.length("text")
    marker = F.concat_ws("|", F.lit(_MARK), size, size - F.length(F.ltrim("text", blank)), size - F.length(F.rtrim("text", blank)),
                         F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")))
    words = base.select("product", "polarity", F.explode(F.array_append(candidate_keywords(F.col("text")), marker)).alias("word"))
    # The flag is an aggregate, so that filters on it stay above the exchange, which both uses then share.
    return words.where(~F.col("word").isin(UNIQUE_STOP_WORDS)).groupBy("product", "polarity", "word").agg(
        F.count(F.lit(1)).alias("count"), F.bool_or(F.col("word").startswith(_MARK)).alias("mark"))


def _joined_lengths(counts: DataFrame, id_type: str) -> DataFrame:
    """(product, polarity, joined): the length of a group's texts joined by spaces, outer blanks apart."""
    part = F.split("word", "\\|", 5)
    marks = counts.where("mark").select(
        "product", "polarity", F.when(part[4] != "", F.substr(part[4], F.lit(2))).cast(id_type).alias("id"), part[1].cast("long").alias("len"),
        part[2].cast("long").alias("lead"), part[3].cast("long").alias("trail"), "count")
    g = marks.groupBy("product", "polarity").agg(
        F.sum((F.col("len") + 1) * F.col("count")).alias("chars"), F.min_by("lead", "id").alias("lead"), F.max_by("trail", "id").alias("trail"))
    return g.select("product", "polarity", (F.col("chars") - 1 - F.coalesce("lead", F.lit(0)) - F.coalesce("trail", F.lit(0))).alias("joined"))


def keywords(df: DataFrame, top_n: int = 10, scheme: str = "m1s") -> DataFrame:
    """The ``top_n`` most frequent keywords per product × polarity (ties by word), for groups whose
    joined texts have 50 characters without their outer blanks."""
    counts = _word_counts(df, scheme)
    best = Window.partitionBy("product", "polarity").orderBy(F.col("count").desc(), F.col("word").asc())
    top = counts.where("NOT mark").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
    id_type = df.schema["id"].dataType.simpleString() if "id" in df.columns else "int"
    long = _joined_lengths(counts, id_type).where(F.col("joined") >= MIN_JOINED_CHARS).select(
        F.col("product").alias("_product"), F.col("polarity").alias("_polarity"))
    return top.join(long, top.product.eqNullSafe(F.col("_product")) & (top.polarity == F.col("_polarity")), "left_semi").select(
        "product", "polarity", "word", "count", "rank")


def keyword_lists(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Per product: positive/negative/neutral_keywords arrays in rank order."""
    k = keywords(df, top_n)
    g = k.groupBy("product").agg(F.collect_list(F.struct("polarity", "rank", "word")).alias("_all"))
    cols = {}
    for p in POLARITIES:
        sel = F.array_sort(F.transform(F.filter("_all", _polarity_is(p)),
                                       lambda x: F.struct(x["rank"].alias("r"), x["word"].alias("w"))))
        cols[f"{p}_keywords"] = F.transform(sel, lambda x: x["w"])
    return g.withColumns(cols).drop("_all")
