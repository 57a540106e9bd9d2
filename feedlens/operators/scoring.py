"""Scoring C1–C5: turn feedback text into (sentiment_label, confidence_score, all_scores).

* C4 ``rating_scorer`` — star rating -> label/confidence, pure column expressions.
* C5 ``lexicon_scorer`` — native stand-in for the unavailable emotion model: one regex scan pulls the
  lexicon words of a text, and the few hits are counted per emotion (no explode, no shuffle, no Python).
* C2 ``score_with`` — any pandas batch scorer as an iterator pandas UDF over the text column alone; the
  scorer object lives as long as a task.  ``PandasLexiconScorer`` is the pandas twin of C5.
* C3 argmax over the score map: highest score, ties to the first label in model order.
* C1 (one text) is C2/C5 on a one-row frame; T1 streams the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import EMOTIONS
from ..functions.text import whole_words_regex

# ---- fixed values of this library's lexicon scorer (own stand-in; not from the reference) -----
LEXICON = {
    "anger": ["angry", "furious", "outraged", "rage", "hate", "annoyed", "mad"],
    "disgust": ["disgusting", "gross", "nasty", "revolting", "awful", "terrible", "yuck"],
    "fear": ["afraid", "scared", "worried", "fear", "anxious", "unsafe", "dangerous"],
    "joy": ["love", "great", "excellent", "happy", "wonderful", "amazing", "good", "best"],
    "neutral": [],
    "sadness": ["sad", "disappointed", "unhappy", "sorry", "poor", "broke", "broken"],
    "surprise": ["surprised", "unexpected", "wow", "shocked", "sudden", "unbelievable"],
}
# Prior mass per label: with no word hits the text is neutral.
PRIOR = {"anger": 0.1, "disgust": 0.1, "fear": 0.1, "joy": 0.1, "neutral": 1.0,
         "sadness": 0.1, "surprise": 0.1}
# Rating labeller constants (fixed values of the reference's demo loader).
RATING_POS_MIN, RATING_NEG_MAX = 4.0, 2.0
# ------------------------------------------------------------------------------------------------

PRIOR_TOTAL = sum(PRIOR.values())


def rating_labels(score: Column) -> Column:
    """Rating -> expected sentiment (>=4 positive, <=2 negative, else neutral; NULL stays NULL)."""
    return (F.when(score >= RATING_POS_MIN, "positive")
            .when(score <= RATING_NEG_MAX, "negative")
            .when(score.isNotNull(), "neutral"))


def rating_scorer(df: DataFrame, score_col: str = "score", default_score: float = 3.0) -> DataFrame:
    """C4: label and confidence from the star rating (missing rating read as 3)."""
    s = F.coalesce(F.col(score_col).cast("double"), F.lit(default_score))
    label = rating_labels(s)
    conf = (F.when(s >= RATING_POS_MIN, F.lit(0.85) + (s - RATING_POS_MIN) * F.lit(0.1))
            .when(s <= RATING_NEG_MAX, F.lit(0.80) + (F.lit(RATING_NEG_MAX) - s) * F.lit(0.1))
            .otherwise(F.lit(0.75)))
    return df.withColumns({"sentiment_label": label, "confidence_score": conf})


def argmax_label(all_scores: Column) -> Column:
    """C3 (C1 for one text): label with the highest score; ties go to the label that sorts first (model order)."""
    entries = F.map_entries(all_scores)
    keyed = F.transform(entries, lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("label")))
    return F.sort_array(keyed)[0]["label"]


def _member_of(ws: list[str]):
    return lambda w: w.isin(ws)


LEXICON_REGEX = whole_words_regex([w for ws in LEXICON.values() for w in ws])


def lexicon_hits(text: Column) -> Column:
    """The lexicon words of the whole lower-cased text, in order; one scan of the text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LEXICON_REGEX), 0)


def lexicon_scores(hits: Column) -> Column:
    """Map label -> probability from the lexicon hits of one text plus the prior."""
    per_label = {lab: (F.size(F.filter(hits, _member_of(ws))) if ws else F.lit(0))
                 for lab, ws in LEXICON.items()}
    total = F.size(hits) + F.lit(PRIOR_TOTAL)
    return F.map_from_arrays(
        F.array(*[F.lit(lab) for lab in EMOTIONS]),
        F.array(*[(per_label[lab] + F.lit(PRIOR[lab])) / total for lab in EMOTIONS]))


def lexicon_scorer(df: DataFrame, text_col: str = "text", keep_scores: bool = False) -> DataFrame:
    """Native lexicon scoring; adds sentiment_label, confidence_score (and all_scores).

    The hits are a projection of their own, so the scan of the text is not repeated per label."""
    out = df.withColumn("_hits", lexicon_hits(F.col(text_col)))
    out = out.withColumn("all_scores", lexicon_scores(F.col("_hits"))).drop("_hits")
    out = out.withColumns({
        "sentiment_label": argmax_label(F.col("all_scores")),
        "confidence_score": F.array_max(F.map_values(F.col("all_scores"))),
    })
    return out if keep_scores else out.drop("all_scores")


def lexicon_scorer_sql(text: str) -> tuple[str, str]:
    """DuckDB (label, confidence) expressions equal to ``lexicon_scorer``."""
    from ..functions.labels import sql_list
    t = f"coalesce({text}, '')"
    toks = f"regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}_]+')"
    hits = {lab: (f"len(list_filter({toks}, lambda w: w IN ({sql_list(ws)})))" if ws else "0")
            for lab, ws in LEXICON.items()}
    total = "(" + " + ".join(hits[lab] for lab in EMOTIONS) + f" + {PRIOR_TOTAL!r})"
    s = {lab: f"(({hits[lab]}) + {PRIOR[lab]!r}) / {total}" for lab in EMOTIONS}
    conf = "greatest(" + ", ".join(s[lab] for lab in EMOTIONS) + ")"
    label = "CASE " + " ".join(f"WHEN {s[lab]} = {conf} THEN '{lab}'" for lab in EMOTIONS) + " END"
    return label, conf


# ---- C2: pluggable pandas batch scorer --------------------------------------------------------
Scorer = Callable[[pd.Series], pd.DataFrame]
"""A scorer maps a Series of texts to a DataFrame with one probability column per label."""


class PandasLexiconScorer:
    """pandas twin of C5 (same words, lexicon and prior), one vectorised pass over a batch."""

    labels = EMOTIONS

    def __init__(self):
        self._label_of = {w: EMOTIONS.index(lab) for lab, ws in LEXICON.items() for w in ws}
        self._words = r"(?<!\w)(?:" + "|".join(sorted(self._label_of)) + r")(?!\w)"

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        hits = np.zeros((len(texts), len(EMOTIONS)))
        lowered = texts.fillna("").astype(str).str.lower().reset_index(drop=True)
        found = lowered.str.findall(self._words).explode().dropna().map(self._label_of)
        np.add.at(hits, (found.index.to_numpy(np.int64), found.to_numpy(np.int64)), 1)
        prior = np.array([PRIOR[lab] for lab in EMOTIONS])
        probs = (hits + prior) / (hits.sum(axis=1, keepdims=True) + PRIOR_TOTAL)
        return pd.DataFrame(probs, columns=EMOTIONS, index=texts.index)


def score_with(df: DataFrame, scorer: Scorer | None = None, *, factory: Callable[[], Scorer] | None = None,
               text_col: str = "text", batch_size: int = 128, keep_scores: bool = False) -> DataFrame:
    """Score every row with a pandas scorer; only the text column goes to Python.

    ``scorer`` is a callable on a Series of texts.  ``factory`` is a function or class without
    arguments that makes one; it is called once per task, e.g. to load a model on the executor.
    """
    if scorer is not None and factory is not None:
        raise ValueError("give a scorer or a factory, not both")
    make = factory or (PandasLexiconScorer if scorer is None else lambda: scorer)
    kind = "sentiment_label string, confidence_score double" + (", scores array<struct<label string, p double>>" if keep_scores else "")

    columns = ["sentiment_label", "confidence_score", *(["scores"] if keep_scores else [])]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = make()
        for texts in batches:
            parts = []
            for start in range(0, len(texts), batch_size):
                probs = score(texts.iloc[start:start + batch_size])
                values = probs.to_numpy(dtype=float)
                best = values.argmax(axis=1)            # first maximum wins, as in the reference
                part = {"sentiment_label": np.asarray(probs.columns, object)[best], "confidence_score": values.max(axis=1)}
                if keep_scores:
                    part["scores"] = [[{"label": c, "p": p} for c, p in zip(probs.columns, row)] for row in values.tolist()]
                parts.append(pd.DataFrame(part))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in columns})

    udf = F.pandas_udf(run, kind)
    out = df.drop("sentiment_label", "confidence_score", "all_scores").withColumn("_scored", udf(F.col(text_col)))
    cols = {"sentiment_label": F.col("_scored.sentiment_label"), "confidence_score": F.col("_scored.confidence_score")}
    if keep_scores:
        cols["all_scores"] = F.map_from_entries("_scored.scores")
    return out.withColumns(cols).drop("_scored")
