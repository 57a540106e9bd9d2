"""Tokenizer and stop words for keyword extraction (W2) and the lexicon scorer."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .labels import sql_list

# ---- fixed values (must equal the reference) -------------------------------------------------
# Stop words of the keyword extractor, in the reference's order ('her' appears twice there).
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "as", "is", "was", "are", "were", "been", "be", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "me", "him", "her", "us", "them", "my", "your", "his", "her", "its", "our", "their",
    "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "all",
    "each", "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "just",
]
# A keyword is a whole word of three or more ASCII lower-case letters (after lower-casing).
KEYWORD_PATTERN = "^[a-z]{3,}$"
# Keyword extraction is skipped when the joined texts of a group are shorter than this.
MIN_JOINED_CHARS = 50
# ------------------------------------------------------------------------------------------------

# Word characters as Python's Unicode ``\w``: letters, numbers, underscore.  Splitting on runs of
# anything else and keeping whole tokens that match KEYWORD_PATTERN equals ``\b[a-z]{3,}\b``.
UNIQUE_STOP_WORDS = sorted(set(STOP_WORDS))
# The same whole-token rule as one scan: a run of [a-z]{3,} not touching another word character.
_WORD_CHAR = "[\\p{L}\\p{N}_]"
KEYWORD_TOKEN_REGEX = f"(?<!{_WORD_CHAR})[a-z]{{3,}}(?!{_WORD_CHAR})"


def whole_words_regex(words_: list[str]) -> str:
    """Regex matching any of ``words_`` as a whole token.  The look-ahead for a first letter fails fast
    at most positions of a text."""
    alt = sorted(set(words_), key=lambda w: (-len(w), w))
    first = "".join(sorted({w[0] for w in alt}))
    return f"(?<!{_WORD_CHAR})(?=[{first}])(?:{'|'.join(map(re.escape, alt))})(?!{_WORD_CHAR})"


def candidate_keywords(text: Column | str) -> Column:
    """Array of whole tokens of three or more ASCII letters, in text order (one regex scan,
    codegen'd; short, accented and digit-bearing tokens never leave the scan)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(KEYWORD_TOKEN_REGEX), 0)


def keyword_tokens_sql(text: str, stop_words: list[str] | None = None) -> str:
    """DuckDB form: list of keyword tokens of ``text``."""
    stops = UNIQUE_STOP_WORDS if stop_words is None else sorted(set(stop_words))
    return (f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({sql_list(stops)}))")
