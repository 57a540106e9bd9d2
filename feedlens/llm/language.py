"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector.  An n-gram vector binds (multiplies) its letters' vectors, each
permuted by its place in the n-gram; a text's vector bundles (adds) the vectors of its n-grams, and a
language's prototype bundles its documents.  A text gets the language whose prototype has
the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks_by_bytes, held_out
from .words import mix

DIMENSIONS = 1024
NGRAM = 3
#: Training documents per language at most, those with the smallest hash of their id.
DOCS_PER_LANGUAGE = 1500
#: Languages learnt at most, those with the most documents; it bounds what is broadcast and collected.
MOST_LANGUAGES = 2000
UNKNOWN = "und"
_U = np.uint64
_RANGE = 1 << 40
#: N-gram vectors held at once.
_COLUMNS = 8192


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The random +1/-1 vectors of code points; they depend on nothing but the code point."""
    words = mix((points.astype(_U)[:, None] << _U(20)) + np.arange(1, DIMENSIONS // 64 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    bits = np.unpackbits(mix(words).view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def _is_letter(point: int) -> bool:
    return chr(point).isalpha()


def bundle(texts: list[str]) -> np.ndarray:
    """Unit vectors (rows x DIMENSIONS) of texts; a text without a letter is the zero vector.

    Case does not matter, and anything between letters counts as one boundary mark.  An n-gram counts
    with the square root of its occurrences, so that repeated lines do not drown the rest.
    """
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return out
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    seen = np.flatnonzero(np.bincount(points))
    letters = np.array([p for p in seen if _is_letter(p)], np.int64)
    number = np.zeros(int(seen[-1]) + 1, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    mark = number[points]
    keep = np.ones(len(mark), bool)
    keep[1:] = (mark[1:] > 0) | (mark[:-1] > 0) | (row[1:] != row[:-1])
    mark, row = mark[keep], row[keep]
    n = len(mark) - NGRAM + 1
    if n <= 0 or not len(letters):
        return out
    base = len(letters) + 1
    code = np.zeros(n, np.int64)
    for j in range(NGRAM):
        code = code * base + mark[j:j + n]
    ok = row[:n] == row[NGRAM - 1:]
    top = base ** NGRAM
    key = np.sort(row[:n][ok] * top + code[ok])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.sqrt(np.diff(np.append(first, len(key)))).astype(np.float32)
    key = key[first]
    grams, column = np.unique(key % top, return_inverse=True)
    row = key // top
    boundary = np.array([0], np.int64)
    vectors = letter_vectors(np.concatenate([boundary, letters]))
    places = [np.roll(vectors, NGRAM - 1 - j, axis=1) for j in range(NGRAM)]
    for k in range(0, len(grams), _COLUMNS):
        part = grams[k:k + _COLUMNS]
        bound = np.ones((len(part), DIMENSIONS), np.int8)
        for j in range(NGRAM):
            bound *= places[j][(part // base ** (NGRAM - 1 - j)) % base]
        here = (column >= k) & (column < k + _COLUMNS)
        counts = np.zeros((len(texts), len(part)), np.float32)
        counts[row[here], column[here] - k] = times[here]
        out += counts @ bound.astype(np.float32)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, the sum of the vectors of one partition's documents."""
    sums: dict[str, np.ndarray] = {}
    for b in chunks_by_bytes(batches, "text", 1 << 20):
        vectors = bundle([t or "" for t in b.column("text").to_pylist()])
        names = np.array(b.column("lang").to_pylist(), object)
        for name in set(names.tolist()):
            sums[name] = sums.get(name, 0) + vectors[names == name].sum(0, dtype=np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                     ["lang", "bundle"])


def learn_prototypes(df: DataFrame, text_col: str, lang_col: str, id_col: str,
                     docs_per_language: int = DOCS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, their unit prototypes) from at most ``docs_per_language`` documents (ids) of each of the
    ``most_languages`` languages with the most documents, held-out ones excepted; what reaches the
    driver is one vector per language."""
    labelled = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                         held_out(id_col).alias("out")).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL AND NOT out")
    # A language with millions of documents first keeps a share of its hash range that holds a little
    # more than the bound, so that ranking never gathers all of a language's rows in one task.
    ids = labelled.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(_RANGE)).alias("h"))
    # Ids are what is hashed, so distinct ids are what counts (an estimate within a few per cent).
    share = ids.groupBy("lang").agg(F.approx_count_distinct("id", 0.03).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    share = share.select("lang", (F.lit(1.5 * docs_per_language * _RANGE) / F.col("n")).alias("top"))
    near = ids.join(F.broadcast(share), "lang").where("h < top").select("lang", "h", "id").distinct()     # at most most_languages rows
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= docs_per_language).select("id", "lang")
    sample = labelled.join(F.broadcast(chosen), ["id", "lang"], "left_semi")   # bounded by the two parameters
    partial = sample.select("lang", "text").mapInArrow(_profile, "lang string, bundle array<double>")
    summed = partial.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v")).collect()
    rows = sorted((r for r in rows), key=lambda r: r[0])
    if not rows:
        return [], np.zeros((0, DIMENSIONS))
    v = np.array([r[1] for r in rows])
    v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    if len(v) > 1:                      # what all languages share tells them apart no better
        v = v - v.mean(0)
        v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    return [r[0] for r in rows], v


def _predict(names: list[str], prototypes: np.ndarray):
    proto = prototypes.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_by_bytes(batches, "text", 1 << 20):
            vectors = bundle([t or "" for t in b.column("text").to_pylist()])
            has = vectors.any(1) & bool(names)
            cosine = vectors @ proto.T if names else np.zeros((len(vectors), 1), np.float32)
            best = cosine.argmax(1)
            score = np.clip((1 + cosine[np.arange(len(best)), best].astype(np.float64)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, has)], pa.string()), pa.array(np.where(has, score, 0.0))],
                ["id", "lang_pred", "score"])
    return run


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """One row per document: (id, held_out, lang_pred, score).

    Prototypes are learnt from rows with a language and a text that are not held out; the prediction
    reads the whole text and nothing else.  ``score`` is the winning cosine mapped to 0..1.  A null
    text, one without a letter, and any text if no row has a language, get ``und`` and 0.  Repeated rows
    are predicted each, ties go to the first language by name.
    """
    names, prototypes = learn_prototypes(df, text_col, lang_col, id_col, docs_per_language)
    kind = df.schema[id_col].dataType
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _predict(names, prototypes), f"id {kind.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
