"""Quality classification: histogram gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over the bytes and words of whole texts.  Trees are grown on
binned statistics of a bounded labelled sample and flattened into complete arrays, level by
level, so that scoring a batch is ``depth`` array look-ups per tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_bytes, held_out
from .words import Words

#: Labelled documents the model is fitted on at most, those with the smallest hash of their id.
SAMPLE_DOCS = 12_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2, LEAST_LEAF = 100, 3, 64, 0.15, 1.0, 2.0
#: Byte classes counted one by one: ASCII punctuation, and groups.
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32], "newline": [10, 13],
           "control": [*range(0, 9), 11, 12, *range(14, 32), 127], "wide": range(128, 256)}
FEATURES = [*_GROUPS, *(f"byte_{c}" for c in _PUNCTUATION), "log_words", "log_bytes", "word_bytes", "word_spread", "long_words",
            "distinct_words", "distinct_fours", "same_as_before", "words_per_line", "lone_letters"]


def _class_of_byte() -> np.ndarray:
    of = np.zeros(256, np.int64)
    for k, members in enumerate(_GROUPS.values()):
        of[list(members)] = k
    of[_PUNCTUATION] = len(_GROUPS) + np.arange(len(_PUNCTUATION))
    return of


_CLASS = _class_of_byte()
_CLASSES = len(_GROUPS) + len(_PUNCTUATION)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """(rows x FEATURES) statistics of texts; null and empty texts are all zero."""
    words = Words(column, lower=True)
    n = words.rows
    size = np.diff(words.offsets)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * _CLASSES + _CLASS[words.data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    lines = share[:, list(_GROUPS).index("newline")] + 1.0
    bytes_ = np.maximum(size, 1)
    count = words.counts()
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(np.float64)
    mean = np.bincount(words.row, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(words.row, length * length, n) / some - mean * mean, 0))
    _, fours = words.windows(4)
    four_rows = words.row[words.windows(4)[0]]
    four_count = np.maximum(np.bincount(four_rows, minlength=n), 1)
    again = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1]) if len(words.hash) else np.empty(0, bool)
    out = [share / bytes_[:, None], np.log1p(count), np.log1p(size), mean, spread,
           np.bincount(words.row, length > 15, n) / some, _distinct(words.row, words.hash, n) / some,
           _distinct(four_rows, fours, n) / four_count, np.bincount(words.row[1:][again], minlength=n) / some if len(words.hash) else np.zeros(n),
           np.log1p(count / lines), np.bincount(words.row, length == 1, n) / some]
    return np.concatenate([x.reshape(n, -1) for x in out], 1).astype(np.float32)


@dataclass
class Forest:
    """Complete trees in arrays: node ``k`` of a level goes to ``2k`` or ``2k + 1`` of the next one."""

    feature: np.ndarray     # trees x (2**depth - 1)
    cut: np.ndarray         # trees x (2**depth - 1): right if the statistic is above it
    leaf: np.ndarray        # trees x 2**depth
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                at = node + (1 << level) - 1
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for the logistic loss; every level picks, per node, the best of all histogram cuts."""
    n, width = x.shape
    positive = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(positive / (1 - positive)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if n else np.empty(0) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if n else np.zeros((0, width), np.int64)
    cuts = np.full((width, BINS), np.inf, np.float32)
    for f, e in enumerate(edges):
        cuts[f, :len(e)] = e
    margin = np.full(n, start)
    forest = Forest(np.zeros((trees, 2 ** depth - 1), np.int64), np.full((trees, 2 ** depth - 1), np.inf, np.float32), np.zeros((trees, 2 ** depth)), start)
    if not n:
        return forest
    flat = binned + np.arange(width) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 1 << level
            at = (node[:, None] * (width * BINS) + flat).ravel()
            shape = (nodes, width, BINS)
            gs = np.bincount(at, np.repeat(g, width), nodes * width * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(at, np.repeat(h, width), nodes * width * BINS).reshape(shape).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs ** 2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt ** 2 / (ht + L2)
            gain[(hs < LEAST_LEAF / 4) | (ht - hs < LEAST_LEAF / 4) | ~np.isfinite(cuts)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            feature, bin_ = best // BINS, best % BINS
            useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            forest.feature[t, nodes - 1:2 * nodes - 1] = feature
            forest.cut[t, nodes - 1:2 * nodes - 1] = np.where(useful, cuts[feature, bin_], np.inf)
            node = 2 * node + (x[np.arange(n), feature[node]] > forest.cut[t, nodes - 1 + node])
        gs, hs = np.bincount(node, g, 2 ** depth), np.bincount(node, h, 2 ** depth)
        forest.leaf[t] = RATE * gs / (hs + L2)
        margin += forest.leaf[t][node]
    return forest


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks_by_bytes(batches, "text", 1 << 20):
        x = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, sample_docs: int) -> Forest:
    """A forest from at most ``sample_docs`` labelled documents that are not held out.

    Only the sample's statistics reach the driver, of at most ``sample_docs`` rows, however many rows one id has.
    Several labels of one id count as their mean.
    """
    chosen = (labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
              .where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id")).groupBy("id").agg(F.avg("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_docs))
    sample = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = sample.select("id", "label", "text").mapInArrow(_with_statistics, "id long, label double, x binary")
    rows = rows.orderBy(F.xxhash64("id", "x"), "id", "x").limit(sample_docs).collect()
    rows.sort(key=lambda r: (r[0], bytes(r[2])))
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] >= 0.5 for r in rows], np.float64))


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_by_bytes(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(forest.score(statistics(b.column("text"))))], ["id", "score"])
    return run


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
                  label_col: str = "quality", threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: (id, held_out, score, predicted).

    ``score`` (0..1, higher: label 1 likelier) depends on the whole text alone; ``predicted`` is 1 from
    ``threshold`` on.  Null and empty texts are scored by their (zero) statistics.  Without any usable
    label every score is 0.5.  Repeated rows are scored each; other columns are not read.
    """
    forest = learn(df, labels, id_col, text_col, label_id, label_col, sample_docs)
    kind = df.schema[id_col].dataType
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _score(forest), f"id {kind.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``df`` whose own text scores ``threshold`` or more, unchanged."""
    forest = learn(df, labels, id_col, text_col, "doc_id", "quality", sample_docs)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_by_bytes(batches, text_col, 1 << 20):
            yield b.filter(pa.array(forest.score(statistics(b.column(text_col))) >= threshold))

    return df.mapInArrow(run, schema)
