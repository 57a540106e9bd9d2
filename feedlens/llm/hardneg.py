"""Hard negatives from embeddings by Kronecker-packed products.

Vectors become integers and are laid into blocks, sorted by label.  In a comparison of an anchor block with a
candidate block, the components of several candidates are biased to be non-negative and packed into
separated fields of one wide integer.  One multiplication per anchor component and one sum then
give the exact scores of all packed candidates at once, from which the fields are taken apart.  Fields
are as wide as the blocks' norms need (Cauchy-Schwarz), and the wide integer keeps to the 53 bits that a
double holds exactly, so that the products run as one matrix product.  Scores that leave no room
for it are summed in 64-bit integers.

Two rounds: an anchor block meets the blocks that share a label with it, which gives the positives; then it
meets every block with the score windows of its positives.  Only the best few rows per anchor (or per
anchor and positive) leave a comparison, and a window keeps the best of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pow2_at_least

#: Rows of a candidate block and of an anchor block, smallest and largest.
CANDIDATES, ANCHORS = (256, 8192), (64, 2048)
#: Scores held at once by one comparison.
HELD = 1 << 20
_EXACT = 53
_MOST = 1 << 62


class Block:
    """Integer vectors with labels and ids, in the order (label, id)."""

    def __init__(self, row: dict):
        n = row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.named = np.frombuffer(row["named"], bool)          # has an id
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.int32).reshape(n, -1).astype(np.int64)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _norm(x: np.ndarray) -> int:
    """Upper bound of the Euclidean norms of integer rows, as an integer."""
    most = int(np.abs(x).max(initial=0))
    if most ** 2 * max(1, x.shape[1]) < 1 << 63:
        return math.isqrt(int((x * x).sum(1).max(initial=0))) + 1
    return most * (math.isqrt(max(1, x.shape[1])) + 1)


@dataclass
class Packed:
    """Candidates, ``fields`` of them in one wide integer; field ``k`` holds the rows k, k + fields, ..."""

    wide: np.ndarray        # (components, ceil(n / fields))
    n: int
    fields: int
    bits: int
    bias: int               # added to every component
    bound: int              # no field's sum is larger in magnitude


def pack(candidates: np.ndarray, anchor_norm: int) -> Packed:
    """Pack candidates for anchors of a norm up to ``anchor_norm``."""
    n, width = candidates.shape
    bias = max(0, -int(candidates.min(initial=0)))
    bound = anchor_norm * _norm(candidates + bias)
    if bound >= _MOST:
        raise ValueError("scores do not fit a long")
    bits = (2 * bound + 1).bit_length()
    fields = _EXACT // bits
    if fields == 0:
        return Packed(candidates.T.copy(), n, 0, bits, 0, bound)
    groups = -(-n // fields)
    laid = np.full((groups * fields, width), 0, np.int64)
    laid[:n] = candidates + bias
    shift = (np.arange(fields) * bits)[None, :, None]
    wide = (laid.reshape(groups, fields, width) << shift).sum(1)
    return Packed(np.ascontiguousarray(wide.T, np.float64), n, fields, bits, bias, bound)


def scores(anchors: np.ndarray, packed: Packed) -> np.ndarray:
    """Exact inner products (anchors x candidates)."""
    if packed.fields == 0:
        return anchors @ packed.wide
    summed = (anchors.astype(np.float64) @ packed.wide).astype(np.int64)
    # A bound added to every field makes all of them non-negative, so that they come apart by shifts.
    summed += sum(packed.bound << (k * packed.bits) for k in range(packed.fields))
    out = np.empty((len(anchors), summed.shape[1] * packed.fields), np.int64)
    mask = (1 << packed.bits) - 1
    for k in range(packed.fields):
        out[:, k::packed.fields] = (summed >> (k * packed.bits)) & mask
    out -= packed.bound + packed.bias * anchors.sum(1)[:, None]
    return out[:, :packed.n]


def _best(group: np.ndarray, score: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` entries per group: higher scores first, then smaller places."""
    order = np.lexsort((place, -score, group))
    g = group[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < most]


def _prepare(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("vector")
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            whole = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            first = np.append(0, np.cumsum(size))
            row = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(row[~np.isfinite(whole)], minlength=len(size)) > 0
            q = np.floor(np.where(np.isfinite(whole), whole, 0) * scale)
            if len(q) and np.abs(q[~bad[row]]).max(initial=0) >= 1 << 31:
                raise ValueError("a scaled component does not fit 32 bits")
            q = np.where(bad[row], 0, q).astype(np.int32)
            out = pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("anchor"),
                                              pa.array([q[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())],
                                             ["id", "label", "anchor", "vector"])
            yield out.filter(pa.array(~bad))
    return run


def _laid(rows: int):
    """Blocks of at most ``rows`` rows from a partition sorted by (label, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = made = 0
        part = TaskContext.get().partitionId()

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            vectors = t.column("vector").to_pylist()
            width = max(map(len, vectors))
            ids = t.column("id")
            labels = t.column("label").to_numpy()
            made += 1
            one = {"block": (part << 32) + made, "n": t.num_rows, "ids": pc.fill_null(ids, 0).to_numpy().astype(np.int64).tobytes(),
                   "named": pc.is_valid(ids).to_numpy().astype(bool).tobytes(), "labels": labels.astype(np.int64).tobytes(),
                   "vectors": b"".join(v.ljust(width, b"\0") for v in vectors), "of": np.unique(labels).tolist()}
            return pa.RecordBatch.from_pylist([one], pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("named", pa.binary()),
                                                                ("labels", pa.binary()), ("vectors", pa.binary()), ("of", pa.list_(pa.int64()))]))

        for b in batches:
            held.append(b)
            count += b.num_rows
            while count >= rows:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, rows))
                held, count = t.slice(rows).to_batches(), count - rows
        if count:
            yield block(pa.Table.from_batches(held))
    return run


_BLOCK = "block long, n int, ids binary, named binary, labels binary, vectors binary, of array<long>"


def _blocks(rows: DataFrame, n: int, sizes: tuple[int, int], pieces: int) -> tuple[DataFrame, int]:
    """Durable blocks of ``n`` rows and how many there are (a few more than needed); many rows of one id
    are told apart by their place in the input, so that they spread too."""
    size = min(sizes[1], pow2_at_least(n / pieces, sizes[0]))
    parts = max(1, math.ceil(n / (8 * size)))
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, "label", F.col("id").asc_nulls_last(), "place")
    laid = dealt.sortWithinPartitions("label", F.col("id").asc_nulls_last(), "vector").select("id", "label", "vector").mapInArrow(_laid(size), _BLOCK)
    return durable(laid), math.ceil(n / size) + parts


def _met(cells: DataFrame, anchors: DataFrame, candidates: DataFrame, parts: int) -> DataFrame:
    """The payloads of each comparison (anchor block, candidate block) side by side."""
    left = anchors.select(F.col("block").alias("a"), F.struct(*[c for c in anchors.columns if c not in ("block", "of")]).alias("anchors"))
    right = candidates.select(F.col("block").alias("c"), F.struct("n", "ids", "named", "labels", "vectors").alias("candidates"))
    return cells.join(left, "a").repartition(parts, "c").join(right.repartition(parts, "c"), "c").select("a", "anchors", "candidates")


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """One comparison after another, so that only one is held as Python objects."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def _chunks(anchors: np.ndarray, packed: Packed) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, HELD // max(1, packed.n))
    for k in range(0, len(anchors), step):
        yield k, scores(anchors[k:k + step], packed)


_POSITIVE = "a long, p int, anchor_id long, id long, score long"


def _positives(most: int):
    """Per anchor the best rows of its own label (and another id) in each comparison."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                a, c = Block(row["anchors"]), Block(row["candidates"])
                width = max(a.x.shape[1], c.x.shape[1])
                for label in np.intersect1d(a.labels, c.labels):
                    # Both blocks are sorted by label.
                    i0, i1 = np.searchsorted(a.labels, [label, label + 1])
                    j0, j1 = np.searchsorted(c.labels, [label, label + 1])
                    mine = _padded(a.x[i0:i1], width)
                    packed = pack(_padded(c.x[j0:j1], width), _norm(mine))
                    ids, named = c.ids[j0:j1], c.named[j0:j1]
                    for k, s in _chunks(mine, packed):
                        own = (a.ids[i0 + k:i0 + k + len(s), None] == ids[None]) & named[None]
                        few = min(most, s.shape[1])
                        s = np.where(own, np.iinfo(np.int64).min, s)
                        least = np.partition(s, s.shape[1] - few, 1)[:, s.shape[1] - few]
                        x, y = np.nonzero((s >= least[:, None]) & ~own)
                        pick = _best(x, s[x, y], y, most)
                        x, y = x[pick], y[pick]
                        at = i0 + k + x
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(x), row["a"]), pa.int64()), pa.array(at, pa.int32()), pa.array(a.ids[at], pa.int64()),
                            pa.array(ids[y], pa.int64(), mask=~named[y]), pa.array(s[x, y], pa.int64())], ["a", "p", "anchor_id", "id", "score"])
    return run


_NEGATIVE = "a long, p int, anchor_id long, k int, positive_id long, positive_score long, id long, score long"


def _negatives(most: int, low: int, high: int):
    """Per anchor and positive the best rows of another label in the positive's score window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                a, c = Block(row["anchors"]), Block(row["candidates"])
                width = max(a.x.shape[1], c.x.shape[1])
                wanted = row["anchors"]["wanted"]
                p = np.array([w["p"] for w in wanted], np.int64)
                k = np.array([w["k"] for w in wanted], np.int64)
                of = np.array([w["score"] for w in wanted], np.int64)
                # low * of <= 100 * score <= high * of, in whole numbers without overflow.
                bottom = np.array([-((-low * v) // 100) for v in of.tolist()], np.int64)
                top = np.array([high * v // 100 for v in of.tolist()], np.int64)
                used = np.unique(p)
                lowest, highest = np.full(len(a.ids), _MOST), np.full(len(a.ids), -_MOST)
                np.minimum.at(lowest, p, bottom)
                np.maximum.at(highest, p, top)
                mine = _padded(a.x[used], width)
                packed = pack(_padded(c.x, width), _norm(mine))
                for first, s in _chunks(mine, packed):
                    at = used[first:first + len(s)]
                    x, y = np.nonzero((s >= lowest[at][:, None]) & (s <= highest[at][:, None]) & (a.labels[at][:, None] != c.labels[None]))
                    score = s[x, y]
                    order = np.lexsort((c.ids[y], ~c.named[y], -score, x))
                    x, y, score = x[order], y[order], score[order]
                    begin = np.searchsorted(x, np.arange(len(s)))
                    end = np.searchsorted(x, np.arange(len(s)), side="right")
                    out = []
                    for w in np.flatnonzero((p >= at[0]) & (p <= at[-1])):
                        i = int(np.searchsorted(at, p[w]))
                        # Scores of one anchor fall, so the window is a stretch of them.
                        mine_s = -score[begin[i]:end[i]]
                        lo, hi = begin[i] + np.searchsorted(mine_s, -top[w]), begin[i] + np.searchsorted(mine_s, -bottom[w], side="right")
                        out += [(w, j) for j in range(lo, min(hi, lo + most))]
                    if out:
                        w, j = np.array(out).T
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(w), row["a"]), pa.int64()), pa.array(p[w], pa.int32()), pa.array(a.ids[p[w]], pa.int64()), pa.array(k[w], pa.int32()),
                            pa.array([wanted[i]["id"] for i in w], pa.int64()), pa.array(of[w], pa.int64()),
                            pa.array(c.ids[y[j]], pa.int64(), mask=~c.named[y[j]]), pa.array(score[j], pa.int64())],
                            ["a", "p", "anchor_id", "k", "positive_id", "positive_score", "id", "score"])
    return run


def _ranked(df: DataFrame, by: list[str], name: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def mine_hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                        scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor's negatives.

    A component ``x`` counts as ``floor(scale * x)``; a score is the integer inner product.  Higher scores
    come first, ties by the smaller id (a null id last).  ``anchors`` (a condition on ``df``) picks the
    anchors; an anchor's positives are its first ``positives`` rows of the same label and another id, and each
    positive brings the first ``negatives`` rows of another label with ``low * positive_score <= 100 *
    negative_score <= high * positive_score``.

    Rows with a null label, a null vector, or a null or non-finite component take no part; a null anchor
    condition or a null id is no anchor.  A shorter vector counts as padded with zeros, an empty one has the
    score 0 everywhere.  Repeated rows take part each, and a repeated anchor gives its rows repeatedly.
    Components beyond 32 bits or scores beyond 62 bits fail the job.  Labels and ids are integers; other columns
    are not read; an empty table gives no rows.
    """
    flagged = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.coalesce(anchors & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    rows = flagged.where("label IS NOT NULL AND vector IS NOT NULL").mapInArrow(_prepare(scale), "id long, label long, anchor boolean, vector binary")
    total, chosen = rows.agg(F.count("*"), F.count_if("anchor")).first()
    candidate_blocks, n_candidates = _blocks(rows, total, CANDIDATES, 64)
    anchor_blocks, n_anchors = _blocks(rows.where("anchor"), chosen, ANCHORS, 4)
    parts = max(1, 2 * n_candidates)

    # First round: blocks that share a label.
    own = anchor_blocks.select(F.col("block").alias("a"), F.explode("of").alias("label"))
    theirs = candidate_blocks.select(F.col("block").alias("c"), F.explode("of").alias("label"))
    cells = own.join(theirs, "label").select("a", "c").distinct()
    found = _met(cells, anchor_blocks, candidate_blocks, parts).mapInArrow(_positives(positives), _POSITIVE)
    best = durable(_ranked(found, ["a", "p"], "k", positives))

    # Second round: every block, with the windows of the positives beside the anchors.
    wanted = best.groupBy(F.col("a").alias("block")).agg(F.collect_list(F.struct("p", "k", "id", "score")).alias("wanted"))
    seeking = anchor_blocks.join(wanted, "block")
    buckets = max(1, n_anchors)
    own = seeking.select(F.col("block").alias("a"), F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int").alias("bucket"))
    theirs = candidate_blocks.select(F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    cells = own.join(theirs, "bucket").select("a", "c")
    found = _met(cells, seeking, candidate_blocks, parts).mapInArrow(_negatives(negatives, low, high), _NEGATIVE)
    best = _ranked(found, ["a", "p", "k"], "rank", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                       "positive_score", F.col("score").alias("negative_score"))
