"""Substring de-duplication by level-wise doubling over word windows.

A window of ``window`` words can only be repeated if the shorter windows at its two ends are.  Levels
therefore run from about seven words up to ``window``, each at most twice the length before it:
windows found repeated at one length are the only ones extended to the next, until none is left.

Documents are dealt into batches by id.  At each level but the last a batch sends, per hash bucket, the
sorted short fingerprints of its surviving windows (about two bytes each) and gets back those that
another document has too; a fingerprint that meets by chance only survives one level too long.  At the
last level the survivors are compared by two independent 64-bit hashes, and a batch learns the smallest id
of a document in which the window starts.  A batch sends a window once however many of its documents
have it, so a passage that a third of all documents share costs one entry per batch and level.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pow2_at_least, text_bytes
from .words import CHECK_SEED, Words

#: Text in one batch of documents, and text whose windows one bucket compares.
BATCH_BYTES, MOST_BATCH_BYTES, BUCKET_BYTES = 8 << 20, 64 << 20, 32 << 20
#: At least so many batches and buckets, so that small inputs spread too.
LEAST_PARTS = 64
#: Bits of a fingerprint within its bucket.
FINGERPRINT_BITS = 28
_NO_ID = (1 << 63) - 1
_U = np.uint64


def level_lengths(window: int, shortest: int = 7) -> list[int]:
    """Window lengths of the levels; each is at most twice the one before."""
    lengths = [window]
    while lengths[0] > shortest:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths if len(lengths) > 1 else [window, window]


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending values as two-byte steps; a larger step is a row of 65535s and the rest."""
    steps = np.diff(sorted_values.astype(np.int64), prepend=0)
    big = steps // 65535
    out = np.full(len(steps) + int(big.sum()), 65535, np.uint16)
    out[np.arange(len(steps)) + np.cumsum(big)] = steps - big * 65535
    return out.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def _member(values: np.ndarray, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it in the list, its index there)."""
    if not len(ascending):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values, at


def _same(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where a new window begins in a list ordered by (hash, check)."""
    return np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1]))) if len(hashes) else np.empty(0, np.int64)


def _find(hashes: np.ndarray, checks: np.ndarray, known: np.ndarray, known_checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the window known, its index) in a list ordered by (hash, check)."""
    if not len(known):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    last = len(known) - 1
    at = np.minimum(np.searchsorted(known, hashes), last)
    while True:                 # several windows of one hash: go on to the one of the same check
        on = (known[at] == hashes) & (known_checks[at] < checks) & (at < last)
        if not on.any():
            return (known[at] == hashes) & (known_checks[at] == checks), at
        at = at + on


def _bounds(buckets_of_sorted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, bounds of their slices) of an ascending list of bucket numbers."""
    starts = np.flatnonzero(np.diff(buckets_of_sorted, prepend=-1))
    return buckets_of_sorted[starts], np.append(starts, len(buckets_of_sorted))


class _Level:
    """The tasks of one run; ``bits`` is the number of bucket bits."""

    def __init__(self, bits: int):
        self.bits = bits
        self.shift = _U(64 - bits - FINGERPRINT_BITS)

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def send_short(self, batch: int, rows: np.ndarray, prints: np.ndarray, n_rows: int) -> pa.Table:
        """Distinct fingerprints per bucket, and which of them two documents of the batch have."""
        key = np.unique(prints * n_rows + rows)
        value = key // max(n_rows, 1)
        first = np.flatnonzero(np.diff(value, prepend=-1))
        twice = np.diff(np.append(first, len(value))) > 1
        value = value[first]
        names, at = _bounds(value >> FINGERPRINT_BITS)
        low = value & ((1 << FINGERPRINT_BITS) - 1)
        return pa.table({
            "bucket": pa.array(names, pa.int32()), "batch": pa.array(np.full(len(names), batch), pa.int32()),
            "prints": pa.array([pack(low[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
            "twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

    def first_level(self, length: int):
        def run(t: pa.Table) -> pa.Table:
            words = Words(t.column("text"))
            at, hashes = words.windows(length)
            return self.send_short(t.column("batch")[0].as_py(), words.row[at], self.short(hashes), words.rows)
        return run

    def common(self):
        """Per bucket: give every batch those of its fingerprints that two documents have."""
        def run(t: pa.Table) -> pa.Table:
            prints = [unpack(x) for x in t.column("prints").to_pylist()]
            twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool)
                     for x, p in zip(t.column("twice").to_pylist(), prints)]
            everything = np.sort(np.concatenate(prints))
            again = np.unique(everything[1:][everything[1:] == everything[:-1]])
            keep = [p[w | _member(p, again)[0]] for p, w in zip(prints, twice)]
            some = [i for i, k in enumerate(keep) if len(k)]
            return pa.table({"batch": t.column("batch").take(pa.array(some, pa.int32())),
                             "bucket": t.column("bucket").take(pa.array(some, pa.int32())),
                             "prints": pa.array([pack(keep[i]) for i in some], pa.binary())})
        return run

    def _survivors(self, t: pa.Table, replies: pa.Table, before: int, length: int):
        """Windows of ``length`` whose two ends of ``before`` words are repeated."""
        words = Words(t.column("text"))
        order = np.argsort(replies.column("bucket").to_numpy())
        lists = replies.column("prints").to_pylist()
        buckets = replies.column("bucket").to_numpy().astype(np.int64)
        repeated = np.concatenate([np.empty(0, np.int64), *((buckets[i] << FINGERPRINT_BITS) + unpack(lists[i]) for i in order)])
        at, hashes = words.windows(before)
        good = np.zeros(len(words.hash), bool)
        good[at] = _member(self.short(hashes), repeated)[0]
        at, hashes = words.windows(length)
        alive = good[at] & good[at + length - before]
        return words, at[alive], hashes[alive]

    def next_level(self, before: int, length: int):
        def run(t: pa.Table, replies: pa.Table) -> pa.Table:
            if not t.num_rows or not replies.num_rows:
                return self.send_short(0, np.empty(0, np.int64), np.empty(0, np.int64), 0)
            words, at, hashes = self._survivors(t, replies, before, length)
            return self.send_short(t.column("batch")[0].as_py(), words.row[at], self.short(hashes), words.rows)
        return run

    def last_level(self, before: int, length: int):
        """Both hashes of the survivors with the smallest and largest id of the batch that has them."""
        def run(t: pa.Table, replies: pa.Table) -> pa.Table:
            if t.num_rows and replies.num_rows:
                words, at, hashes = self._survivors(t, replies, before, length)
                checks = _checks(words, length, at)
                ids = t.column("id").to_numpy()[words.row[at]]
            else:
                hashes, checks, ids = np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64)
            order = np.lexsort((checks, hashes))
            hashes, checks, ids = hashes[order], checks[order], ids[order]
            first = _same(hashes, checks)
            low = np.minimum.reduceat(ids, first) if len(first) else ids
            high = np.maximum.reduceat(ids, first) if len(first) else ids
            hashes, checks = hashes[first], checks[first]
            names, cut = _bounds((hashes >> _U(64 - self.bits)).astype(np.int64))
            parts = list(zip(cut[:-1], cut[1:]))
            batch = t.column("batch")[0].as_py() if t.num_rows else 0
            return pa.table({
                "bucket": pa.array(names, pa.int32()), "batch": pa.array(np.full(len(names), batch), pa.int32()),
                "hashes": pa.array([hashes[a:b].tobytes() for a, b in parts], pa.binary()),
                "checks": pa.array([checks[a:b].tobytes() for a, b in parts], pa.binary()),
                "low": pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()),
                "more": pa.array([np.packbits(low[a:b] < high[a:b]).tobytes() for a, b in parts], pa.binary())})
        return run

    def owners(self):
        """Per bucket: tell every batch the smallest id of the windows that start before in another document."""
        def run(t: pa.Table) -> pa.Table:
            hashes, checks = ([np.frombuffer(x, _U) for x in t.column(c).to_pylist()] for c in ("hashes", "checks"))
            low = [np.frombuffer(x, np.int64) for x in t.column("low").to_pylist()]
            more = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool)
                    for x, h in zip(t.column("more").to_pylist(), hashes)]
            flat, second = np.concatenate(hashes), np.concatenate(checks)
            order = np.lexsort((second, flat))
            first = _same(flat[order], second[order])
            least = np.minimum.reduceat(np.concatenate(low)[order], first)
            smallest = np.empty(len(flat), np.int64)
            smallest[order] = np.repeat(least, np.diff(np.append(first, len(flat))))
            out = {"batch": [], "hashes": [], "checks": [], "least": []}
            at = 0
            for batch, h, c, lo, w in zip(t.column("batch").to_pylist(), hashes, checks, low, more):
                mine = smallest[at:at + len(h)]
                at += len(h)
                told = w | (mine < lo)
                if told.any():
                    out["batch"].append(batch)
                    out["hashes"].append(h[told].tobytes())
                    out["checks"].append(c[told].tobytes())
                    out["least"].append(mine[told].tobytes())
            return pa.table({"batch": pa.array(out["batch"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("hashes", "checks", "least")}})
        return run


def _checks(words: Words, length: int, at: np.ndarray) -> np.ndarray:
    """The second hash of the windows that begin at the words ``at``."""
    where, checks = words.windows(length, words.hashes(CHECK_SEED))
    return checks[np.searchsorted(where, at)]


def _cut(window: int):
    """Drop from a batch's documents the words under windows that start in a document with a smaller id."""
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        words = Words(t.column("text"))
        ids = t.column("id").to_numpy()
        known, second = (np.frombuffer(b"".join(replies.column(c).to_pylist()), _U) for c in ("hashes", "checks"))
        least = np.frombuffer(b"".join(replies.column("least").to_pylist()), np.int64)
        order = np.lexsort((second, known))
        known, second, least = known[order], second[order], least[order]
        at, hashes = words.windows(window)
        hit = np.flatnonzero(_member(hashes, known)[0])
        at, hashes = at[hit], hashes[hit]
        hit, where = _find(hashes, _checks(words, window, at) if len(at) else hashes, known, second)
        at, where = at[hit], where[hit]
        at = at[least[where] < ids[words.row[at]]] if len(at) else at
        depth = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        kept, starts, sizes, removed = [], [], [], np.zeros(words.rows, np.int64)
        for r in range(words.rows):
            a, b = int(words.first[r]), int(words.first[r + 1])
            parts = words.data[words.offsets[r]:words.offsets[r + 1]].tobytes().split()
            out = gone[a:b]
            removed[r] = n = int(out.sum())
            if n:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                starts.append(edge[::2].tolist())
                sizes.append((edge[1::2] - edge[::2]).tolist())
                parts = [parts[i] for i in np.flatnonzero(~out)]
            else:
                starts.append([])
                sizes.append([])
            kept.append(b" ".join(parts).decode())
        return pa.table({"id": t.column("id"), "n_words": pa.array(words.counts(), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "removed_start": pa.array(starts, pa.list_(pa.int32())), "removed_words": pa.array(sizes, pa.list_(pa.int32())),
                         "kept_text": pa.array(kept, pa.string())})
    return run


def drop_repeated_windows(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_words, n_removed, removed_start, removed_words, kept_text).

    A word goes if it lies in ``window`` consecutive words that also start in a document with a
    smaller id.  ``removed_start``/``removed_words`` are the removed stretches as word offsets and
    lengths, ``kept_text`` the kept words joined by one space.  Null, empty and short texts lose
    nothing; repeated rows of one id do not remove each other's words; a null id counts as larger
    than any other.  Ids are integers; other columns are not read.
    """
    total = text_bytes(df, text_col)
    batch_bytes = min(MOST_BATCH_BYTES, max(BATCH_BYTES, math.isqrt(total) * 256))
    batches = max(LEAST_PARTS, math.ceil(total / batch_bytes))
    bits = pow2_at_least(total / BUCKET_BYTES, LEAST_PARTS).bit_length() - 1
    level = _Level(bits)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text")).withColumn(
        "batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    by_batch = rows.groupBy("batch")
    lengths = level_lengths(window)
    short = "bucket int, batch int, prints binary, twice binary"
    sent = by_batch.applyInArrow(level.first_level(lengths[0]), short)
    for before, length in zip(lengths[:-1], lengths[1:]):
        replies = sent.groupBy("bucket").applyInArrow(level.common(), "batch int, bucket int, prints binary")
        pair = by_batch.cogroup(replies.groupBy("batch"))
        if length < window:
            sent = pair.applyInArrow(level.next_level(before, length), short)
        else:
            sent = pair.applyInArrow(level.last_level(before, length), "bucket int, batch int, hashes binary, checks binary, low binary, more binary")
    replies = sent.groupBy("bucket").applyInArrow(level.owners(), "batch int, hashes binary, checks binary, least binary")
    out = by_batch.cogroup(replies.groupBy("batch")).applyInArrow(
        _cut(window), "id long, n_words long, n_removed long, removed_start array<int>, removed_words array<int>, kept_text string")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")).cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)
