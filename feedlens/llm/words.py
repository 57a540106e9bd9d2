"""Vectorised words and windows: a column of texts becomes flat numpy arrays of word hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A word is hashed by blocks of eight bytes:
each block passes a bijective finaliser before the blocks of a word are summed, so that no pattern of
letters (as the Thue-Morse words of a polynomial hash) makes sums cancel, and words of up to eight
bytes have different hashes always.  A window's hash folds the hashes of its words, mixed at each step.
Whoever must not take two texts for one compares ``check`` hashes too, which come from other constants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
_BLOCK = _U(0x9E3779B97F4A7C15)
#: Start values of the two independent hashes.
SEED, CHECK_SEED = _U(0), _U(0x3C6EF372FE94F82B)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0x9FB21C651E98DF25)
    x ^= x >> _U(29)
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _space_flags() -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[9, 10, 11, 12, 13, 32]] = True
    return flags


_SPACE = _space_flags()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first n bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


class Words:
    """All words of a column of texts, in order.

    ``row`` is the row each word belongs to, ``start``/``end`` its byte span in ``data``, ``hash`` its
    64-bit hash and ``first[r]:first[r+1]`` the words of row ``r``.  Null texts have no words.
    ``space`` flags the 256 bytes that part words.
    """

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True, space: np.ndarray = _SPACE):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        lo = int(offsets[0]) if len(offsets) else 0
        self.offsets = offsets - lo
        self.data = data[lo:lo + int(self.offsets[-1]) if len(offsets) else lo]
        self.rows = len(column)
        space = space[self.data]
        n = len(self.data)
        opens = np.ones(n, bool)
        opens[1:] = space[:-1]
        edge = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        opens[edge] = True
        opens &= ~space
        closes = np.ones(n, bool)
        closes[:-1] = space[1:]
        closes[edge[1:] - 1] = True
        closes &= ~space
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        self._lower = lower
        self.hash = self.hashes() if hashes else None

    def hashes(self, seed: np.uint64 = SEED) -> np.ndarray:
        """A 64-bit hash of every word; another ``seed`` gives an independent one."""
        text = _LOWER[self.data] if self._lower else self.data
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        block = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))
        length = self.end - self.start
        acc = mix((block[self.start] & _FIRST[np.minimum(length, 8)]) ^ seed)
        long = np.flatnonzero(length > 8)
        at = 8
        while len(long):
            part = block[self.start[long] + at] & _FIRST[np.minimum(length[long] - at, 8)]
            acc[long] += mix((part ^ seed) + _U(at * int(_BLOCK) & 0xFFFFFFFFFFFFFFFF))
            at += 8
            if at % 4096 == 0 and len(long) <= 8:
                break
            long = long[length[long] > at]
        for w in long[length[long] > at]:
            acc[w:w + 1] += self._rest(block, int(self.start[w]) + at, int(self.end[w]), at, seed)
        return mix(acc + length.astype(_U) * _STEP)

    @staticmethod
    def _rest(block: np.ndarray, lo: int, hi: int, at: int, seed: np.uint64) -> np.uint64:
        """The blocks of one very long word from its byte ``at`` on."""
        parts = block[lo:hi:8].copy()
        parts[-1] &= _FIRST[hi - lo - 8 * (len(parts) - 1)]
        return mix((parts ^ seed) + (np.arange(len(parts), dtype=_U) * _U(8) + _U(at)) * _BLOCK).sum(dtype=_U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every window of ``width`` words inside one row; ``hashes``
        are other word hashes than ``hash`` to fold."""
        words = self.hash if hashes is None else hashes
        n = len(words) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        acc = np.zeros(n, _U)
        for j in range(width):
            _fold(acc, words[j:j + n])
        at = np.flatnonzero(self.row[:n] == self.row[width - 1:])
        return at, mix(acc[at] + _U(width))

    def shingles(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every window of ``width`` words; a shorter row is one shingle by itself."""
        words = self.hash if hashes is None else hashes
        at, folded = self.windows(width, words)
        rows = self.row[at]
        counts = self.counts()
        short = np.flatnonzero((counts > 0) & (counts < width))
        if not len(short):
            return rows, folded
        acc = np.zeros(len(short), _U)
        for j in range(width - 1):
            more = counts[short] > j
            part = acc[more]
            _fold(part, words[self.first[short[more]] + j])
            acc[more] = part
        rows = np.concatenate([rows, short])
        folded = np.concatenate([folded, mix(acc + counts[short].astype(_U))])
        order = np.argsort(rows, kind="stable")
        return rows[order], folded[order]


def _fold(acc: np.ndarray, words: np.ndarray) -> None:
    acc ^= acc >> _U(29)
    acc *= _STEP
    acc += words
