"""Chat formatting by columnar byte assembly, and its exact inverse.

A turn becomes ``### role: text</turn>`` and a line feed.  Inside texts a backslash goes before every
backslash, ``#`` and ``<`` (inside roles also before ``:``), so no control string of the template can
appear in them and the escape is undone without loss.  A batch is built in one pass: segment lengths give
cumulative offsets, the bytes of headers, texts and ends are scattered into one preallocated buffer, and
that buffer becomes the Arrow column.  The loss mask marks the escaped texts of the assistant.

Rows are sorted by conversation and turn within a partition and stream through in batches, so a
conversation of any length needs no more memory than a batch; it comes out as consecutive parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_bytes

HEAD, SEPARATOR, END = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = "assistant"
_BACKSLASH = 92
_IN_TEXT, _IN_ROLE = np.zeros(256, bool), np.zeros(256, bool)
_IN_TEXT[[_BACKSLASH, ord("#"), ord("<")]] = True
_IN_ROLE[[_BACKSLASH, ord("#"), ord("<"), ord(":")]] = True
#: Text in one part of a conversation, about.
PART_BYTES = 4 << 20


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class _Segment:
    """A string column to be laid out with its escapes."""

    def __init__(self, column: pa.Array, special: np.ndarray):
        self.data, self.offsets = _flat(column)
        self.mark = special[self.data]
        self.before = np.concatenate([[0], np.cumsum(self.mark)])     # escapes before each byte
        self.lengths = np.diff(self.offsets) + np.diff(self.before[self.offsets])

    def scatter(self, out: np.ndarray, at: np.ndarray) -> None:
        """Write row ``r`` from ``out[at[r]]`` on."""
        shift = at - self.offsets[:-1] - self.before[self.offsets[:-1]]
        to = np.arange(len(self.data)) + np.repeat(shift, np.diff(self.offsets)) + self.before[1:]
        out[to] = self.data
        out[to[self.mark] - 1] = _BACKSLASH


def _constant(out: np.ndarray, at: np.ndarray, what: bytes) -> None:
    for k, byte in enumerate(what):
        out[at + k] = byte


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, turn offsets, text starts, text ends) of formatted turns."""
    roles, texts = _Segment(role, _IN_ROLE), _Segment(text, _IN_TEXT)
    lengths = len(HEAD) + roles.lengths + len(SEPARATOR) + texts.lengths + len(END)
    turns = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(turns[-1]), np.uint8)
    at = turns[:-1]
    _constant(out, at, HEAD)
    at = at + len(HEAD)
    roles.scatter(out, at)
    at = at + roles.lengths
    _constant(out, at, SEPARATOR)
    start = at + len(SEPARATOR)
    texts.scatter(out, start)
    end = start + texts.lengths
    _constant(out, end, END)
    return out, turns, start, end


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for b in chunks_by_bytes(batches, "text", PART_BYTES):
        ids = b.column("id").to_pylist()
        first = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
        bounds = np.array([*first, len(ids)], np.int64)
        data, turns, start, end = assemble(b.column("role"), b.column("text"))
        part = part + 1 if ids[0] == last else 0
        parts = [part] + [0] * (len(first) - 1)
        last, part = ids[-1], parts[-1]
        base = np.repeat(turns[bounds[:-1]], np.diff(bounds))
        loss = pc.fill_null(pc.equal(b.column("role"), LOSS_ROLE), False).to_numpy(zero_copy_only=False)
        inside = np.concatenate([[0], np.cumsum(loss)])[bounds]
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(pa.array(first, pa.int64())), pa.array(parts, pa.int32()), pa.array(np.diff(bounds), pa.int64()),
             _strings(data, turns[bounds]), _lists((start - base)[loss], inside), _lists((end - base)[loss], inside)],
            ["id", "part", "n_turns", "formatted", "loss_start", "loss_end"])


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """Consecutive parts of every conversation: (id, part, n_turns, formatted, loss_start, loss_end).

    ``loss_start``/``loss_end`` are byte offsets in ``formatted``.  Turns come in the order of turn, role and
    text, so ties are settled by content and repeated rows are turns of their own; a null turn comes
    first, a null role or text is empty, and rows without a conversation id form one conversation.
    Parts of one conversation are next to each other, in order, in one partition.  Other columns are
    not read.
    """
    rows = df.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = df.schema[conv_col].dataType.simpleString()
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    out = ordered.mapInArrow(_format, f"id {kind}, part int, n_turns long, formatted string, loss_start array<int>, loss_end array<int>")
    return out.withColumnRenamed("id", conv_col)


def _escapes(data: np.ndarray) -> np.ndarray:
    """Which backslashes are escapes: every second one of a run, from its first."""
    slash = data == _BACKSLASH
    at = np.arange(len(data))
    starts = slash.copy()
    starts[1:] &= ~slash[:-1]
    run = np.maximum.accumulate(np.where(starts, at, -1)) if len(data) else at
    return slash & ((at - run) % 2 == 0)


def parse(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(escape flags, turn starts, role ends, text starts, text ends) of formatted turns."""
    escape = _escapes(data)
    bare = np.ones(len(data), bool)
    bare[1:] = ~escape[:-1]
    text_end = np.flatnonzero((data == ord("<")) & bare)
    begin = np.concatenate([[0], text_end[:-1] + len(END)]).astype(np.int64)[:len(text_end)]
    colon = np.flatnonzero((data == ord(":")) & bare)
    role_end = colon[np.searchsorted(colon, begin)] if len(begin) else begin
    return escape, begin, role_end, role_end + len(SEPARATOR), text_end


def _code_points(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


class _Digest:
    def __init__(self, conv):
        self.conv = conv
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, data: np.ndarray, loss: list[tuple[int, int]]) -> None:
        escape, begin, role_end, text_start, text_end = parse(data)
        keep = ~escape
        out = data.copy()
        for k in range(len(HEAD)):
            keep[begin + k] = False
        out[role_end] = 10                                  # role, line feed, text, line feed
        keep[role_end + 1] = False
        for k in range(len(END) - 1):
            keep[text_end + k] = False
        self.turns.update(out[keep].tobytes())
        self.n_turns += len(begin)
        self.formatted_chars += _code_points(data)
        for a, b in loss:
            text = data[a:b][~escape[a:b]]
            self.loss.update(text.tobytes())
            self.loss_chars += _code_points(text)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_DIGEST = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: _Digest | None = None
    schema = None
    for b in batches:
        schema = pa.schema([("id", b.schema.field("id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        done = []
        data, offsets = _flat(b.column("formatted"))
        for k, (conv, part, start, end) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "part", "loss_start", "loss_end")))):
            if part == 0:
                if state:
                    done.append(state.row())
                state = _Digest(conv)
            state.add(data[offsets[k]:offsets[k + 1]], list(zip(start, end)))
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST, r)) for r in done], schema)
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST, state.row()))], schema)


def conversation_digests(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What reading the formatted conversations back yields, one row per conversation: (id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars).  ``parts`` comes from ``format_conversations``."""
    kind = parts.schema[conv_col].dataType.simpleString()
    out = parts.withColumnRenamed(conv_col, "id").mapInArrow(
        _read_back, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", conv_col)
