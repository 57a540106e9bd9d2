"""Offset-preserving subword encoding and decoding with a sentencepiece model.

A text is normalised by longest-prefix matches in the model's compiled character map; every output
character remembers the source byte it ends at.  The normalised text splits into chunks (white-space
marks followed by other characters) which no piece of the vocabulary crosses, so each distinct chunk is segmented
once and a text's ids are gathered from its chunks in numpy.  Piece ends are projected back through
the alignment: piece ``i`` covers the source bytes ``ends[i-1]:ends[i]``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_bytes

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct chunks one task remembers; beyond that it starts afresh.
CACHE_CHUNKS = 1 << 16
#: Segments longer than this are not remembered beyond their slice.
CACHE_BYTES = 1 << 23


class CharMap:
    """The compiled character map of a model: a double-array trie over UTF-8 and the replacements."""

    def __init__(self, blob: bytes):
        self.by_first: dict[str, list[tuple[str, str]]] = {}
        self.first = None
        if not blob:
            return
        size = struct.unpack_from("<I", blob)[0]
        units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        texts = blob[4 + size:]
        found: list[tuple[bytes, int]] = []
        todo = [(0, b"")]
        while todo:
            node, key = todo.pop()
            unit = units[node]
            base = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
            if key and unit & 0x100 and base < len(units):
                found.append((key, units[base] & 0x7FFFFFFF))
            for byte in range(1, 256):
                child = base ^ byte
                if child < len(units) and units[child] & 0x800000FF == byte:
                    todo.append((child, key + bytes([byte])))
        for key, at in found:
            try:
                source = key.decode()
            except UnicodeDecodeError:
                continue
            self.by_first.setdefault(source[0], []).append((source, texts[at:texts.index(b"\0", at)].decode()))
        for rules in self.by_first.values():
            rules.sort(key=lambda r: -len(r[0]))
        if self.by_first:
            self.first = re.compile("[" + re.escape("".join(self.by_first)) + "]")

    def apply(self, text: str) -> list[tuple[str, str]]:
        """(source, replacement) segments of the text; the longest matching prefix wins."""
        if self.first is None:
            return [(text, text)] if text else []
        out, at, copied = [], 0, 0
        while m := self.first.search(text, at):
            i = m.start()
            rule = next((r for r in self.by_first[text[i]] if text.startswith(r[0], i)), None)
            if rule is None:
                at = i + 1
                continue
            if copied < i:
                out.append((text[copied:i], text[copied:i]))
            out.append(rule)
            at = copied = i + len(rule[0])
        if copied < len(text):
            out.append((text[copied:], text[copied:]))
        return out


class Normalizer:
    def __init__(self, charsmap: bytes, dummy_prefix: bool, strip_spaces: bool, escape_spaces: bool):
        self.map = CharMap(charsmap)
        self.dummy_prefix, self.strip_spaces, self.escape_spaces = dummy_prefix, strip_spaces, escape_spaces
        #: Without rules, normalising only marks the spaces.
        self.plain = self.map.first is None and dummy_prefix and escape_spaces and not strip_spaces

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its character boundaries, the source byte offset."""
        chars: list[str] = []
        ends = [0]
        at = 0
        for source, target in self.map.apply(text):
            if source == target:
                for c in source:
                    at += len(c.encode())
                    chars.append(c)
                    ends.append(at)
            else:
                at += len(source.encode())
                if target:
                    chars += target
                    ends += [ends[-1]] * (len(target) - 1) + [at]
                else:
                    ends[-1] = at
        if self.strip_spaces:
            chars, ends = _strip(chars, ends)
        if not chars:
            return "", np.array(ends[-1:], np.int64)
        space = MARK if self.escape_spaces else " "
        if self.dummy_prefix:
            chars, ends = [" ", *chars], [ends[0], *ends]
        return "".join(space if c == " " else c for c in chars), np.array(ends, np.int64)


def _strip(chars: list[str], ends: list[int]) -> tuple[list[str], list[int]]:
    """Without leading, trailing and repeated spaces; what is left keeps its source offsets."""
    kept, out, start = [], [], None
    for i, c in enumerate(chars):
        if c == " " and (not kept or kept[-1] == " "):
            if kept:
                out[-1] = ends[i + 1]
            continue
        if start is None:
            start = ends[i]
        kept.append(c)
        out.append(ends[i + 1])
    if kept and kept[-1] == " ":
        kept.pop()
        out.pop()
    return kept, [start if start is not None else ends[-1], *out]


class Codec:
    """Encoder and decoder of one model; built in each task from the model's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.lib = spm.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        kinds = np.array([p.type for p in proto.pieces])
        self.is_byte, self.is_unknown = kinds == 6, kinds == 2
        #: Chunks can be segmented alone if no piece has a white-space mark after another character.
        mark = self.lib.piece_to_id(MARK)
        self.mark_ids = [mark]
        self.splits = self.normalize.plain and kinds[mark] == 1 and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces if p.type != 3)
        surface = [bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else b"" if p.type == 3 else proto.trainer_spec.unk_surface.encode() if p.type == 2
                   else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.chars = np.array([0 if p.type == 6 else len(p.piece) for p in proto.pieces])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.ends, self.at = np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Segment chunks (given without their first mark, which the library puts in front again)."""
        ids = [i if w else self.mark_ids for w, i in zip(words, self.lib.encode(words, num_threads=1))]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        at = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.where(self.is_byte[flat], 0, np.diff(self.surface_at)[flat])
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = total[1:] - np.repeat(total[at[:-1]], sizes)
        odd = np.unique(np.searchsorted(at, np.flatnonzero(self.is_byte[flat] | self.is_unknown[flat]), side="right") - 1)
        for k in odd:
            ends[at[k]:at[k + 1]] = self._walk(flat[at[k]:at[k + 1]], MARK + words[k], lambda c: 1 if c == MARK else len(c.encode()))
        self.index.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words))))
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, ends.astype(np.int32)])

    def _walk(self, ids: np.ndarray, text: str, width) -> list[int]:
        """Ends of pieces one by one: of a character spelt in bytes, the last byte covers it all."""
        out, c, at, left = [], 0, 0, 0
        for n, i in enumerate(ids):
            if self.is_byte[i]:
                if not left:
                    left = len(text[c].encode())
                left -= 1
                take = 0 if left else 1
            elif self.is_unknown[i]:
                take = len(text) - c - int(sum(self.chars[j] for j in ids[n + 1:])) if not self.is_byte[ids[n + 1:]].any() else 1
            else:
                take = int(self.chars[i])
            at += sum(width(x) for x in text[c:c + take])
            c += take
            out.append(at)
        return out

    def _slow(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of a text whose alignment is not one byte for each mark."""
        norm, align = self.normalize(text)
        ids = np.array(self.lib.encode(text), np.int32)
        chars = self._walk(ids, norm, lambda c: 1)
        return ids, align[np.array(chars, np.int64)].astype(np.int32) if len(ids) else np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, ends) of the texts, flat."""
        if len(self.index) > CACHE_CHUNKS or self.ids.nbytes > CACHE_BYTES:
            self._forget()
        chunks: list[list[str]] = []
        alone: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, text in enumerate(texts):
            if not text:
                chunks.append([])
            elif not self.splits or MARK in text:
                alone[k] = self._slow(text)
                chunks.append([])
            elif "  " in text or text[0] == " " or text[-1] == " ":
                chunks.append([c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))])
            else:
                chunks.append(text.split(" "))
        words = [w for c in chunks for w in c]
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.at[which + 1] - self.at[which]
        first = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(first[-1]) + np.repeat(self.at[which] - first[:-1], sizes)
        widths = self.ends[self.at[which + 1] - 1].astype(np.int64)
        of_text = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        begins = np.concatenate([[0], np.cumsum(widths)])
        begins = begins[:-1] - np.repeat(begins[of_text[:-1]] + 1, np.diff(of_text))
        ids, ends = self.ids[take], (self.ends[take] + np.repeat(begins, sizes)).astype(np.int32)
        offsets = first[of_text]
        if alone:
            parts = [alone.get(k) or (ids[offsets[k]:offsets[k + 1]], ends[offsets[k]:offsets[k + 1]]) for k in range(len(texts))]
            offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
            ids, ends = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        return offsets, ids, ends

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each id list: surfaces laid end to end, without the space put before the first."""
        if not len(ids):
            return [""] * (len(offsets) - 1)
        sizes = np.diff(self.surface_at)[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.surface[np.arange(at[-1]) + np.repeat(self.surface_at[ids] - at[:-1], sizes)].tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            piece = raw[at[a]:at[b]]
            try:
                if not self.splits or self.is_unknown[ids[a:b]].any():
                    raise UnicodeDecodeError("utf-8", b"", 0, 0, "left to the library")
                out.append((piece[1:] if piece[:1] == b" " else piece).decode())
            except UnicodeDecodeError:
                out.append(self.lib.decode([int(i) for i in ids[a:b]]))
        return out


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, ends, decoded) of every row: the piece ids of the whole text, the source byte each
    piece ends at, and the text that the ids decode to.

    A null or empty text has no ids and decodes to the empty text.  Repeated rows are encoded each;
    other columns are not read.  The model file is read once, on the driver.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in chunks_by_bytes(batches, "text", 1 << 19):
            codec = codec or Codec(model)
            texts = [t or "" for t in b.column("text").to_pylist()]
            offsets, ids, ends = codec.encode(texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(offsets, ids), _lists(offsets, ends), pa.array(codec.decode(offsets, ids), pa.string())],
                                             ["id", "ids", "ends", "decoded"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, ids array<int>, ends array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def piece_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest columns of ``encode``: (id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes);
    ``spanned_bytes`` is the source byte at which the last piece ends (0 without pieces)."""
    enc = encode(df, model_path, id_col, text_col)
    return enc.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"),
                      F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("spanned_bytes"))
