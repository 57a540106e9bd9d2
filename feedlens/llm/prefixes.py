"""A prefix trie of conversations, by ternary search trees over range shards.

A turn is named by a 128-bit digest of its role and text, a conversation is the sequence of its turns.  Equal
sequences are counted first, then the distinct ones are sorted into range shards.  A shard encodes
its turns by a dictionary and inserts its sequences into a ternary search tree, the median first and then
the medians of the halves, so the tree is balanced.  An iterative traversal adds up members, leaves and
savings from the children to their parents.

Only the nodes on the first and the last path of a shard can lie in several shards.  These boundary nodes
carry a digest of their whole prefix and are merged by it, after each shard has been told how many turns
its first sequence shares with the last one before it.

A conversation of any length is cut into bands of ``BAND`` turns.  A band hangs under the digest of
everything before it, so the rows of one very long conversation spread over many shards; what lies
in later bands reaches earlier ones as two numbers per conversation and band.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, durable

#: Turns in a band, bytes of turn digests in a shard, conversation ids in one piece of a member list.
BAND, SHARD_BYTES, PIECE = 256, 4 << 20, 4096
_ROOT = bytes(16)
NOTHING = hashlib.sha256().hexdigest()


def _digest(what: Column) -> Column:
    return F.unhex(F.substring(F.sha2(what, 256), 1, 32))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation within a partition sorted by conversation and turn."""
    part = TaskContext.get().partitionId()
    last, reached = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv").to_numpy()
        starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        place = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
        if conv[0] == last:
            place[:starts[1] if len(starts) > 1 else None] += reached
        last, reached = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part), pa.int32()), b.column("conv"), pa.array(place, pa.int64()),
                                          b.column("digest"), b.column("words")], ["part", "conv", "place", "digest", "words"])


def numbered_turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(turns, runs): the turns (part, conv, place, digest, words) in range partitions of (conv, turn), and of
    each stretch (part, conv) the turns of the conversation that lie before it.  A conversation may
    stretch over any number of partitions."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where(
        "conv IS NOT NULL").select("conv", "turn", "role", _digest(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
                                   F.regexp_count("text", F.lit(WORD_RE)).cast("long").alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order)
    turns = durable(dealt.select("conv", "digest", "words").mapInArrow(_numbered, "part int, conv long, place long, digest binary, words long"))
    whole = Window.partitionBy("conv")
    runs = turns.groupBy("part", "conv").agg(F.max("place").alias("n")).withColumn("own", F.sum("n").over(whole)).withColumn(
        "before", F.sum("n").over(whole.orderBy("part")) - F.col("n"))
    return turns, durable(runs)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all earlier bands, for the bands of each conversation in order."""
    last, key = None, _ROOT
    for b in batches:
        keys = []
        for conv, seq in zip(b.column("conv").to_pylist(), b.column("seq").to_pylist()):
            if conv != last:
                last, key = conv, _ROOT
            keys.append(key)
            key = hashlib.sha256(key + seq).digest()[:16]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("band"), pa.array(keys, pa.binary())], ["conv", "band", "key"])


def bands(turns: DataFrame, totals: DataFrame, long: bool) -> DataFrame:
    """(conv, band, key, seq, words, last) of every conversation; one without turns has one empty band.

    ``turns`` (conv, depth, digest, words), ``totals`` (conv, total); ``long`` says that some have several bands.
    """
    each = F.sort_array(F.collect_list(F.struct("depth", "digest", "words")))
    cut = turns.groupBy("conv", F.expr(f"(depth - 1) div {BAND}").cast("int").alias("band")).agg(each.alias("t")).select(
        "conv", "band", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("seq"),
        F.transform("t", lambda x: x["words"]).alias("words"))
    none = totals.where("total = 0").select("conv", F.lit(0).alias("band"), F.lit(b"").alias("seq"), F.array().cast("array<long>").alias("words"))
    if not long:
        return durable(cut.unionByName(none).withColumn("key", F.lit(_ROOT)).withColumn("last", F.lit(True)))
    cut = durable(cut.unionByName(none))
    ends = F.expr(f"greatest(total - 1, 0) div {BAND}").cast("int")
    cut = cut.join(totals.select("conv", ends.alias("end")), "conv")
    keys = cut.where("end > 0").select("conv", "band", "seq").repartition("conv").sortWithinPartitions("conv", "band").mapInArrow(
        _chained, "conv long, band int, key binary")
    several = cut.where("end > 0").join(keys, ["conv", "band"])
    one = cut.where("end = 0").withColumn("key", F.lit(_ROOT))
    return durable(one.unionByName(several).withColumn("last", F.col("band") == F.col("end")).drop("end"))


class TernaryTree:
    """A ternary search tree in parallel lists; a node is one turn of a prefix.

    ``lo``/``hi`` lead to other turns after the same prefix, ``eq`` to the turns that follow.
    """

    def __init__(self):
        self.turn, self.lo, self.eq, self.hi = [], [], [], []
        self.up, self.depth, self.words, self.members, self.least = [], [], [], [], []
        self.top = -1

    def _new(self, turn: int, parent: int, depth: int, words: int) -> int:
        for column, value in ((self.turn, turn), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.up, parent),
                              (self.depth, depth), (self.words, words), (self.members, 0), (self.least, None)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], words: list[int], members: int, least: int) -> list[int]:
        """Add a sequence; its path is returned."""
        parent, path = -1, []
        for depth, turn in enumerate(turns):
            at = self.eq[parent] if parent >= 0 else self.top
            before = -1
            while at >= 0 and self.turn[at] != turn:
                before = at
                at = self.lo[at] if turn < self.turn[at] else self.hi[at]
            if at < 0:
                at = self._new(turn, parent, depth, words[depth])
                if before >= 0:
                    (self.lo if turn < self.turn[before] else self.hi)[before] = at
                elif parent >= 0:
                    self.eq[parent] = at
                else:
                    self.top = at
            self.members[at] += members
            if self.least[at] is None or least < self.least[at]:
                self.least[at] = least
            path.append(at)
            parent = at
        return path

    def walk(self) -> list[int]:
        """All nodes, a parent before its children and siblings in order."""
        order, stack, at = [], [], self.top
        while at >= 0 or stack:
            if at >= 0:
                stack.append((at, True))
                at = self.lo[at]
                continue
            at, fresh = stack.pop()
            if fresh:
                order.append(at)
                stack.append((at, False))
                at = self.eq[at]
            else:
                at = self.hi[at]
        return order


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle first, then the middles of the halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += [(m + 1, b), (a, m)]


_NODES = pa.schema([("shard", pa.int32()), ("band", pa.int32()), ("d", pa.int32()), ("conv", pa.int64()), ("n", pa.int64()), ("children", pa.int64()),
                    ("leaves", pa.int64()), ("saved", pa.int64()), ("node", pa.binary()), ("parent", pa.int64()), ("parent_node", pa.binary()),
                    ("boundary", pa.bool_()), ("on_first", pa.bool_()), ("on_last", pa.bool_()), ("path_words", pa.int64()),
                    ("first", pa.binary()), ("final", pa.binary())])
_NODES_SQL = ("shard int, band int, d int, conv long, n long, children long, leaves long, saved long, node binary, parent long, parent_node binary, "
              "boundary boolean, on_first boolean, on_last boolean, path_words long, first binary, final binary")


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, and one row with its first and last sequence.

    The numbers of boundary nodes suppose that no other shard has them; ``merged`` corrects that.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    shard = TaskContext.get().partitionId()
    column = {c: t.column(c).to_pylist() for c in t.column_names}
    tops = [band.to_bytes(4, "big") + key for band, key in zip(column["band"], column["key"])]
    turns = [[s[i:i + 16] for i in range(0, len(s), 16)] for s in column["seq"]]
    codes = {d: i for i, d in enumerate(sorted({d for s in turns for d in s}))}
    top_codes = {d: i for i, d in enumerate(sorted(set(tops)))}
    tree = TernaryTree()
    n_nodes = 0
    leaves, saved, ends, goes_on, source = [], [], [], [], []
    paths: dict[int, list[int]] = {}
    for i in medians(t.num_rows):
        path = tree.insert([top_codes[tops[i]], *(codes[d] for d in turns[i])], [0, *column["words"][i]], column["n"][i], column["least"][i])
        for a in range(n_nodes, len(tree.turn)):
            leaves.append(0), saved.append(0), ends.append(0), goes_on.append(0), source.append(i)
        n_nodes = len(tree.turn)
        last = path[-1]
        ends[last] += column["n_ends"][i]
        goes_on[last] += column["n"][i] - column["n_ends"][i]
        leaves[last] += column["more_leaves"][i]
        saved[last] += column["more_saved"][i]
        if i in (0, t.num_rows - 1):
            paths[i] = path
    children = [0] * n_nodes
    order = tree.walk()
    for a in reversed(order):
        if not children[a] and not goes_on[a]:
            leaves[a] += 1
        saved[a] += (tree.members[a] - 1) * tree.words[a]
        p = tree.up[a]
        if p >= 0:
            children[p] += 1
            leaves[p] += leaves[a]
            saved[p] += saved[a]
    first, final = set(paths[0]), set(paths[t.num_rows - 1])
    path_words, total = {}, 0
    for a in paths[0]:
        total += tree.words[a]
        path_words[a] = total
    boundary = [a in first or a in final or tree.depth[a] == 0 or goes_on[a] > 0 for a in range(n_nodes)]

    def name(a: int) -> bytes:
        i, d = source[a], tree.depth[a]
        key = column["key"][i]
        return hashlib.sha256(key + column["seq"][i][:16 * d]).digest()[:16] if d else key

    names = {a: name(a) for a in range(n_nodes) if boundary[a] or ends[a]}
    up = tree.up
    out = {
        "shard": [shard] * n_nodes, "band": [column["band"][source[a]] for a in order], "d": [tree.depth[a] for a in order],
        "conv": [tree.least[a] for a in order], "n": [tree.members[a] for a in order], "children": [children[a] for a in order],
        "leaves": [leaves[a] for a in order], "saved": [saved[a] for a in order], "node": [names.get(a) for a in order],
        "parent": [tree.least[up[a]] if up[a] >= 0 and not boundary[up[a]] else None for a in order],
        "parent_node": [names[up[a]] if up[a] >= 0 and boundary[up[a]] else None for a in order],
        "boundary": [boundary[a] for a in order], "on_first": [a in first for a in order], "on_last": [a in final for a in order],
        "path_words": [path_words.get(a) for a in order], "first": [None] * n_nodes, "final": [None] * n_nodes}
    yield pa.RecordBatch.from_pydict(out, _NODES)
    edge = dict.fromkeys(_NODES.names) | {"shard": shard, "first": tops[0] + column["seq"][0], "final": tops[-1] + column["seq"][-1]}
    yield pa.RecordBatch.from_pylist([edge], _NODES)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many turns a shard's first sequence shares with the last one before it (-1: under another
    digest), and whether it continues that one."""
    for b in batches:
        shared, goes_on = [], []
        for x, y in zip(b.column("final").to_pylist(), b.column("first").to_pylist()):
            if x[:20] != y[:20]:
                shared.append(-1)
                goes_on.append(False)
                continue
            k, most = 0, min(len(x), len(y)) - 20
            while k < most and x[20 + k:36 + k] == y[20 + k:36 + k]:
                k += 16
            shared.append(k // 16)
            goes_on.append(k == len(x) - 20)
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("before"), pa.array(shared, pa.int32()), pa.array(goes_on, pa.bool_())],
                                         ["shard", "before", "shared", "goes_on"])


def shard_nodes(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of all shards, boundary nodes with corrected numbers) of distinct bands (band, key, seq, words,
    least, n, n_ends, more_leaves, more_saved)."""
    total = groups.agg(F.sum(F.octet_length("seq") + 64)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES), min(32, math.ceil(total / (64 << 10))))
    nodes = durable(groups.repartitionByRange(shards, "band", "key", "seq").sortWithinPartitions("band", "key", "seq").mapInArrow(_shard, _NODES_SQL))
    edges = nodes.where("first IS NOT NULL").select("shard", "first", "final")
    # One narrow row per shard.
    after = edges.select("shard").withColumn("before", F.lag("shard").over(Window.orderBy("shard"))).where("before IS NOT NULL")
    met = after.join(edges.select(F.col("shard").alias("before"), "final"), "before").join(edges.select("shard", "first"), "shard").select(
        "shard", "before", "final", "first").mapInArrow(_meeting, "shard int, before int, shared int, goes_on boolean")
    met = durable(met)
    partial = nodes.where("boundary").drop("first", "final")
    at = partial.where("on_first").select("shard", F.col("d").alias("shared"), F.col("path_words").alias("shared_words"))
    shared = met.join(at, ["shard", "shared"], "left").select("shard", "shared", F.coalesce("shared_words", F.lit(0)).alias("shared_words"))
    longer = met.where("goes_on").select(F.col("before").alias("shard"), F.lit(1).alias("longer"))
    fixed = partial.join(shared, "shard", "left").join(longer, "shard", "left")
    # A node that the shard before has too is counted there: its words, and the node as a child.
    own = F.col("on_first") & (F.col("d") <= F.coalesce("shared", F.lit(-1)))
    word = F.when(F.col("on_first"), F.col("path_words"))
    path = nodes.where("boundary AND on_first").select("shard", (F.col("d") + 1).alias("d"), F.col("path_words").alias("words_above"))
    fixed = fixed.join(path, ["shard", "d"], "left")
    fixed = fixed.select(
        "shard", "band", "d", "conv", "n", "node", "parent", "parent_node",
        (F.col("children") - F.when(own & (F.col("d") < F.col("shared")), 1).otherwise(0)).alias("children"),
        (F.col("leaves") - F.when(F.col("on_last") & F.col("longer").isNotNull(), 1).otherwise(0)).alias("leaves"),
        (F.col("saved") + F.when(own & word.isNotNull(), F.col("shared_words") - F.coalesce("words_above", F.lit(0))).otherwise(0)).alias("saved"))
    return nodes, fixed


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("band", "key", "seq").agg(
        F.first("words").alias("words"), F.min("conv").alias("least"), F.count("*").alias("n"), F.count_if("last").alias("n_ends"),
        F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))


def _with_later_bands(rows: DataFrame) -> DataFrame:
    """Add to each band what the conversation owns in later ones: ``more_leaves`` and ``more_saved``.

    The part of the trie in a band that hangs under one digest is owned by its smallest conversation.
    """
    later = rows.where("band > 0")
    _, fixed = shard_nodes(_distinct(later.withColumn("more_leaves", F.lit(0).cast("long")).withColumn("more_saved", F.lit(0).cast("long"))))
    held = fixed.where("d = 0").groupBy("band", F.col("node").alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    owned = later.groupBy("band", "key").agg(F.min("conv").alias("conv")).join(held, ["band", "key"]).select("conv", "band", "leaves", "saved")
    down = Window.partitionBy("conv").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    many = later.select("conv").distinct()
    long = rows.join(many, "conv", "left_semi").join(owned, ["conv", "band"], "left")
    long = long.withColumn("more_leaves", F.coalesce(F.sum("leaves").over(down), F.lit(0)).cast("long")).withColumn(
        "more_saved", F.coalesce(F.sum("saved").over(down), F.lit(0)).cast("long")).drop("leaves", "saved")
    short = rows.join(many, "conv", "left_anti").withColumn("more_leaves", F.lit(0).cast("long")).withColumn("more_saved", F.lit(0).cast("long"))
    return durable(short.unionByName(long))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of up to ``PIECE`` members of one node at a time, from rows sorted by (node, conv)."""
    for b in batches:
        nodes, convs = b.column("node").to_pylist(), b.column("conv").to_pylist()
        out, start = [], 0
        for i in range(1, len(nodes) + 1):
            if i == len(nodes) or nodes[i] != nodes[start] or i - start == PIECE:
                out.append({"node": nodes[start], "conv": convs[start], "ids": ",".join(map(str, convs[start:i]))})
                start = i
        yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.binary()), ("conv", pa.int64()), ("ids", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    kind = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for b in batches:
        out = []
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
            if n != node:
                if state is not None:
                    out.append({"node": node, "ends_sha256": state.hexdigest()})
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist(out, kind)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}], kind)


def member_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ascending, comma-joined conversations of each node.

    Ids are joined in ranges of (node, conv); only the digest itself, which cannot be split, passes over
    the pieces of a node in one task, with constant memory.
    """
    pieces = rows.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_pieces, "node binary, conv long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "conv").mapInArrow(_hashed, "node binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of
    the prefix trie of conversations, given as turns (conv, depth from 1, digest, words) and totals (conv, total).
    """
    longest = totals.agg(F.max("total")).first()[0]
    long = longest is not None and longest > BAND
    rows = bands(turns, totals, long)
    if long:
        rows = _with_later_bands(rows)
    else:
        rows = rows.withColumn("more_leaves", F.lit(0).cast("long")).withColumn("more_saved", F.lit(0).cast("long"))
    nodes, partial = shard_nodes(_distinct(rows))
    # The top of a later band is the node at the end of the band before, which has all its numbers but the children.
    counted = ~((F.col("band") > 0) & (F.col("d") == 0))
    depth = (F.col("band") * BAND + F.col("d")).cast("long")
    merged = durable(partial.groupBy("node").agg(
        F.max(depth).alias("depth"), F.min("conv").alias("conv"), F.sum(F.when(counted, F.col("n")).otherwise(0)).alias("n"),
        F.sum("children").alias("children"), F.sum(F.when(counted, F.col("leaves")).otherwise(0)).alias("leaves"),
        F.sum(F.when(counted, F.col("saved")).otherwise(0)).alias("saved"), F.max("parent_node").alias("parent_node"),
        F.min("parent").alias("inner_parent")))
    known = merged.select(F.col("node").alias("parent_node"), F.col("conv").alias("parent"))
    numbers = ["conv", "depth", "parent", "n", "children", "leaves", "saved", "node"]
    spread = merged.join(known, "parent_node", "left").withColumn("parent", F.coalesce("parent", "inner_parent")).select(*numbers)
    inner = nodes.where("NOT boundary").withColumn("depth", depth)
    below = partial.select("shard", F.col("node").alias("parent_node")).distinct().join(known, "parent_node")
    under = inner.where("parent_node IS NOT NULL").drop("parent").join(below, ["shard", "parent_node"]).select(*numbers)
    every = spread.unionByName(under).unionByName(inner.where("parent_node IS NULL").select(*numbers))
    end = F.when(F.octet_length("seq") == 0, F.col("key")).otherwise(_digest(F.concat("key", "seq")))
    ends = member_digests(rows.where("last").select(end.alias("node"), "conv"))
    named = every.where("node IS NOT NULL").join(ends, "node", "left").drop("node")
    plain = every.where("node IS NULL").drop("node").withColumn("ends_sha256", F.lit(None).cast("string"))
    return named.unionByName(plain).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def rebuilt_conversations(df: DataFrame, group: int = 20, most: int = 4, id_col: str = "conv_id", turn_col: str = "turn",
                          role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns and totals of conversations that begin like the first of their group.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % group`` (all if it has fewer, none if it is
    absent), then its own turns after its first ``h``; ``h`` is crc32 of the decimal id modulo ``most``.
    ``most`` 1 leaves every conversation as it is.
    """
    turns, runs = numbered_turns(df, id_col, turn_col, role_col, text_col)
    convs = runs.where("before = 0").select("conv", "own")
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    first_of = F.col("conv") - F.col("conv") % group
    info = convs.withColumn("h", heads).withColumn("base", first_of).join(
        convs.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_own")), "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_own", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    info = durable(info.select("conv", "base", "h", "taken", "total"))
    stretch = runs.select("part", "conv", "before").join(info.select("conv", "h", "taken"), "conv")
    own = turns.join(stretch, ["part", "conv"]).withColumn("place", F.col("place") + F.col("before")).where("place > h").select(
        "conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words")
    opening = turns.where((F.col("conv") % group == 0) & (F.col("place") < most)).join(
        runs.where(F.col("before") < most).select("part", "conv", "before"), ["part", "conv"]).select(
        F.col("conv").alias("base"), (F.col("place") + F.col("before")).alias("depth"), "digest", "words")
    head = info.where("taken > 0").select("conv", "base", "taken").join(opening, "base").where("depth <= taken").select("conv", "depth", "digest", "words")
    return own.unionByName(head), info.select("conv", "total")


def prefix_trie(df: DataFrame, group: int = 20, most: int = 4, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per trie node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversations are ordered by turn (null first; ties by role, then by the digest of the turn, so that repeated
    rows are interchangeable) and rebuilt as ``rebuilt_conversations`` says.  A node is a distinct sequence
    of the first ``depth`` (role, text) pairs, null counting as empty; ``conv_id`` is its smallest member, the
    root has depth 0 and no parent.  ``n_leaves`` counts the childless nodes of the subtree, ``saved_tokens``
    adds (members - 1) times the words of the last text over it, and ``ends_sha256`` is the digest of the
    conversations that end at the node.  Rows with a null conversation id take no part; ids are integers; other
    columns are not read; an empty table has no nodes.
    """
    return conversation_trie(*rebuilt_conversations(df, group, most, id_col, turn_col, role_col, text_col))
