"""Near-duplicate documents by a chosen-path similarity join over word-shingle sets.

Every distinct set gets a MinHash signature.  In each of several independent trees a set starts at the
root and walks to the children named by (position, value) of a few signature positions that the
node's own randomness selects; similar sets keep meeting because they share minwise tokens.  Nodes with
one set die, small nodes are compared exhaustively, and larger ones branch again.  A pair of
similarity ``s`` survives one level with probability ``1 - (1 - s f)**choices`` if it
survives the levels below with probability ``f``, which fixes how many trees reach the target recall.
A node still large at the last level is dealt into blocks and every pair of blocks is compared, so no
size is given up.

Comparing is two steps: signatures name, per node, the sets with a possible partner, then those sets
travel to the node whole and links are confirmed on them.  Links inside an already connected part of
a node are redundant and skipped, so a group of n near copies costs n links, not n squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_bytes, durable, fresh_name
from .components import components
from .words import CHECK_SEED, Words, mix

#: Positions of a signature.
SIGNATURE = 128
#: Sets compared at once, and bytes of whole sets brought together for it.
NODE_SETS, NODE_BYTES = 1024, 32 << 20
#: Children of a set at each node, and levels before a large node is dealt into blocks.
CHOICES, LEVELS = 2, 3
#: A signature estimate so many standard deviations below the threshold is still confirmed.
SLACK = 3.5
_U = np.uint64
_MULTIPLIERS = mix(np.arange(1, SIGNATURE + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def survival(similarity: float, levels: int = LEVELS, choices: int = CHOICES) -> float:
    """Probability that a pair meets in a leaf of one tree of full depth."""
    f = 1.0
    for _ in range(levels):
        f = 1 - (1 - similarity * f) ** choices
    return f


def trees_for(recall: float, similarity: float) -> int:
    """Independent trees that bring a pair together with probability ``recall`` at least."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity))))


def distinct_shingles(words: Words, width: int, check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(bounds per row, ascending distinct shingle hashes, with ``check`` their independent second hashes) of every row."""
    rows, hashes = words.shingles(width)
    second = words.shingles(width, words.hashes(CHECK_SEED))[1] if check else None
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    return np.searchsorted(rows, np.arange(words.rows + 1)), hashes, second[order][new] if check else None


def signatures(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """MinHash signatures (rows x SIGNATURE, 32 bits each) of non-empty sets laid end to end."""
    out = np.empty((len(first) - 1, SIGNATURE), np.uint32)
    for k, m in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(((hashes * m) >> _U(32)).astype(np.uint32), first[:-1])
    return out


def _sets(width: int):
    """id, size, key and signature of every document with a word.

    The key is a 128-bit digest of the set, half of it from each of two independent shingle hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_by_bytes(batches, "text", 1 << 20):
            words = Words(b.column("text"), lower=True)
            first, hashes, second = distinct_shingles(words, width, check=True)
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            keys, sigs = _digests(first, hashes, second), [None] * words.rows
            if len(some):
                sig = signatures(np.append(first[some], len(hashes)), hashes)
                for k, r in enumerate(some):
                    sigs[r] = sig[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(sigs, pa.binary())], ["id", "mark", "size", "key", "sig"])
    return run


def _branch(choices: int):
    """Children of (id, node, sig): the node's hash picks ``choices`` positions for all its sets alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, SIGNATURE)
            node = b.column("node").to_numpy().astype(np.int64).view(_U)
            seed = mix(node ^ _U(0x2545F4914F6CDD1D))
            first = (seed % _U(SIGNATURE)).astype(np.int64)
            # An odd step in a power-of-two ring: the positions of one node are distinct.
            step = ((seed >> _U(32)) % _U(SIGNATURE // 2)).astype(np.int64) * 2 + 1
            children = []
            for c in range(choices):
                at = (first + c * step) % SIGNATURE
                children.append(mix(mix(node + _U(c + 1)) ^ (sig[np.arange(len(at)), at].astype(_U) + (at.astype(_U) << _U(32)))))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(b.column("id").to_numpy(), choices), pa.int64()),
                                              pa.array(np.concatenate(children).view(np.int64), pa.int64())], ["id", "node"])
    return run


def _similar(sig: np.ndarray, other: np.ndarray, least: float, same: bool) -> np.ndarray:
    """Rows (i, j, equal positions) of two signature blocks with at least ``least`` equal positions; of a
    block with itself, those with i < j."""
    found, step = [], max(1, (1 << 21) // max(1, other.size))
    for i in range(0, len(sig), step):
        equal = (sig[i:i + step, None, :] == other[None, :, :]).sum(2, dtype=np.uint16)
        good = equal >= least
        if same:
            good &= np.arange(i, i + len(equal))[:, None] < np.arange(len(other))[None, :]
        x, y = np.nonzero(good)
        found.append(np.stack([x + i, y, equal[x, y]], 1).astype(np.int32))
    return np.concatenate(found) if found else np.empty((0, 3), np.int32)


def _comparisons(batches: Iterator[pa.RecordBatch], rows: int = 8192, most: int = 24 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole comparisons from batches ordered by (node, i, j): a table of many and their bounds."""
    held: list[pa.RecordBatch] = []
    count = size = 0

    def cut(t: pa.Table, last: bool):
        key = np.stack([t.column(c).to_numpy() for c in ("node", "i", "j")])
        starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        return (t, np.append(starts, t.num_rows), None) if last else (t.slice(0, starts[-1]), starts, t.slice(starts[-1]))

    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, 1024):
            b = whole_batch.slice(start, 1024)
            held.append(b)
            count, size = count + b.num_rows, size + b.nbytes
            if count >= rows or size >= most:
                whole, bounds, rest = cut(pa.Table.from_batches(held), False)
                held, count, size = rest.to_batches(), rest.num_rows, rest.nbytes
                if whole.num_rows:
                    yield whole, bounds
    if held:
        yield cut(pa.Table.from_batches(held), True)[:2]


def _pairs(t: pa.Table, bounds: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Candidate pairs (row, row, equal positions) inside each comparison of the table: those of all the
    small comparisons at once, then those of one large comparison after another."""
    sig = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, SIGNATURE)
    side = t.column("side").to_numpy()
    starts, sizes = bounds[:-1], np.diff(bounds)
    one_side = np.maximum.reduceat(side, starts) == 0
    found = [np.empty((0, 3), np.int32)]
    for n in np.unique(sizes[one_side & (sizes <= 16)]):
        a, b = np.triu_indices(n, 1)
        at = starts[one_side & (sizes == n)][:, None]
        left, right = (at + a).ravel(), (at + b).ravel()
        for k in range(0, len(left), 1 << 14):
            x, y = left[k:k + (1 << 14)], right[k:k + (1 << 14)]
            equal = (sig[x] == sig[y]).sum(1)
            good = equal >= least
            found.append(np.stack([x[good], y[good], equal[good]], 1).astype(np.int32))
    yield np.concatenate(found)
    for g in np.flatnonzero(~one_side | (sizes > 16)):
        at = starts[g]
        mine = side[at:bounds[g + 1]]
        left, right = at + np.flatnonzero(mine == 0), at + np.flatnonzero(mine == 1)
        same = not len(right)
        got = _similar(sig[left], sig[left if same else right], least, same)
        got[:, 0], got[:, 1] = left[got[:, 0]], (left if same else right)[got[:, 1]]
        yield got


def _active(least: float):
    """The members of each comparison that have a possible partner in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _comparisons(batches):
            hit = np.zeros(t.num_rows, bool)
            for pairs in _pairs(t, bounds, least):
                hit[pairs[:, :2]] = True
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()
    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two ascending sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _confirm(least: float, percent: int, chunk: int = 4096):
    """Links of each comparison, confirmed on whole sets; those that connect nothing new are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _comparisons(batches):
            ids = t.column("id").to_numpy()
            sets = [np.frombuffer(x, _U) for x in t.column("shingles").to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            part = np.arange(len(ids))                      # the connected part each row is in
            links = []
            for pairs in _pairs(t, bounds, least):
                pairs = pairs[np.argsort(-pairs[:, 2], kind="stable"), :2]
                for k in range(0, len(pairs), chunk):
                    a, b = pairs[k:k + chunk].T
                    new = (part[a] != part[b]) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
                    for x, y in zip(a[new].tolist(), b[new].tolist()):
                        if part[x] != part[y]:
                            both = _overlap(sets[x], sets[y])
                            if 100 * both >= percent * (int(sizes[x] + sizes[y]) - both):
                                mine = slice(bounds[group[x]], bounds[group[x] + 1])
                                part[mine][part[mine] == part[x]] = part[y]
                                links.append((x, y))
            out = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[out[:, 0]], pa.int64()), pa.array(ids[out[:, 1]], pa.int64())], ["a", "b"])
    return run


def _digests(first: np.ndarray, hashes: np.ndarray, second: np.ndarray) -> list[bytes | None]:
    """128-bit digests of sets laid end to end, half from each of two independent hashes; None for an empty set."""
    some = np.flatnonzero(np.diff(first))
    keys: list[bytes | None] = [None] * (len(first) - 1)
    if len(some):
        both = np.stack([np.add.reduceat(mix(h + _U(1)), first[some]) for h in (hashes, second)], 1)
        for k, r in enumerate(some):
            keys[r] = both[k].tobytes()
    return keys


def _whole_sets(width: int):
    """The sets that links are confirmed on, as second hashes: a link needs both hashes to agree.  A task
    sends a set of one document once, however many rows repeat it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for b in chunks_by_bytes(batches, "text", 1 << 20):
            words = Words(b.column("text"), lower=True)
            first, hashes, second = distinct_shingles(words, width, check=True)
            names = list(zip(b.column("doc").to_pylist(), _digests(first, hashes, second)))
            fresh = [i for i, x in enumerate(names) if x[1] is not None and x not in sent and not sent.add(x)]
            yield pa.RecordBatch.from_arrays([
                pa.array([names[i][0] for i in fresh], pa.int64()), pa.array([names[i][1] for i in fresh], pa.binary()),
                pa.array([np.sort(second[first[i]:first[i + 1]]).tobytes() for i in fresh], pa.binary())], ["doc", "key", "shingles"])
    return run


def _blocks(members: DataFrame, node_sets: int, node_bytes: int) -> DataFrame:
    """Deal nodes into comparisons (node, i, j): one for a small node, one per pair of blocks for a large one."""
    k = F.greatest(F.ceil(F.col("n") / node_sets), F.ceil(F.col("bytes") / node_bytes)).cast("int")
    m = members.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64("id", "node"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    return m.withColumn("other", other).select(
        "id", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))


def _ordered(compared: DataFrame) -> DataFrame:
    """The rows of one comparison next to each other in one task."""
    return compared.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def near_links(sets: DataFrame, texts: DataFrame, width: int, percent: int = 80, recall: float = 0.999,
               node_sets: int = NODE_SETS, node_bytes: int = NODE_BYTES, levels: int = LEVELS) -> DataFrame:
    """Confirmed links (a, b) that connect the similar sets of ``sets`` (id, doc, key, size, sig, sketch).

    ``texts`` (doc, text) has, under the document ``doc``, a text whose set has the digest ``key``.
    """
    threshold = percent / 100
    least = SIGNATURE * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SIGNATURE))
    trees = trees_for(recall, threshold)
    at = sets.select("id", F.explode(F.array([F.lit(t).cast("long") for t in range(trees)])).alias("node"))
    leaves = None
    for depth in range(1, levels + 1):
        walkers = at.join(sets.select("id", "sig"), "id") if depth > 1 else sets.select(
            "id", "sig", F.explode(F.array([F.lit(t).cast("long") for t in range(trees)])).alias("node"))
        children = durable(walkers.select("id", "node", "sig").mapInArrow(_branch(CHOICES), "id long, node long").join(
            sets.select("id", "size"), "id"))
        nodes = durable(children.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes")).where("n > 1"))
        alive = children.drop("size").join(nodes, "node")
        small = (F.col("n") <= node_sets) & (F.col("bytes") <= node_bytes)
        done = alive.where(small) if depth < levels else alive
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth == levels or not nodes.where(~small).limit(1).count():
            break
        at = alive.where(~small).select("id", "node")
    sketch = sets.select("id", "doc", "key", "sketch")
    compared = _blocks(leaves, node_sets, node_bytes).join(sketch, "id")
    active = durable(_ordered(compared).mapInArrow(_active(least), "id long, node long, i int, j int, side int, doc long, key binary, sketch binary"))
    found = texts.join(active.select("doc").distinct(), "doc", "left_semi").mapInArrow(_whole_sets(width), "doc long, key binary, shingles binary")
    return _ordered(active.join(found, ["doc", "key"])).mapInArrow(_confirm(least, percent), "a long, b long").distinct()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, recall: float = 0.999,
                    id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    A document's set holds the distinct shingles of ``width`` words (A-Z lowered; a shorter text is one
    shingle as a whole).  Two documents are linked if their sets' Jaccard similarity is ``percent``
    or more; ``component_id`` is the smallest id reachable by links and ``kept`` says that the document
    has it.  Null, empty and blank texts have an empty set and link with nothing.  Equal sets are
    represented by their smallest id.  Links join texts: rows that share an id have the component of their own
    text each, and equal rows are one document.  Ids are integers; rows with a null id form components
    of their own (null, kept).  Other columns are not read.
    """
    sets, of_set = _set_components(df, width, percent, recall, id_col, text_col, **limits)
    out = sets.select("id", "size", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(of_set, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def _set_components(df: DataFrame, width: int, percent: int, recall: float, id_col: str, text_col: str, mark: Column | None = None,
                    **limits) -> tuple[DataFrame, DataFrame]:
    """(id, size, key, sig of every row and its ``mark``; component_id of every distinct set by its key).

    Links join sets, which have numbers of their own, so texts that share an id stay apart.
    """
    mark = F.lit(None).cast("binary") if mark is None else mark
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark.alias("mark"))
    sets = durable(rows.mapInArrow(_sets(width), "id long, mark binary, size long, key binary, sig binary"))
    keyed = sets.where("key IS NOT NULL AND id IS NOT NULL")
    reps = durable(keyed.groupBy("key").agg(F.min_by(F.struct("id", "size", "sig"), "id").alias("r")).select(
        "key", F.col("r.id").alias("doc"), "r.size", "r.sig").mapInArrow(_with_sketch, "key binary, doc long, size long, sig binary, sketch binary")
        .withColumn("id", F.monotonically_increasing_id()))
    links = near_links(reps, rows.select(F.col("id").alias("doc"), "text"), width, percent, recall, **limits)
    parts = components(links)
    named = reps.select("key", "doc", "id").join(parts, "id", "left").withColumn("part", F.coalesce("component_id", "id"))
    least = named.groupBy("part").agg(F.min("doc").alias("component_id"))
    return sets, durable(named.select("key", "part").join(least, "part").select("key", "component_id"))


def _with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low byte of every signature position, which is what nodes compare."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, SIGNATURE)
        low = (sig & np.uint32(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in low], pa.binary())], [*b.schema.names, "sketch"])


def drop_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, recall: float = 0.999,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, of one document (the smallest id) per group of near duplicates.

    A row goes by its id and the set of its text, so another text under the same id stays.
    """
    name, mine, gone = (fresh_name(df, n) for n in ("dropped_id", "text_digest", "dropped_digest"))
    digest = F.unhex(F.sha2(F.col(text_col), 256))
    sets, of_set = _set_components(df, width, percent, recall, id_col, text_col, mark=digest)
    dropped = sets.where("id IS NOT NULL").join(of_set, "key").where("id <> component_id").select(
        F.col("id").alias(name), F.col("mark").alias(gone)).distinct()
    same = (F.col(id_col).cast("long") == F.col(name)) & (F.col(mine) == F.col(gone))
    return df.withColumn(mine, digest).join(dropped, same, "left_anti").drop(mine)
