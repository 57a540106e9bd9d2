"""Embedding near-duplicates through a pivot-permutation index.

Pivots are random normal vectors, about ``2 sqrt(n)`` of them, and near means a large inner product.  The
inner products of two unit vectors with such pivots are pairs of normal variables whose correlation is the
cosine, so whether a pair is retrieved depends on its cosine and the number of pivots only, and
neither on the other vectors, however dense they lie, nor on the dimension.  Every vector is described by its
``prefix`` nearest pivots in order and entered in the inverted list of each.  Two vectors are candidates
if their descriptions share at least ``shared`` pivots; the pair is counted in the list of the smallest
pivot they share only, and verified there by its cosine in double precision.  A list longer than
``list_rows`` is dealt into blocks and every pair of blocks is compared, so long lists lose nothing.

Equal vectors are one entry with a multiplicity.  A list yields, per vector, the number of its verified
partners and only those links that connect something new; pairs are never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import components

#: Vectors compared at once.
LIST_ROWS = 2048
#: The most pivots an index uses.
MOST_PIVOTS = 1 << 18


def _usable(v: Column) -> Column:
    """A vector has a direction if no component is null or not finite and one is not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of doubles as rows of unit length, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = int(width or max(sizes, default=0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(len(sizes), width)
    else:
        at = np.cumsum(sizes) - sizes
        for k, (a, n) in enumerate(zip(at, sizes)):
            out[k, :min(n, width)] = flat[a:a + min(n, width)]
    out = out / np.maximum(np.abs(out).max(1, keepdims=True, initial=0), 1e-300)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def draw_pivots(count: int, width: int, seed: int = 5) -> np.ndarray:
    """Standard normal vectors, the same in every task; not of unit length, so a shorter vector, which meets
    their first components only, finds normal pivots too."""
    return np.random.default_rng([seed, count, width]).standard_normal((count, width))


def _describe(count: int, width: int, prefix: int):
    """(id, copies, pivot, near, v): one entry per pivot of the description ``near``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = draw_pivots(count, width)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                closeness = _matrix(b.column("v"), pivots.shape[1]) @ pivots.T
                k = min(prefix, pivots.shape[0])
                near = np.argpartition(-closeness, k - 1, axis=1)[:, :k]
                rank = np.argsort(-np.take_along_axis(closeness, near, 1), axis=1, kind="stable")
                near = np.take_along_axis(near, rank, 1).astype(np.int32)
                take = pa.array(np.repeat(np.arange(b.num_rows), k), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("copies").take(take), pa.array(near.ravel(), pa.int32()),
                     pa.array([x.tobytes() for x in near], pa.binary()).take(take), b.column("v").take(take)],
                    ["id", "copies", "pivot", "near", "v"])
    return run


def _verify(shared: int, cosine: float, step: int = 1024):
    """One comparison of a list: verified partners per vector and the links that connect something new."""
    def run(t: pa.Table) -> pa.Table:
        pivot = t.column("pivot")[0].as_py()
        ids, copies, side = (t.column(c).to_numpy() for c in ("id", "copies", "side"))
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.int32).reshape(t.num_rows, -1)
        unit = _matrix(t.column("v"))
        sizes = np.diff(t.column("v").combine_chunks().offsets.to_numpy())
        known, place = np.unique(near, return_inverse=True)
        has = np.zeros((t.num_rows, len(known)), np.float32)
        np.put_along_axis(has, place.reshape(near.shape), 1, 1)
        before = has[:, known < pivot]
        two_blocks = bool(side.any())
        left = np.flatnonzero(side == 0) if two_blocks else np.arange(t.num_rows)
        right = np.flatnonzero(side == 1) if two_blocks else left
        partners = np.zeros(t.num_rows, np.int64)
        part = np.arange(t.num_rows)              # the connected part each row is in
        links = []
        for k in range(0, len(left), step):
            x = left[k:k + step]
            ok = unit[x] @ unit[right].T >= cosine
            # Shared pivots, none of them in an earlier list than this one.
            ok &= (has[x] @ has[right].T >= shared) & (before[x] @ before[right].T == 0)
            ok &= sizes[x][:, None] == sizes[right][None, :]
            if not two_blocks:
                ok &= x[:, None] < right[None, :]
            partners[x] += ok @ copies[right]
            partners[right] += copies[x] @ ok
            for i, row in zip(x[ok.any(1)].tolist(), ok[ok.any(1)]):
                # One link to each part that the row's partners are in and the row is not.
                others, at = np.unique(part[right[row]], return_index=True)
                new = others != part[i]
                if new.any():
                    links += [(i, int(j)) for j in right[row][at[new]]]
                    part[np.isin(part, others[new])] = part[i]
        some = np.flatnonzero(partners)
        out = np.array(links, np.int64).reshape(-1, 2)
        n = len(some)
        return pa.table({
            "id": pa.array(np.concatenate([ids[some], ids[out[:, 0]]]), pa.int64()),
            "partners": pa.array(np.concatenate([partners[some], np.zeros(len(out), np.int64)]), pa.int64()),
            "linked": pa.array(np.concatenate([ids[some], ids[out[:, 1]]]), pa.int64(), mask=np.arange(n + len(out)) < n)})
    return run


def vector_duplicates(df: DataFrame, cosine: float = 0.95, prefix: int = 8, shared: int = 2,
                      id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    ``n_links`` counts the other vectors with a cosine of ``cosine`` or more that the index retrieves,
    ``component_id`` is the smallest id reachable by links, ``kept`` says that the vector has it.
    Null and zero vectors and those with null or non-finite components link with nothing, and vectors of
    different lengths do not link.  Repeated rows of one id are vectors of their own and link with
    each other; ids are integers; a null id gets a null component.  Other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(_usable(v), v).alias("v"))
    reps = durable(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where("id IS NOT NULL"))
    n, width = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    if n:
        pivots = min(MOST_PIVOTS, max(16, math.ceil(2 * math.sqrt(n))))
        entries = durable(reps.select("id", "copies", "v").mapInArrow(
            _describe(pivots, width, prefix), "id long, copies long, pivot int, near binary, v array<double>"))
        blocks = entries.groupBy("pivot").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("k"))
        dealt = entries.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        compared = dealt.select("id", "copies", "pivot", "near", "v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                                F.when(F.col("block") <= F.col("other"), 0).otherwise(1).cast("int").alias("side"))
        found = durable(compared.groupBy("pivot", "i", "j").applyInArrow(_verify(shared, cosine), "id long, partners long, linked long"))
    else:
        found = reps.select("id", F.lit(0).cast("long").alias("partners"), F.lit(None).cast("long").alias("linked"))
    parts = components(found.where("linked IS NOT NULL").select(F.col("id").alias("a"), F.col("linked").alias("b")))
    of_rep = (reps.join(found.groupBy("id").agg(F.sum("partners").alias("partners")), "id", "left").join(parts, "id", "left")
              .select("v", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")))
    out = rows.join(durable(of_rep), "v", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
