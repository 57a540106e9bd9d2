"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by hash into blocks.  Its target buys whole passes over its blocks and
then, in a permuted order, blocks of one more pass up to the remaining words; only the block in which
the target falls is opened.  The resulting exact block quotas of all sources are split down a
binary tree over the output shards: at every node the left half draws its share from the
node's quotas by a multivariate hypergeometric draw seeded by the node, so a shard finds its own
quotas by walking from the root and no node is stored.  A shard takes the next so many blocks
of each source's permuted draws, disjoint from all other shards, and orders its documents by hash.

One number per source passes through the driver; sources are a vocabulary of at most ``MOST_SOURCES``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, checkpoint_folder, durable, fresh_name

MOST_SOURCES = 100_000
#: Words in a block, blocks in a shard, and passes over a source at most.
BLOCK_WORDS, SHARD_BLOCKS, MOST_PASSES = 1 << 17, 32, 3
WEIGHTS = (5, 2, 1)
#: Further looks through an opened block for documents that still fit.
REFINE = 3
_PRIMES = (2147483629, 2147483587, 2147483579)


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    passes: int
    rest: float
    blocks: int


def targets(sizes: list[int], weights: list[float], most: int = MOST_PASSES) -> list[float]:
    """Shares of the total by weight; a share above ``most`` times its size stops there and the excess
    is shared again by weight among the others until none is above."""
    out = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    left = float(sum(sizes))
    while free:
        total = math.fsum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        free = [i for i in free if i not in set(full)]
        left = float(sum(sizes)) - math.fsum(out)
    return out


def plan(rows: list[tuple[str | None, int]], block_words: int, weights: tuple[float, ...] = WEIGHTS) -> list[Source]:
    """Sources by code point, null last, with their weights repeating in that order."""
    rows = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    want = targets([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))])
    out = []
    for (name, n), t in zip(rows, want):
        passes = min(MOST_PASSES, int(t // n)) if n else 0
        out.append(Source(name, n, t, passes, max(0.0, t - passes * n), max(1, math.ceil(n / block_words))))
    return out


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, number of draws) of one shard for every source, by a walk down the splitting tree."""
    total = int(quotas.sum())
    counts, offset = quotas.copy(), np.zeros_like(quotas)
    lo, hi, node = 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = total * mid // shards - total * lo // shards
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, share, method="marginals")
        if shard < mid:
            counts, hi, node = left, mid, 2 * node
        else:
            counts, offset, lo, node = counts - left, offset + left, mid, 2 * node + 1
    return offset, counts


def _walk(quotas: np.ndarray, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("id").to_pylist():
                first, count = shard_quotas(quotas, shards, shard, seed)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(first[some], pa.int64()), pa.array(count[some], pa.int64()),
                                                  pa.array(np.full(len(some), shard), pa.int32())], ["source_no", "first", "count", "shard"])
    return run


def mix_decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  seed: int = 7, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (id, size, source_size, target, shards) and the columns ``keep`` names.

    ``size`` is the number of words of the whole text (null: 0), ``target`` the words the mix should take
    of the document's source and ``shards`` the output shards that get a copy, at most three.
    A source's taken words differ from its target by less than the documents of one block can close.
    Sources are shared out by ``targets`` with the weights 5, 2, 1 repeating in code point order, null
    last.  Repeated rows are documents of their own; empty texts may be taken at no cost; an empty
    table gives no rows.  The same input and seed give the same mix.  Other columns are not read.
    """
    spark = df.sparkSession
    kept = [f"kept_{i}" for i in range(len(keep))]
    # Blocks are dealt by id and text, so rows with a null or a repeated id spread.
    docs = durable(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *[F.col(c).alias(k) for c, k in zip(keep, kept)],
                             F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
                             F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h")))
    per_source = docs.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = plan([(r[0], r[1]) for r in per_source], block_words)
    frame = spark.createDataFrame([(i, s.name, s.size, s.target, s.passes, s.rest, s.blocks) for i, s in enumerate(sources)],
                                  "source_no int, source string, source_size long, target double, passes int, rest double, blocks int")
    placed = docs.join(F.broadcast(frame), docs.source.eqNullSafe(frame.source)).drop("source").withColumn(
        "block", F.pmod("h", F.col("blocks")).cast("int"))
    order = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 1), "source_no", "block"), "block")
    blocks = (placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
              .join(F.broadcast(frame.select("source_no", "passes", "rest")), "source_no")
              .withColumn("upto", F.sum("words").over(order)).withColumn("nth", F.row_number().over(order) - 1)
              .withColumn("room", F.col("rest") - F.col("upto") + F.col("words"))
              .withColumn("part", F.when(F.col("room") <= 0, "none").when(F.col("words") <= F.col("room"), "whole").otherwise("open"))
              .withColumn("drawn", F.col("passes") + (F.col("part") != "none").cast("int")))
    blocks = durable(blocks.select("source_no", "block", "nth", "passes", "part", "room", "drawn"))
    quota = {r[0]: r[1] for r in blocks.groupBy("source_no").agg(F.sum("drawn").alias("q")).collect()}
    quotas = np.array([quota.get(i, 0) for i in range(len(sources))], np.int64)
    shards = max(1, round(int(quotas.sum()) / shard_blocks))
    # Draw number of (pass, block): full passes one after another, then the blocks of the last one in
    # their permuted order, which come first in it; an affine map permutes the draws of a source.
    # Blocks without a document have no draw, so a pass has as many draws as the source has blocks here.
    per = blocks.groupBy("source_no").agg(F.count("*").alias("n_blocks"))
    q = F.broadcast(spark.createDataFrame([(i, int(n), next(p for p in _PRIMES if not n or p % n or n == 1)) for i, n in enumerate(quotas)],
                                          "source_no int, q long, step long"))
    draws = (blocks.where("drawn > 0").join(F.broadcast(per), "source_no").join(q, "source_no")
             .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("drawn") - 1)))
             .withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("nth"))
             .withColumn("at", F.pmod(F.col("draw") * F.pmod("step", "q") + F.lit(seed), F.col("q"))))
    ranges = spark.range(shards).mapInArrow(_walk(quotas, shards, seed), "source_no int, first long, count long, shard int")
    places = ranges.select("source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("at"))
    of_block = (draws.join(places, ["source_no", "at"]).groupBy("source_no", "block")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards")))
    told = blocks.select("source_no", "block", "passes", "part", "room").join(of_block, ["source_no", "block"], "left")
    rows = placed.select("id", *kept, "size", "h", "source_size", "target", "source_no", "block").join(durable(told), ["source_no", "block"])
    rows = rows.withColumn("shards", F.coalesce("shards", F.expr("array()").cast("array<int>")))
    closed = rows.where("part <> 'open'").select("id", *kept, "size", "source_size", "target", "shards")
    inside = Window.partitionBy("source_no", "block").orderBy("h", "id", "size")
    opened = rows.where("part = 'open'").withColumn("sum", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    whole = Window.partitionBy("source_no", "block")
    opened = opened.withColumn("in", F.col("sum") <= F.col("room")).withColumn(
        "gap", F.col("room") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))).over(whole), F.lit(0)))
    for _ in range(REFINE):             # what still fits behind the first document that did not
        more = ~F.col("in") & (F.col("size") <= F.col("gap"))
        opened = opened.withColumn("sum", F.when(more, F.sum(F.when(more, F.col("size"))).over(inside))).withColumn(
            "add", F.coalesce(F.col("sum") <= F.col("gap"), F.lit(False)))
        opened = opened.withColumn("in", F.col("in") | F.col("add")).withColumn(
            "gap", F.col("gap") - F.coalesce(F.sum(F.when(F.col("add"), F.col("size"))).over(whole), F.lit(0)))
    off = F.abs(F.col("size") - F.col("gap"))
    opened = (opened.withColumn("off", F.when(~F.col("in") & (off < F.col("gap")), F.struct(off, "nth")))
              .withColumn("in", F.col("in") | F.coalesce(F.min("off").over(whole)["nth"] == F.col("nth"), F.lit(False))))
    opened = opened.select("id", *kept, "size", "source_size", "target", F.when(F.col("in"), F.col("shards")).otherwise(
        F.slice("shards", 1, F.col("passes"))).alias("shards"))
    return closed.unionByName(opened).withColumnsRenamed({"id": id_col, **dict(zip(kept, keep))})


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of ``df`` once for every shard that takes it, shard by shard, in an order
    shuffled within the shard.

    Every row is decided and copied for itself, whether its id is null, repeated or shared by several
    sources: the rows are numbered in a copy in the shared checkpoint folder.
    """
    spark = df.sparkSession
    key, copy, shard, order = (fresh_name(df, n) for n in ("mix_key", "mix_copy", "mix_shard", "mix_order"))
    path = f"{checkpoint_folder(spark)}/mix-{uuid.uuid4().hex[:12]}"
    df.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    decided = mix_decisions(rows, id_col, text_col, source_col, keep=(key,), **options)
    copies = decided.select(key, F.posexplode("shards").alias(copy, shard))
    mixed = rows.join(copies, key).withColumn(order, F.xxhash64(shard, key, copy))
    return mixed.repartition(shard).sortWithinPartitions(shard, order).select(*[rows[c] for c in df.columns])
