"""Source mixing: targets, the splitting tree, and the taken words."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from feedlens.llm.mixing import WEIGHTS, mix_decisions, mix_documents, plan, shard_quotas, targets

from .conftest import CLASHING, sentence


def test_targets_stop_at_three_sizes():
    t = targets([10, 1000, 1000], [5, 2, 1])
    assert t[0] == 30 and abs(sum(t) - 2010) < 1e-9 and abs(t[1] / t[2] - 2) < 1e-9
    assert targets([], []) == [] and targets([0, 0], [1, 1]) == [0.0, 0.0]
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice([0, 1, 5, 100, 10_000]) * r.randint(1, 9) for _ in range(r.randint(1, 12))]
        weights = [WEIGHTS[k % 3] for k in range(len(sizes))]
        t = targets(sizes, weights)
        assert abs(sum(t) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
        assert all(x <= 3 * n + 1e-9 for x, n in zip(t, sizes))
        free = [x / w for x, n, w in zip(t, sizes, weights) if n and x < 3 * n - 1e-9]
        assert not free or max(free) - min(free) < 1e-6 * max(free)


def test_plan_orders_by_code_point_null_last():
    assert [s.name for s in plan([(None, 1), ("é", 1), ("b", 1), ("a", 1), ("B", 1), ("", 1)], 10)] == ["", "B", "a", "b", "é", None]


def test_shard_quotas_partition_every_draw():
    quotas = np.array([7, 0, 130, 1, 61])
    for shards in (1, 2, 7, 16):
        total = int(quotas.sum())
        seen = [Counter() for _ in quotas]
        for k in range(shards):
            first, count = shard_quotas(quotas, shards, k, seed=3)
            assert abs(count.sum() - total / shards) <= 1
            for s in range(len(quotas)):
                seen[s].update(range(first[s], first[s] + count[s]))
        assert all(sorted(c) == list(range(q)) and all(v == 1 for v in c.values()) for c, q in zip(seen, quotas))


def test_splits_are_hypergeometric_in_the_mean():
    quotas = np.array([100, 300])
    left = np.array([shard_quotas(quotas, 2, 0, seed)[1] for seed in range(400)])
    assert abs(left[:, 0].mean() - 50) < 1.5 and 3 < left[:, 0].std() < 6


def _frame(spark, n=600):
    r = random.Random(9)
    rows = [(i, sentence(r, r.choice([0, 1, 5, 40, 200])) if r.random() > 0.02 else None, r.choice(["big"] * 6 + ["a", "b", "c", None]), *[i] * len(CLASHING))
            for i in range(n)]
    names = ", ".join(f"`{c}` long" for c in CLASHING)
    return rows, spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}").repartition(3)


def test_mix(spark):
    rows, df = _frame(spark)
    small = {"block_words": 300, "shard_blocks": 4}
    got = {r.doc_id: r for r in mix_decisions(df, **small).collect()}
    again = {r.doc_id: r for r in mix_decisions(df.repartition(7), **small).collect()}
    assert got == again and len(got) == len(rows)
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    for i, text, source, *_ in rows:
        n = len((text or "").split())
        assert got[i].size == n and len(got[i].shards) <= 3
        sizes[source] += n
        taken[source] += n * len(got[i].shards)
        want[source] = got[i].target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [want[s] for s in order] == targets([sizes[s] for s in order], [WEIGHTS[k % 3] for k in range(len(order))])
    for s in order:
        assert abs(taken[s] - want[s]) <= 100, s            # half of the longest document: a block holds a few
    assert len({x for r in got.values() for x in r.shards}) > 5
    mixed = mix_documents(df, **small)
    assert mixed.columns == df.columns
    counts = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert counts == Counter({i: len(r.shards) for i, r in got.items() if r.shards})


def test_draws_fill_their_places_despite_empty_blocks(spark):
    """Few long documents leave blocks of source a empty; every shard still gets its exact quotas."""
    rows = [(i, "w " * 100, "a") for i in range(12, 24)] + [(100 + i, "w", "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_decisions(df, seed=7, block_words=100, shard_blocks=4, keep=("text",))
    blocks = F.when(F.col("doc_id") < 100, 12).otherwise(40)
    draws = {(r.doc_id >= 100, r.block, k, shard) for r in got.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), blocks)).collect()
             for k, shard in enumerate(r.shards)}
    quotas = np.array([sum(not b for b, *_ in draws), sum(b for b, *_ in draws)], np.int64)
    used = len({block for b, block, *_ in draws if not b})
    assert used < 12 and quotas[0] == 3 * used
    shards = max(1, round(int(quotas.sum()) / 4))
    for k in range(shards):
        want = shard_quotas(quotas, shards, k, 7)[1]
        assert [sum((b, s) == (x, k) for b, _, _, s in draws) for x in (False, True)] == want.tolist()


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mix_decisions(spark.createDataFrame([], schema)).count() == 0
    assert mix_documents(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", None), (2, None, "y")], schema)
    got = mix_decisions(df).collect()
    assert sorted((r.size, r.source_size) for r in got) == [(0, 0), (1, 1), (2, 4), (2, 4)]
    assert all(len(r.shards) <= 3 for r in got)
    mix_documents(df).collect()


def _brute_targets(sizes, weights, most=3):
    """The level at which shares by weight, each at most ``most`` sizes, add up to the total, by bisection."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, most * n) for n, w in zip(sizes, weights)) < sum(sizes) else (lo, mid)
    return [min(hi * w, most * n) for n, w in zip(sizes, weights)]


def test_targets_by_brute_force():
    r = random.Random(4)
    for _ in range(50):
        sizes = [r.choice([0, r.randint(1, 20), r.randint(1, 100_000)]) for _ in range(r.randint(1, 12))]
        weights = [WEIGHTS[i % 3] for i in range(len(sizes))]
        if sum(sizes):
            assert np.allclose(targets(sizes, weights), _brute_targets(sizes, weights), rtol=1e-6, atol=1e-6)


def test_rows_without_own_id_reach_the_targets(spark):
    """Half of the rows have no id, others share one id across sources: every row is decided for itself."""
    r = random.Random(8)
    rows = [(None if i % 2 else (7 if i % 3 else i), " ".join(["w"] * r.randint(1, 60)) + f" {i}", "ab"[i % 5 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = {x.source: x.target for x in mix_decisions(df.withColumn("s", F.col("source")), block_words=2000, keep=("s",)).select(
        F.col("s").alias("source"), "target").distinct().collect()}
    mixed = mix_documents(df, block_words=2000).withColumn("size", F.size(F.split("text", " ")))
    taken = {x.source: x.n for x in mixed.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert set(taken) == set(want) == {"a", "b"} and all(abs(taken[k] - want[k]) <= 60 for k in want)
    assert max(Counter(tuple(x) for x in mixed.select("doc_id", "text").collect()).values()) <= 3


def test_mix_of_many_null_ids_and_long_texts(spark):
    rows = [(None, None, "a")] * 50 + [(None, "x y", "b")] * 50 + [(1, "w " * 90_000, "a"), (2, "w " * 10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_decisions(df).collect()
    assert len(got) == len(rows) and {r.size for r in got} == {0, 2, 10, 90_000} and all(len(r.shards) <= 3 for r in got)
    mix_documents(df).count()
