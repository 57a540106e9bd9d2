"""Toxicity classification: a convolutional text classifier over hashed word embeddings.

A word is the sum of two rows of an embedding table, chosen by two hashes, so that two words rarely share
both.  Filters of several widths slide over the whole text, each filter keeps its largest answer
(max pooling), and a logistic layer reads the pooled answers.  All labelled documents take part in
learning, whole: two thirds train the network, the others calibrate it and set one threshold per language.
Training runs in rounds of parameter averaging: the documents are dealt to tasks, each task takes the
network of the round before through its documents once, and the networks of the tasks are averaged by Spark,
a stretch of the embedding table at a time.  The score itself depends on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmaps import flagged
from .common import chunks_by_bytes, durable, pow2_at_least
from .words import CHECK_SEED, Words

#: One labelled document in so many calibrates, the others train.
CALIBRATE_EVERY = 3
#: Labelled documents of a training task; training tasks at most (they get more documents each then).
SHARD_DOCS, SHARDS = 4_096, 128
#: Bytes of packed documents that a training task holds and shuffles at once; embedding rows averaged by one group.
BLOCK_BYTES, STRETCH = 4 << 20, 512
#: Calibrating documents to a bin, and bins at most, of the running counts that find the thresholds.
BIN_DOCS, BINS = 1 << 16, 1_024
#: Bits of the map of labelled ids.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27
THRESHOLD = 0.3
BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.005, 1e-6
#: Share of the words left out of a training step, so that no document is learnt by one rare word; spread of new embeddings.
DROP, SPREAD = 0.5, 0.02
#: Zero words after each text: every text has a window of zeros for each width, the empty one too.
PAD = 2 * (max(WIDTHS) - 1)


def _separators() -> np.ndarray:
    """White space, control characters and ASCII punctuation part words here."""
    flags = np.zeros(256, bool)
    flags[[c for c in range(128) if not chr(c).isalnum()]] = True
    return flags


_SEPARATORS = _separators()


class Slots:
    """The embedding rows of a column of texts, ``PAD`` zero rows after each text."""

    def __init__(self, column: pa.Array):
        words = Words(column, lower=True, hashes=True, space=_SEPARATORS)
        self._place(words.counts(), words.hash % np.uint64(BUCKETS), words.hashes(CHECK_SEED) % np.uint64(BUCKETS))

    def _place(self, counts: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.rows = len(counts)
        self.first = np.append(0, np.cumsum(counts + PAD))
        at = np.arange(len(one)) + np.repeat(np.arange(self.rows), counts) * PAD
        self.one = np.full(self.first[-1], BUCKETS, np.int32)
        self.two = np.full(self.first[-1], BUCKETS, np.int32)
        self.one[at], self.two[at] = one, two

    def packed(self) -> pa.Array:
        """Per text, the two embedding rows of each word, as 16-bit numbers."""
        words = self.one != BUCKETS
        pairs = np.stack([self.one[words], self.two[words]], 1).astype(np.uint16)
        ends = np.append(0, np.cumsum(np.diff(self.first) - PAD)) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs)]).cast(pa.binary())

    @classmethod
    def unpacked(cls, column: pa.Array) -> "Slots":
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        pairs = (np.frombuffer(data, np.uint16, (ends[-1] - ends[0]) // 2, ends[0]) if data is not None else np.empty(0, np.uint16)).reshape(-1, 2)
        out = object.__new__(cls)
        out._place(np.diff(ends) // 4, pairs[:, 0], pairs[:, 1])
        return out

    def take(self, texts: np.ndarray) -> "Slots":
        """The slots of some of the texts."""
        out = object.__new__(Slots)
        size = np.diff(self.first)[texts]
        out.rows, out.first = len(texts), np.append(0, np.cumsum(size))
        at = np.repeat(self.first[texts] - out.first[:-1], size) + np.arange(out.first[-1])
        out.one, out.two = self.one[at], self.two[at]
        return out


@dataclass
class Network:
    table: np.ndarray               # (BUCKETS + 1) x DIMENSIONS; the last row is zero
    filters: list[np.ndarray]       # per width: (width * DIMENSIONS) x FILTERS
    bias: np.ndarray                # all filters
    out: np.ndarray
    shift: float                    # bias of the logistic layer
    slope: float = 1.0              # calibration: the score is the logistic of slope * margin + offset
    offset: float = 0.0

    def pooled(self, s: Slots, positions: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(texts x filters) largest answers and, if asked for, the window that gave each."""
        embedded = self.table[s.one] + self.table[s.two]
        starts = np.stack([s.first[:-1], s.first[1:] - (max(WIDTHS) - 1)], 1).ravel()
        n = len(embedded)
        best, where = [], []
        for width, w in zip(WIDTHS, self.filters):
            answer = np.zeros((n, FILTERS), np.float32)
            for j in range(width):
                answer[:n - j] += embedded[j:] @ w[j * DIMENSIONS:(j + 1) * DIMENSIONS]
            # One row more, so that the last bound of reduceat is inside.
            top = np.maximum.reduceat(answer, starts)[::2]
            best.append(top)
            if positions:
                row = np.repeat(np.arange(s.rows), np.diff(s.first))
                at, f = np.nonzero(answer == top[row])
                inside = at < s.first[row[at] + 1] - (max(WIDTHS) - 1)
                at, f = at[inside], f[inside]
                _, pick = np.unique(row[at] * FILTERS + f, return_index=True)
                where.append(at[pick].reshape(s.rows, FILTERS))
        return np.concatenate(best, 1) + self.bias, np.concatenate(where, 1) if positions else None

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0).astype(np.float64) @ self.out + self.shift

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.empty(0)
        return self.scores(self.margin(self.pooled(Slots(column))[0]))

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))


class _Adam:
    """Adam steps; for the embedding table only the touched rows move."""

    def __init__(self, *arrays: np.ndarray):
        self.arrays = arrays
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
        self.t = 0

    def step(self, grads: list, rows: list) -> None:
        self.t += 1
        rate = RATE * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for a, m, v, g, r in zip(self.arrays, self.m, self.v, grads, rows):
            m[r] = 0.9 * m[r] + 0.1 * g
            v[r] = 0.999 * v[r] + 0.001 * g * g
            a[r] -= rate * m[r] / (np.sqrt(v[r]) + 1e-8)


def start(r: np.random.Generator, positive_share: float) -> Network:
    """The network before training; its bias is the log odds of a share of ones."""
    table = r.normal(0, SPREAD, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    table[BUCKETS] = 0
    filters = [r.normal(0, 0.4 / np.sqrt(w), (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    here = min(max(positive_share, 1e-3), 1 - 1e-3)
    return Network(table, filters, np.zeros(total, np.float32), r.normal(0, 0.3, total).astype(np.float32), float(np.float32(np.log(here / (1 - here)))))


class Trainer:
    """A network in training, with the state of its optimiser."""

    def __init__(self, net: Network):
        self.net, self.shift = net, np.array([net.shift], np.float32)
        self.adam = _Adam(net.table, *net.filters, net.bias, net.out, self.shift)

    def learn(self, slots: Slots, y: np.ndarray, r: np.random.Generator) -> None:
        """One pass over texts and their 0/1 labels in random order."""
        net, everything = self.net, slice(None)
        order = r.permutation(len(y))
        for k in range(0, len(y), BATCH):
            s, truth = slots.take(order[k:k + BATCH]), y[order[k:k + BATCH]]
            gone = r.random(len(s.one)) < DROP
            s.one[gone] = s.two[gone] = BUCKETS
            net.shift = float(self.shift[0])
            pooled, at = net.pooled(s, positions=True)
            live = np.maximum(pooled, 0)
            wrong = ((1 / (1 + np.exp(-np.clip(net.margin(pooled), -60, 60))) - truth) / len(truth)).astype(np.float32)
            back = wrong[:, None] * net.out * (pooled > 0)
            moved, of_filters = [], []
            for i, (width, w) in enumerate(zip(WIDTHS, net.filters)):
                g, p = back[:, i * FILTERS:(i + 1) * FILTERS], at[:, i * FILTERS:(i + 1) * FILTERS]
                grad = np.zeros_like(w)
                for j in range(width):
                    one, two = s.one[p + j], s.two[p + j]
                    part = w[j * DIMENSIONS:(j + 1) * DIMENSIONS]
                    grad[j * DIMENSIONS:(j + 1) * DIMENSIONS] = np.einsum("tfd,tf->df", net.table[one] + net.table[two], g)
                    to_word = (g[:, :, None] * part.T[None]).reshape(-1, DIMENSIONS)
                    moved += [(one.ravel(), to_word), (two.ravel(), to_word)]
                of_filters.append(grad + DECAY * w)
            slot, at_row = np.unique(np.concatenate([m[0] for m in moved]), return_inverse=True)
            summed = np.zeros((len(slot), DIMENSIONS), np.float32)
            np.add.at(summed, at_row, np.concatenate([m[1] for m in moved]))
            summed[slot == BUCKETS] = 0
            self.adam.step([summed, *of_filters, back.sum(0), live.T @ wrong, wrong.sum(keepdims=True)],
                           [slot, *[everything] * len(WIDTHS), everything, everything, everything])
        net.table[BUCKETS] = 0
        net.shift = float(self.shift[0])

    def _dense(self) -> list[np.ndarray]:
        return [a for k in (self.adam.arrays, self.adam.m, self.adam.v) for a in k[1:]]

    def dense(self) -> np.ndarray:
        """All arrays but the embedding table, with their moments, one after the other, and the steps taken."""
        return np.concatenate([*[a.ravel() for a in self._dense()], np.array([self.adam.t], np.float32)])

    def put_dense(self, values: np.ndarray) -> None:
        at = 0
        for a in self._dense():
            a[...] = values[at:at + a.size].reshape(a.shape)
            at += a.size
        self.adam.t, self.net.shift = round(float(values[-1])), float(self.shift[0])


def fit(column: pa.Array, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train on texts and their 0/1 labels that are here."""
    r = np.random.default_rng(seed)
    trainer = Trainer(start(r, float(y.mean()) if len(y) else 0.5))
    slots = Slots(column)
    for _ in range(epochs):
        trainer.learn(slots, y, r)
    return trainer.net


def best_threshold(score: np.ndarray, y: np.ndarray, default: float = THRESHOLD) -> float:
    """The threshold of the largest F1, midway between the scores it parts; ``default`` without both classes."""
    if not len(y) or y.min() == y.max():
        return default
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(s) + 1) + y.sum()), -1)
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def _held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the decimal id, modulo ``folds``, is ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Model:
    network: Network
    default: float
    thresholds: dict[str, float]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks_by_bytes(batches, "text", 1 << 20):
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "label", "lang")), Slots(b.column("text")).packed()], ["h", "label", "lang", "slots"])


def _pass(trainer: Trainer, seed: int, k: int):
    """Round ``k`` of a task: by how much its documents moved the embedding rows, by stretch, and what they made of
    the rest (stretch -1).  The moments of the embedding rows start anew in every round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        r, before = np.random.default_rng([seed, k, task]), trainer.net.table.copy()
        any_row = False
        for b in chunks_by_bytes(batches, "slots", BLOCK_BYTES):
            if b.num_rows:
                any_row = True
                trainer.learn(Slots.unpacked(b.column("slots")), b.column("label").to_numpy().astype(np.float32), r)
        if not any_row:
            return
        moved = (trainer.net.table - before).astype(np.float16)
        touched = np.flatnonzero(moved.any(1)).astype(np.int32)
        parts = [(-1, b"", trainer.dense().tobytes())]
        parts += [(int(p), at.tobytes(), moved[at].tobytes()) for p in np.unique(touched // STRETCH) for at in (touched[touched // STRETCH == p],)]
        yield pa.RecordBatch.from_pydict({"part": pa.array([p[0] for p in parts], pa.int32()), "task": pa.array([task] * len(parts), pa.int32()),
                                          "at": pa.array([p[1] for p in parts], pa.binary()), "value": pa.array([p[2] for p in parts], pa.binary())})
    return run


def _averaged(group: pa.Table) -> pa.Table:
    """The mean of a stretch over the tasks that touched a row, in the order of the tasks."""
    group = group.sort_by("task")
    part = group["part"][0].as_py()
    values = [np.frombuffer(v, np.float32 if part < 0 else np.float16) for v in group["value"].to_pylist()]
    if part < 0:
        at, mean = np.empty(0, np.int32), np.mean(values, 0, dtype=np.float64)
    else:
        ats = [np.frombuffer(v, np.int32) for v in group["at"].to_pylist()]
        at, back = np.unique(np.concatenate(ats), return_inverse=True)
        total = np.zeros((len(at), DIMENSIONS))
        np.add.at(total, back, np.concatenate(values).reshape(-1, DIMENSIONS))
        mean = total / np.bincount(back, minlength=len(at))[:, None]
    return pa.table({"part": pa.array([part], pa.int32()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                     "value": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train(examples: DataFrame, positive_share: float, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network trained on all (label, slots) rows; every partition is the share of one task.

    The driver holds one network; a task holds one and a block of its documents."""
    trainer = Trainer(start(np.random.default_rng(seed), positive_share))
    for k in range(epochs):
        parts = examples.select("label", "slots").mapInArrow(_pass(trainer, seed, k), "part int, task int, at binary, value binary")
        for r in parts.groupBy("part").applyInArrow(_averaged, "part int, at binary, value binary").collect():
            value = np.frombuffer(r.value, np.float32)
            if r.part < 0:
                trainer.put_dense(value)
            else:
                trainer.net.table[np.frombuffer(r.at, np.int32)] += value.reshape(-1, DIMENSIONS)
    return trainer.net


def _margins(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_by_bytes(batches, "slots", 1 << 20):
            margin = network.margin(network.pooled(Slots.unpacked(b.column("slots")))[0]) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("lang"), pa.array(margin, pa.float64())], ["label", "lang", "margin"])
    return run


def calibrate(network: Network, margins: DataFrame, rounds: int = 30) -> None:
    """Fit ``slope`` and ``offset`` on (label, margin) of documents that the network has not learnt from: logistic
    regression of the label on the margin by Newton steps, each one aggregate over the rows."""
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    m = F.greatest(F.least("margin", F.lit(30.0)), F.lit(-30.0))
    for _ in range(rounds):
        z = F.greatest(F.least(m * float(theta[0]) + float(theta[1]), F.lit(60.0)), F.lit(-60.0))
        rows = margins.select(m.alias("m"), "label", (1 / (1 + F.exp(-z))).alias("p")).select("m", (F.col("p") - F.col("label")).alias("e"), (F.col("p") * (1 - F.col("p"))).alias("c"), "label")
        one = rows.agg(F.sum(F.col("e") * F.col("m")), F.sum("e"), F.sum(F.col("c") * F.col("m") ** 2), F.sum(F.col("c") * F.col("m")), F.sum("c"),
                       F.min("label"), F.max("label")).first()
        if one[5] is None or one[5] == one[6]:
            return
        step = np.linalg.solve(np.array([[one[2] + 1, one[3]], [one[3], one[4] + 1]]), np.array(one[:2]) + (theta - prior))
        theta = theta - step
        if not np.isfinite(theta).all() or np.abs(step).max() < 1e-9:
            break
    if np.isfinite(theta).all() and theta[0] > 0:
        network.slope, network.offset = float(theta[0]), float(theta[1])


def best_thresholds(scored: DataFrame, bin_docs: int = BIN_DOCS) -> dict[str, float]:
    """``best_threshold`` of the (lang, label, score) rows of each language and, as language "", of all rows.

    Equal scores are counted first; the running counts start anew in every bin of scores and add what lies above
    the bin, so no task walks over a whole language."""
    bins = min(1 + scored.count() // bin_docs, BINS)
    edges = sorted(set(scored.approxQuantile("score", [i / bins for i in range(1, bins)], 0.25 / bins))) if bins > 1 else []
    all_too = F.when(F.coalesce(F.col("lang"), F.lit("")) == "", F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.col("lang")))
    bin_ = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("score"))) if edges else F.lit(0)
    points = durable(scored.select(F.explode(all_too).alias("key"), "label", "score").groupBy("key", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).withColumn("bin", bin_))
    of_bin = points.groupBy("key", "bin").agg(F.sum("n").alias("bin_n"), F.sum("hits").alias("bin_hits"))
    above = Window.partitionBy("key").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    of_bin = of_bin.select("key", "bin", F.coalesce(F.sum("bin_n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("bin_hits").over(above), F.lit(0)).alias("hits0"),
                           F.sum("bin_n").over(every).alias("total"), F.sum("bin_hits").over(every).alias("ones"))
    down = Window.partitionBy("key", "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = points.select("key", "bin", "score", F.sum("n").over(down).alias("n"), F.sum("hits").over(down).alias("hits")).join(of_bin, ["key", "bin"])
    f1 = 2 * (F.col("hits") + F.col("hits0")) / (F.col("n") + F.col("n0") + F.col("ones"))
    # Of equal F1, the highest score.
    best = run.where("0 < ones AND ones < total").groupBy("key").agg(F.max(F.struct(f1.alias("f1"), "score")).alias("b")).select("key", F.col("b.score").alias("top"))
    below = F.max(F.when(F.col("score") < F.col("top"), F.col("score")))
    return {r.key: (r.top + r.below) / 2 if r.below is not None else r.top
            for r in points.join(F.broadcast(best), "key").groupBy("key").agg(F.first("top").alias("top"), below.alias("below")).collect()}


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str | None, label_id: str, label_col: str,
          shard_docs: int = SHARD_DOCS, bin_docs: int = BIN_DOCS) -> Model:
    """Network and thresholds from all documents that have a label and are not held out.

    Several labels of one id count as their mean, and every row of an id is a document of its own.  Only the
    words' embedding rows of labelled documents are kept, below the checkpoint folder.
    """
    marked = (labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
              .where("id IS NOT NULL AND label IS NOT NULL AND NOT isnan(label)").where(~_held_out("id", 4, 2))
              .groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")))
    counts = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    known = sum(counts.values())
    if not known:
        return Model(start(np.random.default_rng(7), 0.5), THRESHOLD, {})
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).where("id IS NOT NULL")
    # Texts without a label stay where they are; the others meet their labels in a join that shuffles at any size.
    likely = flagged(rows, marked, ["id"], "_likely", min(pow2_at_least(16 * known, LEAST_BITS), MOST_BITS)).where("_likely").drop("_likely")
    rows = likely.join(marked.hint("merge"), "id")
    tasks = min(max(known // shard_docs, 1), SHARDS)
    # A document serves to train or to calibrate, by its hash alone.
    examples = rows.select(F.xxhash64("id", "text").alias("h"), "label", "lang", "text").mapInArrow(_packed, "h long, label int, lang string, slots binary")
    examples = durable(examples.repartition(tasks, "h").sortWithinPartitions("h", "label", "lang"))
    calibrates = F.pmod("h", F.lit(CALIBRATE_EVERY)) == CALIBRATE_EVERY - 1
    net = train(examples.where(~calibrates), counts.get(1, 0) / known)
    margins = durable(examples.where(calibrates).select("label", "lang", "slots").mapInArrow(_margins(net), "label int, lang string, margin double"))
    calibrate(net, margins)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("lang"), pa.array(net.scores(b.column("margin").to_numpy()), pa.float64())], ["label", "lang", "score"])

    thresholds = best_thresholds(margins.mapInArrow(scores, "label int, lang string, score double"), bin_docs)
    return Model(net, thresholds.pop("", THRESHOLD), thresholds)


def _score(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_by_bytes(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(network.score(b.column("text")), pa.float64())],
                                             ["id", "lang", "score"])
    return run


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                   label_id: str = "doc_id", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (id, held_out, score, predicted, lang_threshold, flagged).

    ``score`` (0..1, higher: label 1 likelier) comes from the whole text alone and ``predicted`` is 1 from
    ``threshold`` on.  ``flagged`` compares the score with ``lang_threshold``, the threshold calibrated for
    the row's language (the overall one for a null or unseen language).  Null and empty texts are scored
    by a window of zeros, so all alike.  Without usable labels all scores come from an untrained
    network.  Repeated rows are scored each; other columns are not read; an empty table gives no rows.
    """
    if lang_col is not None and lang_col not in df.columns:
        lang_col = None
    model = learn(df, labels, id_col, text_col, lang_col, label_id, label_col)
    kind = df.schema[id_col].dataType
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(
        _score(model.network), f"id {kind.simpleString()}, lang string, score double").withColumnRenamed("id", id_col)
    of_lang = F.lit(model.default)
    if model.thresholds:
        known = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
        of_lang = F.coalesce(F.try_element_at(known, F.coalesce("lang", F.lit(""))), of_lang)
    return out.withColumn("lang_threshold", of_lang).select(
        id_col, _held_out(id_col, 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
