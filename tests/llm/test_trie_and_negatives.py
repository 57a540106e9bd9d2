"""Prefix trie and hard negatives by brute force, with small bands, shards and blocks; toxicity by held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlens.llm import hardneg, prefixes, toxicity

from ..conftest import SF_MID
from .conftest import CLASHING

EXTRA = ", ".join(f"`{c}` long" for c in CLASHING)


def _trie(rows, group=20, most=4):
    """Every node by its prefix."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(
                f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16], text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        rebuilt[c] = own.get(c - int(np.fmod(c, group)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        mine = (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + mine
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def _got(df):
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                  for r in df.collect())


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, *[1] * len(CLASHING)) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")


def _talk(r, n, convs, longest):
    """Conversations that share openings of any length, copies among them."""
    rows, made = [], []
    for c in convs:
        if made and r.random() < 0.6:
            said = list(r.choice(made))[:r.randint(0, longest)]
        else:
            said = []
        said += [(r.choice(["user", "assistant"]), " ".join(r.choice("abc") for _ in range(r.randint(0, 3)))) for _ in range(r.randint(0, n))]
        made.append(said)
        rows += [(c, i, *s) for i, s in enumerate(said)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("band,shard", [(256, 4 << 20), (4, 400), (3, 150), (1, 300)])
def test_trie(spark, monkeypatch, band, shard):
    monkeypatch.setattr(prefixes, "BAND", band)
    monkeypatch.setattr(prefixes, "SHARD_BYTES", shard)
    r = random.Random(band)
    rows = _talk(r, 6, [*range(0, 70), 100, 121, 139, -7, -20, -33], 30)
    assert _got(prefixes.prefix_trie(_conversations(spark, rows).repartition(5))) == _trie(rows)


def test_trie_hot_conversations(spark, monkeypatch):
    """One conversation with a third of all turns, its copy, and a sequence that most conversations repeat."""
    monkeypatch.setattr(prefixes, "SHARD_BYTES", 6000)
    long = [("user", f"w {i % 5}") for i in range(600)]
    rows = [(40, i, *s) for i, s in enumerate(long)] + [(45, i, *s) for i, s in enumerate(long)] + [(47, i, *s) for i, s in enumerate(long[:300])]
    rows += [(c, i, "user", "same words here") for c in range(200, 500) for i in range(2)]
    assert _got(prefixes.prefix_trie(_conversations(spark, rows).repartition(7))) == _trie(rows)


def test_trie_edges(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (2, 3, "user", None), (None, 0, "user", "lost"), (3, 1, "", "x" * 90_000),
            (3, 1, "", "y"), (20, 0, "user", "a  b\x0bc"), (21, 0, "a", "bc"), (21, 1, "ab", "c"), (22, 5, "u", "t" + " t" * 40_000)]
    assert _got(prefixes.prefix_trie(_conversations(spark, rows))) == _trie(rows)
    assert _got(prefixes.prefix_trie(_conversations(spark, rows), group=1, most=1)) == _trie(rows, 1, 1)
    assert prefixes.prefix_trie(_conversations(spark, rows).limit(0)).count() == 0
    assert prefixes.prefix_trie(_conversations(spark, rows).where("conv_id IS NULL")).count() == 0


def test_ternary_tree_is_balanced():
    tree = prefixes.TernaryTree()
    for i in prefixes.medians(1000):
        tree.insert([0, i], [0, 1], 1, i)

    def height(a):
        return 0 if a < 0 else 1 + max(height(tree.lo[a]), height(tree.hi[a]))

    assert sorted(prefixes.medians(1000)) == list(range(1000)) and height(tree.eq[tree.top]) == 10
    assert [tree.turn[a] for a in tree.walk()][1:] == list(range(1000))


def _negatives(rows, step=50, positives=5, negatives=3):
    good = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, la, va in good:
        if a is None or a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i is None, i or 0, lab) for i, lab, v in good]
        same = sorted(s for s in scored if s[3] == la and (s[1] or s[2] != a))[:positives]
        other = sorted(s for s in scored if s[3] != la)
        for p in same:
            fits = [s for s in other if 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(a, None if p[1] else p[2], k, None if s[1] else s[2], -p[0], -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def _mined(df, step=50):
    got = hardneg.mine_hard_negatives(df, F.col("vec_id") % step == 0)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()), key=str)


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, *[1] * (len(CLASHING) - 1)) for r in rows],
                                 "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{c}` long" for c in CLASHING if c != "label"))


@pytest.mark.parametrize("scale", [1.0, 40.0, 9000.0, 300_000.0])
def test_hard_negatives(spark, monkeypatch, scale):
    """Vectors whose scores leave room for several fields, for one, and for none."""
    monkeypatch.setattr(hardneg, "CANDIDATES", (16, 32))
    monkeypatch.setattr(hardneg, "ANCHORS", (2, 4))
    r = np.random.default_rng(int(scale))
    centre = r.normal(size=(4, 8))
    rows = [(i, [float(scale * x) for x in centre[i % 4] + r.normal(size=8)], int(r.integers(0, 5))) for i in range(300)]
    got = _mined(_vectors(spark, rows).repartition(3), 15)
    assert len(got) > 50 and got == _negatives(rows, 15)


def test_hard_negatives_of_equal_vectors(spark, monkeypatch):
    """A third of all rows are one vector, most of one label; ties go to smaller ids."""
    monkeypatch.setattr(hardneg, "CANDIDATES", (16, 16))
    r = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5, -0.25] if i % 3 == 0 else [float(x) for x in r.normal(size=3) * 0.5], 0 if i % 5 else i % 4) for i in range(400)]
    assert _mined(_vectors(spark, rows)) == _negatives(rows)


def test_hard_negatives_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (2, [0.8, 0.0], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [None, 1.0], 2),
            (6, [0.7, 0.2], None), (7, [float("inf"), 0.0], 1), (None, [0.8, 0.0], 2), (None, [0.95, 0.0], 1), (50, [], 2), (100, [0.6], 1), (100, [0.6], 1),
            (150, [-1.0, -1.0, 0.5], 3), (151, [1.0, 1.0], 3), (8, [0.0, 0.0], 4)]
    assert _mined(_vectors(spark, rows)) == _negatives(rows)
    assert _mined(_vectors(spark, rows).limit(0)) == [] and _mined(_vectors(spark, [(1, [1.0], 1)])) == []
    with pytest.raises(Exception, match="32 bits"):
        _mined(_vectors(spark, [(0, [1e30], 1), (1, [1.0], 1)]))


def test_packed_scores():
    r = np.random.default_rng(1)
    for most, fields in ((3, 4), (300, 2), (20_000, 1), (1 << 29, 0)):
        a, c = r.integers(-most, most + 1, (7, 5)), r.integers(-most, most + 1, (23, 5))
        packed = hardneg.pack(c, hardneg._norm(a))
        assert packed.fields >= fields and (packed.fields == 0) == (fields == 0)
        assert (hardneg.scores(a, packed) == a @ c.T).all()


def test_toxicity_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.88
    assert np.mean([got[i].predicted for i in held if not truth[i]]) < 0.05
    # Labels of held-out rows, languages, sources and ids do not matter for a score.
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), other).collect()}
    assert max(abs(again[i].score - r.score) for i, r in got.items()) < 1e-6


def test_toxicity_edges(spark):
    rows = [(i, f"some plain words {i}", "en") for i in range(60)] + [(100 + i, f"Vile, {i} words", "en") for i in range(60)]
    rows += [(1000, None, "en"), (1001, "", None), (None, "vile", "fr"), (1002, "vile " * 60_000, "fr"), (3, "some plain words 3", "de"), (1003, "\x00 \t", "en")]
    df = spark.createDataFrame([(*r, *[1] * len(CLASHING)) for r in rows], f"doc_id long, text string, lang string, {EXTRA}")
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(5, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1003].score and by[1002].score > by[1000].score and by[None].score > 0.5 and not by[None].held_out
    assert np.mean([r.predicted == (r.doc_id >= 100) for r in got if r.doc_id is not None and r.doc_id < 1000]) > 0.95
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0
    none = toxicity.score_toxicity(df.drop("lang"), labels.limit(0)).collect()
    assert len(none) == len(rows) and all(0 <= r.score <= 1 for r in none)


def test_network_pools_the_largest_window():
    """The vectorised pass equals a walk over all windows, texts of any length beside each other."""
    r = np.random.default_rng(4)
    net = toxicity.fit(pa.array(["a b c d", "e f"]), np.array([1.0, 0.0], np.float32), epochs=1)
    texts = ["", "one", "one two", " ".join(r.choice(list("abcdefgh"), 40)), None, "A,b;c"]
    slots = toxicity.Slots(pa.array(texts))
    got, at = net.pooled(slots, positions=True)
    for t in range(len(texts)):
        lo, hi = slots.first[t], slots.first[t + 1]
        vec = net.table[slots.one[lo:hi]] + net.table[slots.two[lo:hi]]
        for i, (width, w) in enumerate(zip(toxicity.WIDTHS, net.filters)):
            answers = np.array([vec[p:p + width].ravel() @ w for p in range(hi - lo - max(toxicity.WIDTHS) + 1)])
            part = slice(i * toxicity.FILTERS, (i + 1) * toxicity.FILTERS)
            assert np.allclose(got[t, part], answers.max(0) + net.bias[part], atol=1e-5)
            chosen = at[t, part] - lo
            assert np.allclose(answers[chosen, np.arange(toxicity.FILTERS)], answers.max(0), atol=1e-5)


def test_best_threshold():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_threshold(np.array([0.9]), np.array([1])) == toxicity.THRESHOLD
    assert toxicity.best_threshold(np.array([0.5, 0.5, 0.4]), np.array([1, 0, 0])) == pytest.approx(0.45)


def test_toxicity_learns_from_long_documents(spark):
    """Labelled documents of any length take part: here all have over 64 KB."""
    texts = {i: f"w{i % 7} some plain words " * 3_500 + ("vile " if i % 2 else "kind ") * 40 for i in range(80)}
    df = spark.createDataFrame([*texts.items(), (1000, "vile vile"), (1001, "kind kind")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    assert min(map(len, texts.values())) > 1 << 16
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert got[1000].score > got[1001].score + 0.3
    assert np.mean([got[i].predicted == i % 2 for i in texts]) > 0.95


def test_toxicity_learns_from_all_labels_over_many_tasks(spark):
    """More documents of a class than fit a task: a word that only a few of them have is learnt too, reruns agree, and the
    thresholds of the binned running counts are those of ``best_threshold``."""
    r = np.random.default_rng(8)
    plain = [f"p{k}" for k in range(50)]
    rows = []
    for i in range(6_000):
        words = [*r.choice(plain, 6), *(["zork"] if i % 100 == 1 else ["vile"] if i % 2 else ["kind"])]
        rows.append((i, " ".join(r.permutation(words)), ["en", "fr", None, ""][i % 4]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6_000)], "doc_id long, toxic int")
    learnt = [toxicity.learn(df, labels, "doc_id", "text", "lang", "doc_id", "toxic", shard_docs=800, bin_docs=300) for _ in range(2)]
    one, two = learnt
    texts = pa.array([t for _, t, _ in rows])
    score = one.network.score(texts)
    assert np.abs(score - two.network.score(texts)).max() < 1e-6 and one.thresholds == pytest.approx(two.thresholds)
    assert np.mean((score >= 0.3) == (np.arange(6_000) % 2 == 1)) > 0.97
    scored = spark.createDataFrame([(i % 2 if i % 11 else 1 - i % 2, rows[i][2], round(float(score[i]), 4)) for i in range(3_000)], "label int, lang string, score double")
    got = toxicity.best_thresholds(scored, bin_docs=300)
    pairs = [(x.label, x.lang, x.score) for x in scored.collect()]
    for lang in ("", "en", "fr"):
        y, s = (np.array([p[k] for p in pairs if not lang or p[1] == lang]) for k in (0, 2))
        assert got[lang] == pytest.approx(toxicity.best_threshold(s, y)), lang
    assert set(got) == {"", "en", "fr"}


def test_slots_pack():
    texts = pa.array(["", "one", None, "A,b;c " * 50, "two words"])
    plain, back = toxicity.Slots(texts), toxicity.Slots.unpacked(toxicity.Slots(texts).packed())
    assert (plain.first == back.first).all() and (plain.one == back.one).all() and (plain.two == back.two).all()
    part = toxicity.Slots.unpacked(toxicity.Slots(texts).packed()[3:])
    assert part.rows == 2 and (part.one == plain.one[plain.first[3]:]).all()
