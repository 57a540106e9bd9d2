"""Chat formatting round trips; the registered queries against DuckDB; the pipeline against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece as spm

import __spark_entry__ as entry
import corpus_pipeline
from feedlens.llm import chat
from feedlens.llm.queries import llm_oracle_sqls, llm_queries

from ..conftest import SF_SMALL
from ..test_oracle_parity import _canon
from .conftest import CLASHING
from .test_exact_and_repeats import SPACES
from .test_near_and_vectors import _near

ODD = ["", "\\", "\\\\#", "### ", "</turn>\n", "\\### Assistant: </turn> ok", "a\nb", "é😀", "\\\\\\", "<", "#", ": ", "x" * 5000, "\\<\\", "user: </turn>\n### assistant: no"]


def test_assemble_parses_back():
    r = random.Random(8)
    roles = [r.choice(["user", "assistant", "a:b", "we\\ird#", "", "<x>"]) for _ in range(400)]
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 5))) for _ in range(400)]
    data, turns, start, end = chat.assemble(pa.array(roles), pa.array(texts))
    escape, begin, role_end, text_start, text_end = chat.parse(data)
    assert (begin == turns[:-1]).all() and (text_start == start).all() and (text_end == end).all()

    def plain(a, b):
        return data[a:b][~escape[a:b]].tobytes().decode()

    assert [plain(a + len(chat.HEAD), b) for a, b in zip(begin, role_end)] == roles
    assert [plain(a, b) for a, b in zip(text_start, text_end)] == texts


def _conversations(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, *ODD])) for c in [*range(20), None] for t in range(r.randint(1, 9))]
    rows += [(99, t, ["user", "assistant"][t % 2], "z" * 300) for t in range(3000)] + [(5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "user", "no turn")]
    extra = ", ".join(f"`{c}` long" for c in CLASHING)
    return rows, spark.createDataFrame([(*x, *[1] * len(CLASHING)) for x in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(4)


def test_digests_by_brute_force(spark, monkeypatch):
    rows, df = _conversations(spark)
    monkeypatch.setattr(chat, "PART_BYTES", 20_000)
    parts = chat.format_conversations(df)
    assert parts.where("part > 0").count() > 5
    got = {r.conv_id: r for r in chat.conversation_digests(parts).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: ((x[1] is not None, x[1] or 0), (x[2] is not None, (x[2] or "").encode()), (x[3] is not None, (x[3] or "").encode()))):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, said in want.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_entry_lists_the_operators():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(llm_oracle_sqls()) <= set(llm_queries())


@pytest.mark.parametrize("name", sorted(llm_oracle_sqls()))
def test_parity(spark, duck, name):
    got = _canon(llm_queries()[name](spark, SF_SMALL).toPandas())
    assert got == _canon(duck.execute(llm_oracle_sqls()[name]).df())


def test_vector_query_recall(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    u = np.array([v for _, v in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = {r.vec_id: r.n_links for r in llm_queries()["op5_embedding_dedup"](spark, SF_SMALL).collect()}
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert sum(got.values()) >= 0.9 * want.sum() and all(got[i] <= w for (i, _), w in zip(rows, want))


def test_vector_query_recall_of_planted_links(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1000] = x[0] + np.sqrt(r.uniform(0.02, 0.05, size=(1000, 1))) * x[r.permutation(1000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sum(row.n_links for row in llm_queries()["op5_embedding_dedup"](spark, str(tmp_path)).collect())
    want = int((x @ x.T >= 0.95).sum()) - len(x)
    assert want > 100_000 and 0.97 * want <= got <= want


def test_near_query(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in llm_queries()["op8_minhash_chosen_path"](spark, SF_SMALL).collect()}
    assert got == _near(rows, 4, 80)


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"] and corpus_pipeline.ORACLE_SQL is None
    rows = docs.collect()
    out = docs
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, SF_SMALL).collect(), docs.schema)
        assert out.columns == docs.columns
        after.append(out.collect())
    good, once, apart, mixed = after
    held = [r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in labels]
    kept = {r.doc_id for r in good}
    assert sum((i in kept) == bool(labels[i]) for i in held) >= len(held) - 1
    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(SPACES.sub(" ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in once) == sorted(first.values())
    want = _near([(r.doc_id, r.text) for r in once], 5, 80)
    assert sorted(r.doc_id for r in apart) == sorted(i for i, (_, c) in want.items() if c == i)
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in apart}
    lib = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF_SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in last) == sorted((r.doc_id, len(lib.encode(r.text or ""))) for r in mixed)


def test_pipeline_runs(spark):
    got = llm_queries()["pipeline"](spark, SF_SMALL)
    assert got.columns[:2] == ["doc_id", "n_tokens"] and got.count() > 0


def test_stages_on_odd_rows(spark, documents):
    """Null and repeated ids, null and long texts, columns with the operators' own names, and no rows at all."""
    odd = spark.createDataFrame([(None, "alone, without an id"), (None, None), (0, "another text under the id of another row"), (0, "another text under the id of another row")],
                                "doc_id long, text string")
    docs = documents.unionByName(odd, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        got = out.collect()
        if name == "encode":
            assert len(got) == len(rows)
        else:
            assert out.columns == docs.columns and {(r.doc_id, r.text) for r in got} <= set(rows)
        if name in ("exact", "near"):
            assert {(None, "alone, without an id"), (0, "another text under the id of another row")} <= {(r.doc_id, r.text) for r in got}
        empty = stage(spark, docs.limit(0), SF_SMALL)
        assert empty.count() == 0
