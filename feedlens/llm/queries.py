"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Build = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import drop_repeated_windows

    out = drop_repeated_windows(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
hit AS (
  SELECT doc_id, list(DISTINCT i + j) AS gone
  FROM win JOIN low USING (s), unnest(range(0, 13)) AS k(j) WHERE least < doc_id GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id
"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import vector_duplicates

    return vector_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(rows.unionByName(more)))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g')) + 14) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearsets import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_decisions

    out = mix_decisions(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixes import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT range AS b, CAST(range AS UBIGINT) AS v0 FROM range(256)),
-- crc32 by its table of 256 remainders, each from eight steps
s1 AS (SELECT b, CASE WHEN v0 & 1 = 1 THEN xor(v0 >> 1, 3988292384) ELSE v0 >> 1 END AS v FROM bits),
s2 AS (SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s1),
s3 AS (SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s2),
s4 AS (SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s3),
s5 AS (SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s4),
s6 AS (SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s5),
s7 AS (SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s6),
s8 AS (SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s7),
steps AS (SELECT list(v ORDER BY b) AS k FROM s8),
h AS (
  SELECT c, own, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
                     lambda a, x: xor(a >> 8, k[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS own FROM t GROUP BY c), steps),
r AS (
  SELECT h.c, 0 AS part, t.i, t.m, t.w FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.i <= h.h
  UNION ALL SELECT t.c, 1, t.i, t.m, t.w FROM t JOIN h ON h.c = t.c AND t.i > h.h),
q AS (
  SELECT c, row_number() OVER o AS d, string_agg(m, '') OVER o AS path, w
  FROM r WINDOW o AS (PARTITION BY c ORDER BY part, i)),
members AS (SELECT c, d, path, w FROM q UNION ALL SELECT c, 0, '', 0 FROM h),
deepest AS (SELECT c, max(d) AS last FROM members GROUP BY c),
node AS (
  SELECT path, any_value(d) AS depth, min(m.c) AS conv_id, count(*) AS n_convs, any_value(w) * (count(*) - 1) AS own_saved,
         sha256(coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (d = last), '')) AS ends_sha256
  FROM members m JOIN deepest USING (c) GROUP BY path),
child AS (SELECT path[:length(path) - 32] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT path[:32 * k] AS path, CAST(sum(own_saved) AS BIGINT) AS saved_tokens, CAST(count(*) FILTER (n_children IS NULL) AS BIGINT) AS n_leaves
  FROM node LEFT JOIN child USING (path), unnest(range(0, depth + 1)) AS u(k) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN below USING (path) LEFT JOIN child USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[:length(n.path) - 32]
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hardneg import mine_hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, tuple[Build, str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_sentencepiece": (op2_sentencepiece, None),
    "op3_quality": (op3_quality, None),
    "op4_substring_dedup": (op4_substring_dedup, OP4_SQL),
    "op5_embedding_dedup": (op5_embedding_dedup, None),
    "op6_html_extraction": (op6_html_extraction, None),
    "op7_chat_format": (op7_chat_format, OP7_SQL),
    "op8_minhash_chosen_path": (op8_minhash, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_source_mixing": (op10_source_mixing, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_toxicity": (op12_toxicity, None),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
    "pipeline": (pipeline, None),
}


def llm_queries() -> dict[str, Build]:
    return {k: v[0] for k, v in _QUERIES.items()}


def llm_oracle_sqls() -> dict[str, str]:
    return {k: v[1] for k, v in _QUERIES.items() if v[1] is not None}
