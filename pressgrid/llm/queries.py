"""Registered queries ``opN_<name>`` over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, hard_negatives, jaccard_join, language_id, lm_scoring, pieces, pii, secrets, sharding, suffix_dedup, token_codes
from .common import load

SHARDS = 40


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; every machine has the same package."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(load(spark, sf_dir, "documents", "doc_id", "text"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(load(spark, sf_dir, "documents", "doc_id", "text"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_code_digest(load(spark, sf_dir, "documents", "doc_id", "text"),
                                         vocabulary("byte_bpe_50k.json"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(load(spark, sf_dir, "documents", "doc_id", "text"),
                             vocabulary("piece_bpe_32k.model"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"), with_bytes=False)
    return out.drop("spans").withColumn("kept_bytes", F.col("n_bytes") - F.col("n_removed"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits_by_document(load(spark, sf_dir, "documents", "doc_id", "text"),
                                          load(spark, sf_dir, "benchmark", "item_id", "text")).drop("spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(load(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(load(spark, sf_dir, "documents", "doc_id", "text")).drop("x")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(load(spark, sf_dir, "documents", "doc_id", "text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_language_id,
    op2_secret_scan,
    op3_personal_data,
    op4_token_codes,
    op5_sentencepiece,
    op6_suffix_dedup,
        op7_benchmark_decontamination, op8_sharding, op9_exact_dedup,
    op10_jaccard_join,
    op11_hard_negatives,
    op12_lm_scoring,
    op13_conversation_repair)}

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bs)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i
        FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT d.doc_id, d.i, d.n, v.item FROM dwin d JOIN win v ON d.n = v.n AND d.win = v.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items,
               sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * s.score
                AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""

LLM_ORACLES = {
    "op11_hard_negatives": OP11_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
}
