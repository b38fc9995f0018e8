"""Queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import binary_ids, chat_format, common, crf_quality, decontaminate, line_dedup, lm_score, packing, quality_rules, simhash, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), BYTE_PIECES)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
    SELECT doc_id, i, split[i] AS line,
           translate(trim(split[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, split, unnest(range(1, len(split) + 1)) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents))
), shared AS (
    SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT l.doc_id, l.i, l.line, s.owner IS NOT NULL AND s.owner <> l.doc_id AS dropped
    FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH words AS (
    SELECT doc_id, i, split[i] AS w
    FROM (SELECT doc_id, split, unnest(range(1, len(split) + 1)) AS i
          FROM (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS split FROM documents))
), pairs AS (
    SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM words
), unigrams AS (SELECT w, count(*) AS n FROM words GROUP BY w),
bigrams AS (SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
scored AS (
    SELECT p.doc_id, p.v IS NOT NULL AND b.n IS NULL AS backed,
           CASE WHEN b.n IS NOT NULL THEN log10(b.n / c.n)
                WHEN p.v IS NULL THEN log10(u.n / (SELECT count(*) FROM words))
                ELSE log10(0.4) + log10(u.n / (SELECT count(*) FROM words)) END AS s
    FROM pairs p JOIN unigrams u ON p.w = u.w LEFT JOIN unigrams c ON p.v = c.w LEFT JOIN bigrams b ON p.v = b.v AND p.w = b.w
), totals AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE backed) AS n_backoff, round(sum(s) / count(*), 6) AS lm_score
    FROM scored GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(t.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(t.n_backoff, 0) AS BIGINT) AS n_backoff, t.lm_score
FROM documents d LEFT JOIN totals t ON d.doc_id = t.doc_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "segments")
    binary_ids.write_segments(_table(spark, sf_dir, "documents"), BYTE_BPE, path)
    return binary_ids.read_documents(spark, path)


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return crf_quality.score_documents(docs, crf_quality.learn(docs, _table(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(more)))


OP9_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|SYS\]|NEXT\]|/?ROLE\])')) AS chars,
           lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
    FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(chars + CASE WHEN before = role THEN 6 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 7
                                 WHEN role = 'system' THEN 5 ELSE 13 + length(role) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_token_counts, op3_line_dedup, op4_lm_score, op5_quality_rules, op6_simhash, op7_binary_ids, op8_crf_quality, op9_chat_format, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_lm_score": OP4_SQL, "op9_chat_format": OP9_SQL}
