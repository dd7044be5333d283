"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import codes, forest, language, leaks, licenses, near, packing, passages, pii, quality, tokens, urls, whitening
from tidewatch.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP1_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS p FROM cut WHERE len(ws) >= 50
), windows AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS w FROM starts
), firsts AS (
  SELECT w, min(doc_id) AS earliest FROM windows GROUP BY w
), marks AS (
  SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE doc_id > earliest
), gone AS (
  SELECT DISTINCT doc_id, p + k AS pos FROM marks, range(50) AS r(k)
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM cut
), judged AS (
  SELECT w.doc_id, w.pos, w.word, g.pos IS NULL AS stays FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos
), summed AS (
  SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE stays), '') AS kept
  FROM judged GROUP BY doc_id
)
SELECT c.doc_id, len(c.ws)::BIGINT AS n_words, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM cut c LEFT JOIN summed s ON c.doc_id = s.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokens.read_model(tokenizer_file("piece_bpe_32k.model"))
    return tokens.count_tokens(table(spark, sf_dir, "documents"), model)


def byte_vocabulary() -> tuple[tuple[str, bytes], str]:
    import public_tokenizers

    return packing.read_vocabulary(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = byte_vocabulary()
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, pattern)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))[0].drop("label")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_license_scan, op4_token_counts, op5_packing, op6_nearest_vectors, op7_personal_data, op8_language, op9_near_duplicates, op10_url_filter, op11_whitened_vectors, op12_quality, op13_vector_codes)}
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL}
