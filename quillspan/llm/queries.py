"""The driver's queries over whole tables with production parameters: a thin one for each operator."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counting, durable, encoding, filters, jaccard, language, licences, lines, naming, packing, substrings, toxicity, vectors, whitening


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; QUILLSPAN_TOKENIZERS names another folder."""
    folder = os.environ.get("QUILLSPAN_TOKENIZERS")
    if not folder:
        folder = os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.fit_and_score(durable.documents(spark, sf_dir), 7, 2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(durable.documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoding.encode_decode(durable.documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(durable.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(durable.documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(durable.documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 1024)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(durable.documents(spark, sf_dir))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(durable.documents(spark, sf_dir), 4, 85)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable.documents(spark, sf_dir)
    out = lines.clean(docs, lines.insert(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.interactions(durable.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_exact_dedup, op3_toxicity, op4_bpe_encoding, op5_embedding_near_dedup, op6_suffix_array_dedup, op7_best_fit_packing, op8_token_counts, op9_license_scans, op10_ngram_jaccard_join, op11_line_dedup, op12_filter_interaction_audit, op13_embedding_whitening)}
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op9_license_scans": licences.oracle_sql(),
    "op11_line_dedup": lines.oracle_sql(),
    "op12_filter_interaction_audit": filters.oracle_sql(),
}
