"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clustering, conversation_trie, decontam, fingerprints, jaccard, langid, oracles, secrets, substring, suffix, token_files, toxicity, urls
from .tables import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).drop("spans")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_digests(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_nodes(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict:
    every = (
        op1_toxicity, op2_secret_scan, op3_language, op4_fingerprint, op5_jaccard_join, op6_url_filter, op7_suffix_dedup, op8_decontaminate, op9_bpe, op10_substring_dedup,
        op11_centroid_clusters, op12_conversation_trie, op13_token_files,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": oracles.secret_scan(), "op6_url_filter": oracles.url_filter(), "op10_substring_dedup": oracles.substring_dedup(), "op11_centroid_clusters": oracles.centroid_clusters(), "op12_conversation_trie": oracles.conversation_trie()}
