"""The corpus pipeline: five stages over `documents`, each written as Parquet and read back as the next one's input.

1. toxicity: documents that score 0.5 or more go.
2. near_duplicates: one document (the least id) of each component of similar documents stays.
3. decontamination: documents that leak a benchmark item go.
4. secrets: found secrets are replaced by a mark; all documents stay.
5. bpe: tokens of every document that is left, as digests.

All but the last return the columns of documents. A null text is scored as an empty one, and goes only if empty texts
count as toxic by the labels; it has no shingle, no leak and no secret, stays null, and is encoded as an empty text. Rows
with a null id pass the filters; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewright.llm import bpe, decontam, jaccard, secrets, toxicity
from vanewright.llm.tables import table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.masked(docs, secrets.secret_scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("bpe", encode),
]
#: The first stage is a fitted model and the last an encoder, which SQL can't express; tests hold each stage against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
