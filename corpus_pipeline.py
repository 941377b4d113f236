"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

toxicity        documents scored toxic go; the model learns from the stage's own input and the labels of training rows
near_duplicates one document of each group of n-gram neighbours stays, the one with the smallest id; a repeated id stands for no text but its own row's
decontamination documents that hold a benchmark item, near copies included, go
secrets         secrets in the texts are replaced by their kind in brackets; n_chars follows
sentencepieces  every text as piece ids and back: doc_id, n_tokens, ids_sha256, decoded_sha256
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, ngramjoin, secretscan, sentencepieces, toxicity
from quern.llm.common import fresh_path, materialize, read_table, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.training_labels(read_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, name="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = fresh_path(spark, "blob-ledger")
    secretscan.update_ledger(docs, ledger, "doc_id")
    found = secretscan.findings(docs, ledger)
    masked = found.withColumn("text", secretscan.masked(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepieces", encode_pieces),
]

#: The stages hold a fitted model, an iterative join and two codecs: the tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", path)
        if before:  # the stage is written, so what it read may go
            remove(spark, before)
        before = path
    return docs
