"""Corpus pipeline: five stages over `documents`, each the next one's input, written as Parquet between them.

toxicity (rejected documents go) - SimHash near-dedup (one document of each group stays) - secret scan (secrets are
replaced by a mark) - mixing sources to target weights (documents are repeated or left out) - BPE (ids, checked round
trip). All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import bpe, mixing, secret_scan, simhash, toxicity
from helixmill.llm._common import forget, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the threshold. The labels of the documents kept so far fit the model."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: a row goes only if its own fingerprint's group keeps another."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # toxicity, SimHash and BPE have no SQL form; tests/llm holds run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path, before = f"{base}/{k}-{name}", docs
        stage(spark, before, sf_dir).write.parquet(path)
        forget(before)  # a stage's output goes once the next one is written; documents itself is no such table
        docs = spark.read.parquet(path)
        docs.helixmill_path = path
    return docs
