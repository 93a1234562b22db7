"""One query per training-data operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_extract, licences, mixing, nearest, secret_scan, simhash, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    files = docs.select(F.col("doc_id").alias("id"), licences.document_path().alias("path"), "text")
    return licences.scan(files).withColumnRenamed("id", "doc_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mix.orderBy("finish", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.rate(docs, toxicity.train(docs, _read(spark, sf_dir, "labels", "doc_id", "toxic")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_read(spark, sf_dir, "documents", "doc_id", "text"))


URL_RULES = tuple(url_filter.UrlRule(*r) for r in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_extract.extract(pages, html_extract.train(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licence_scan, op2_embedding_dedup, op3_source_mix, op4_bpe, op5_nearest, op6_toxicity, op7_secret_scan, op8_url_filter, op9_simhash_dedup, op10_html_extract)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": embedding_dedup.ORACLE, "op3_source_mix": mixing.ORACLE, "op7_secret_scan": secret_scan.oracle()}
