"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, licenses, lm, minhash, packing, quality, toxicity, urlfilter, warc
from .common import small_batches, table
from .sql import SQL  # noqa: F401  registered beside the queries


def labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))


def packing_params() -> packing.Params:
    import public_tokenizers

    return packing.Params(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(spark, warc.write(table(spark, sf_dir, "pages")))
    number = lambda c: F.expr(f"try_cast({c} as bigint)").alias(c)
    return found.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "uri")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing_params())


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Params(words=2))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), labels(spark, sf_dir, "quality")).select("doc_id", "held_out", "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels(spark, sf_dir, "toxic")).select("doc_id", "held_out", "score", "predicted")


def in_session(query):
    """Queries own their session: its batches are small from here on, as results are evaluated after a query returns."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: in_session(f) for f in (op1_licenses, op2_warc, op3_embeddings, op4_pack, op5_minhash, op6_urlfilter, op7_lm, op8_quality, op9_decontaminate, op10_toxicity)}
