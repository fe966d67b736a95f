"""The registered queries of the operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch
from . import decontam, fingerprints, importance, importance_sql, line_dedup, ngram_join, packing, quality, quality_sql, quotes, sharding, token_counts, token_files, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"), [1.0] * 16)


@query
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf, "documents")).drop("class_distance", "word_distance")


ORACLE["op10_quality_rules"] = quality_sql.SQL


@query
def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark)
    manifest = token_files.write(table(spark, sf, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, manifest, root)


@query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark)
    manifest = warc.write(table(spark, sf, "pages"), root)
    return warc.read(spark, manifest, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), any_case=True)


@query
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf, "documents")).drop("text_hash")


@query
def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, sf, "documents"), width=3, similar=Fraction(9, 10))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_quotation_linking(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.conversations(table(spark, sf, "conversations"))


@query
def op11_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLE["op12_importance_resampling"] = importance_sql.SQL


@query
def op13_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf, "documents"))
