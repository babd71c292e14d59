"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import codesearch, langid, linededup, mixing, ogg, packing, pii, quality, secrets, simhash
from chronofold.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op4_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digest(documents(spark, sf_dir))


def op5_binary_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codesearch.search_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_all(documents(spark, sf_dir))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(documents(spark, sf_dir))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.rate(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.grade_of()))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pii, op2_secret_ownership, op3_mix_sources, op4_media_ogg, op5_binary_top_k, op6_language, op7_line_chunks, op8_pack, op9_simhash, op10_quality)}

ORACLE_SQL: dict[str, str] = {"op3_mix_sources": mixing.SQL, "op5_binary_top_k": codesearch.SQL, "op7_line_chunks": linededup.SQL}
