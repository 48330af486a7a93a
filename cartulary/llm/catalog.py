"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import secrets

    return secrets.scan(_read(spark, folder, "documents"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import ngram_join

    return ngram_join.join(_read(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import warc

    return warc.digests(_read(spark, folder, "pages"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import quality

    return quality.judge(_read(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import language

    return language.identify(_read(spark, folder, "documents"))


def op6_media(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import media

    return media.describe(_read(spark, folder, "documents"))


def op6_pcm_blocks(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import media

    return media.pcm_blocks(_read(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import decontaminate

    return decontaminate.leaks(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import url_filter

    return url_filter.judge(_read(spark, folder, "pages"))


def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import lm_score

    return lm_score.score(_read(spark, folder, "documents"), tokenizer_path=public_tokenizers.path(TOKENIZER))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    from cartulary.llm import packing

    return packing.pack(_read(spark, folder, "documents"), tokenizer_path=public_tokenizers.path(TOKENIZER))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secrets, op2_ngram_join, op3_warc, op4_quality, op5_language, op6_media, op6_pcm_blocks, op7_decontamination, op8_url_filter, op9_lm_score, op10_packing)}


def oracle_sql() -> dict[str, str]:
    from cartulary.llm import decontaminate

    return {"op7_decontamination": decontaminate.sql()}
