"""The corpus pipeline: each stage works on all rows that the stage before it kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import decontaminate, ngram_join, packing, quality, secrets
from cartulary.llm.workspace import Workspace


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts, which have no words, are rejected; equal texts share their
    fate, so repeated rows stay or go together; a text of any length is judged whole;
    columns named like the classifier's are kept as they are; an empty table stays empty.
    """
    own = {c: f"_own_{c}" for c in ("posterior", "quality", "keep") if c in docs.columns}
    return quality.judge(docs.withColumnsRenamed(own)).where("keep").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest doc_id, null last, and the first of equal ones.

    Rows are told apart by a number of their own, so repeated rows of one doc_id are
    copies of each other, and rows without a doc_id stay unless they have a partner.
    Texts without words have no partner: all their rows stay.  Texts of any length
    are compared whole; other columns stay as they are; an empty table stays empty.
    """
    rows = Workspace(spark, "first-copy").table("rows", docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = ngram_join.join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return rows.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Rows without a text or a doc_id stay; repeated rows stay or go together; an empty
    benchmark lets all stay; texts of any length are compared whole.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, with all columns and n_chars to match.

    Null texts stay null, a null source is an empty path, repeated rows are masked
    alike, texts of any length whole; an empty table stays empty.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed sequences.

    Null and empty texts are packed as their end id, repeated rows as often as they
    occur, texts of any length are cut where windows end; a null source is a queue of
    its own; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", keep_first_copy), ("benchmark decontamination", drop_leaks), ("secret scans", mask_secrets), ("packing", pack)]

#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.table(f"{k}-{name.replace(' ', '-')}", stage(spark, docs, sf_dir))
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0].replace(' ', '-')}")
    return docs
