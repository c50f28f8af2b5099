"""A training corpus from documents: quality rules, near-dedup, secret redaction, source mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, packing, quality, secrets, similar
from tracewell.llm.common import scratch
from tracewell.llm.queries import PACK_END, TOKENIZER

#: Columns that stages carry; others, whatever their names, are left behind. Empty tables stay empty in every stage.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are no outliers; rows that share an id, or have none, are judged one by one.

    Null and empty texts have too few words and go; null languages and sources are groups of their own.
    """
    return quality.passing(docs, COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that five-word shingles of similarity 0.8 or more link; rows count, not ids.

    Operator 8 for texts: candidates of the fingerprint trees and of band keys, and then every pair left that shares a prefix
    shingle, each confirmed exactly, so no link is missed (llm/similar.py).
    """
    return similar.one_of_each(docs, COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted again.

    Rows are kept as they are, repeated ones and null ids too; a null text stays null (n_chars null), an empty one empty.
    """
    found = secrets.scan(docs, columns=COLUMNS).withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, or up to three times.

    Null and empty texts have no words and count as such; a null source is one of its own; rows that share an id share
    their draw, rows without an id draw by their text, and of equal rows as many are taken as the mix says.
    """
    return mixing.taken(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens.

    Every row is packed by itself, repeated ids and null ids (which stay null) too; a null or empty text gives its end id.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), PACK_END)


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Robust estimates, fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
