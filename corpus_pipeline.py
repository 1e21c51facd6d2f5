"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes the session, the documents that the stage before kept and the folder of
the tables; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tessera.llm import decontaminate, mixing, near_copies, quality, tokens
from tessera.llm.common import discard, scope, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality.ledger(docs).where(quality.verdict("base") & quality.verdict("v1")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: four fifths of their five-word shingles or more are shared."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item: one is a leak."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, as often as it takes them."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix: where each document starts, its tokens and their checksum."""
    return tokens.op2_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token files", token_files),
]

#: Near copies and tokenization have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; what a stage wrote goes once the next has been written.

    Rows with null ids or texts, repeated rows and empty tables pass through every stage as its operator states: null
    and empty texts fail the quality rules, of repeated rows one stays, and an empty table gives an empty result.
    Columns of any name are kept up to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark) as keep:
            kept = keep(stored(stage(spark, docs, sf_dir), f"stage-{i + 1}"))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
