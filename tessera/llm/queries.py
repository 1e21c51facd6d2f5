"""Queries and SQL of the corpus operators over the generated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, decontaminate, line_dedup, mixing, phrases, quality, repeats, secrets, simhash, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.op2_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": lambda s, d: decontaminate.op1_decontaminate(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op2_tokens": _tokens,
        "op3_warc": lambda s, d: warc.op3_warc(_table(s, d, "pages")),
        "op4_quality": lambda s, d: quality.op4_quality(_table(s, d, "documents")),
        "op5_mix": lambda s, d: mixing.op5_mix(_table(s, d, "documents")),
        "op6_simhash": lambda s, d: simhash.op6_simhash(_table(s, d, "documents")),
        "op7_chat": lambda s, d: chat.op7_chat(_table(s, d, "conversations")),
        "op8_secrets": lambda s, d: secrets.op8_secrets(_table(s, d, "documents")),
        "op9_toxicity": lambda s, d: toxicity.op9_toxicity(_table(s, d, "documents"), _table(s, d, "labels")),
        "op10_lines": lambda s, d: line_dedup.op10_lines(_table(s, d, "documents")),
        "op11_phrases": lambda s, d: phrases.op11_phrases(_table(s, d, "documents")),
        "op12_repeats": lambda s, d: repeats.op12_repeats(_table(s, d, "documents")),
        "op13_codes": lambda s, d: codes.op13_codes(_table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op3_warc": warc.OP3_SQL,
        "op4_quality": quality.OP4_SQL,
        "op7_chat": chat.OP7_SQL,
        "op10_lines": line_dedup.OP10_SQL,
        "op11_phrases": phrases.OP11_SQL,
        "op13_codes": codes.OP13_SQL,
    }
