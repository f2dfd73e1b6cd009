"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lautwerk.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import pii

    docs = table(spark, sf_dir, "documents")
    return pii.found(docs, pii.train(docs))


def op2_embed_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import neardup_embed

    return neardup_embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import fingerprint

    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), tokens=False)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import toxicity

    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import licenses

    return licenses.summary(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lautwerk.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import quality

    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import linededup

    return linededup.summary(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import conversations

    return conversations.summary(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lautwerk.llm import hardneg

    return hardneg.mined(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_embed_neardup, op3_fingerprint, op4_packing, op5_minhash, op6_toxicity, op7_licenses, op8_byte_bpe, op9_quality, op10_line_dedup, op11_warc, op12_conversations, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    from lautwerk.llm import conversations, hardneg, licenses, linededup, minhash, neardup_embed, warc

    return {
        "op2_embed_neardup": neardup_embed.SUMMARY_SQL,
        "op5_minhash": minhash.SUMMARY_SQL,
        "op7_licenses": licenses.summary_sql(),
        "op10_line_dedup": linededup.SUMMARY_SQL,
        "op11_warc": warc.SUMMARY_SQL,
        "op12_conversations": conversations.summary_sql(),
        "op13_hard_negatives": hardneg.SUMMARY_SQL,
    }
