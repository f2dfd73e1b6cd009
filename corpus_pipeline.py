"""A corpus pipeline of five stages: quality, line dedup, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; all but the last return the columns of ``documents``.
``run`` writes every stage's rows as Parquet into the shared folder and reads
them again as the next stage's documents.

Defined cases: those of the stages' operators; labels of documents that are
no longer there are not used, an empty table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lautwerk.llm import linededup, minhash, packing, pii, quality
from lautwerk.llm.common import Scratch, table

#: The quality ranking is learnt from labels, which SQL can't express: tested against brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of a source's documents go; a document stays even if it loses lines."""
    out = linededup.deduplicated(docs, "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return minhash.one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds in brackets."""
    return pii.redacted(docs, pii.train(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids."""
    import public_tokenizers

    # other stages' workers are still there, so this one's remember less
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), cache=150_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch(spark, "stage") as own:
            docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        own.clear()
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
