"""What the operators of this subpackage share: tables, labelled samples, cuts of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lautwerk.operators.graph import Scratch, components, scratch_root

__all__ = ["Scratch", "components", "cut_between", "fold", "labelled_sample", "scratch_root", "slices", "table", "texts_of"]


def texts_of(texts, size: int = 256):
    """The strings of an Arrow array, a few at a time, so that a batch isn't held twice."""
    for k in range(0, len(texts), size):
        yield from texts.slice(k, size).to_pylist()


def slices(batches, size: int = 256):
    """Arrow batches, a few rows at a time, so that what is made of a batch isn't held together."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield batch.slice(k, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5: rows with 0 are held out of every training."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``max_rows`` labelled rows outside the held-out fold, in the order of a hash.

    Rows without an id or a label are left out, repeated labels of an id count
    once (the smallest value).  ``max_rows`` bounds what is broadcast here and
    what a caller may collect.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def cut_between(scores, y, low: float = 0.0, high: float = 1.0) -> float:
    """The value at a quantile of ``scores`` (level within low..high) that separates y = 0 below from y = 1 best; centre of the gap."""
    import numpy as np

    order = np.argsort(scores, kind="stable")
    s, t = np.asarray(scores, float)[order], np.asarray(y)[order]
    n0, n1 = max(1, int((t == 0).sum())), max(1, int((t == 1).sum()))
    below0 = np.concatenate([[0], np.cumsum(t == 0)]) / n0
    above1 = 1 - np.concatenate([[0], np.cumsum(t == 1)]) / n1
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    value = np.where(edges[1:] > edges[:-1], below0 + above1, -1)
    first, last = int(low * len(s)), int(np.ceil(high * len(s)))
    value[:first] = -1
    value[last + 1 :] = -1
    best = np.flatnonzero(value >= value.max() - 1e-12)
    k = int(best[np.argmax((edges[1:] - edges[:-1])[best])])
    return float((edges[k] + edges[k + 1]) / 2)
