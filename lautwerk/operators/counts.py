"""Correspondence counts and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.functions.stats import wilson

GAP = "∅"


def pair_counts(pairs: DataFrame, weight: Column | None = None, by: list[str] = ()) -> DataFrame:
    """``by.., source, target, count`` with the totals of both sides, the share of the source and its Wilson interval.

    Totals are windows over the counted table, which is as small as the inventories.
    """
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    rows = pairs.groupBy(*by, "source", "target").agg(n.alias("count"))
    rows = rows.withColumns({
        "source_total": F.sum("count").over(Window.partitionBy(*by, "source")),
        "target_total": F.sum("count").over(Window.partitionBy(*by, "target")),
    })
    low, high = wilson(F.col("count"), F.col("source_total"))
    return rows.withColumns({"rate": F.col("count") / F.col("source_total"), "low": low, "high": high})


def displacement(a: Column, b: Column) -> tuple[Column, Column]:
    """What only a has and what only b has, sorted, of two arrays."""
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def null_rows(left: DataFrame, right: DataFrame, on: list[str], symbol: str = "symbol") -> DataFrame:
    """Counts of (source, target) of a full outer join by position; the side that has nothing shows a gap."""
    a, b = left.withColumnRenamed(symbol, "source"), right.withColumnRenamed(symbol, "target")
    met = a.join(b, on, "full").select(F.coalesce("source", F.lit(GAP)).alias("source"), F.coalesce("target", F.lit(GAP)).alias("target"))
    return met.groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"))


def residue(counts: DataFrame) -> DataFrame:
    """``source, total, outcomes, bits``: conditional entropy of the target given each source."""
    rows = counts.select("source", "count", F.sum("count").over(Window.partitionBy("source")).alias("total"))
    p = F.col("count") / F.col("total")
    return rows.groupBy("source").agg(
        F.max("total").cast("long").alias("total"), F.count(F.lit(1)).alias("outcomes"), F.sum(-p * F.log2(p)).alias("bits")
    )


def class_buckets(observations: DataFrame, set_column: str, slot: str, symbol: str) -> DataFrame:
    """Tuples of (slot, symbol) per set, counted, in publication order with a class id.

    A set's tuple is its distinct slot=symbol tokens, sorted.
    """
    tokens = F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", slot, symbol))), ",")
    rows = observations.groupBy(set_column).agg(tokens.alias("tuple")).groupBy("tuple").agg(F.count(F.lit(1)).alias("count"))
    return published(rows)


def published(classes: DataFrame) -> DataFrame:
    """Classes (tuple, count, ...) numbered in the order of their counts, then of their tuples; a table of classes is as small as the inventories' combinations that occur."""
    return classes.withColumn("class_id", F.row_number().over(Window.orderBy(F.desc("count"), "tuple")).cast("long") - 1)


def supporting(sets: DataFrame, key: str, set_column: str, order: str) -> DataFrame:
    """``key, sets, supporting``: the distinct sets of each class in the order of the corpus, joined by commas."""
    rows = sets.groupBy(key, set_column).agg(F.min(order).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(set_column).alias("name"))))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("sets"), listed.alias("all"))
    return out.select(key, "sets", F.array_join(F.transform("all", lambda x: x["name"].cast("string")), ",").alias("supporting"))
