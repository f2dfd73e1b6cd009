"""Resampling by hashes: the same draws in every engine, on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.operators.graph import ranked

#: Draws that one digest serves, by eight of its hexadecimal digits each.
PER_DIGEST = 4
#: A number below 2**32 stands for as many copies as it reaches of these: the distribution function of a Poisson variable of mean one.
STEPS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def draw(*parts: Column) -> Column:
    """An integer below 2**32 from a digest of the parts."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap_rates(counts: DataFrame, group: str, label: str, n: str, draws: int) -> DataFrame:
    """``draw, label, rate``: rates of labels when groups are drawn with replacement.

    ``counts`` has a row for each (group, label); groups are longs, numbered by
    their order.  A draw is a multiplicity for each group, so rows aren't copied.
    Numbers need the order of all groups; ``hashed_rates`` needs none.
    """
    spark = counts.sparkSession
    groups = counts.select(group).distinct()
    numbered = ranked(groups, group)
    size = groups.agg(F.count(F.lit(1)).alias("groups"))
    picks = numbered.crossJoin(F.broadcast(spark.range(draws).withColumnRenamed("id", "draw"))).crossJoin(F.broadcast(size))
    picks = picks.select("draw", (draw(F.col("draw"), F.col("place")) % F.col("groups")).alias("place"))
    times = picks.groupBy("draw", "place").agg(F.count(F.lit(1)).alias("times")).join(numbered, "place")
    rows = counts.join(times, group).groupBy("draw", label).agg(F.sum(F.col(n) * F.col("times")).alias("mass"))
    return rows.select("draw", label, (F.col("mass") / F.sum("mass").over(Window.partitionBy("draw"))).alias("rate"))


def observation_group(label: Column | None, own: Column) -> Column:
    """The group that is drawn as a whole: the rows of a label, and where it is null or empty a row's own id; the two never meet."""
    alone = F.concat(F.lit("own:"), own.cast("string"))
    return alone if label is None else F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("of:"), label)).otherwise(alone)


def hashed_masses(counts: DataFrame, group: str, labels: list[str], n: str, draws: int, seed: int = 0) -> DataFrame:
    """``draw, labels.., mass``: each draw takes a group as often as a hash of (seed, draw, group) says, about once on average.

    Multiplicities of different groups are independent, so nothing is numbered
    and no size is known beforehand: one aggregation, summed up before its
    shuffle, whose result is as large as the labels times the draws.  Every
    label has every draw, with mass 0 where none of its groups was taken.  A
    group whose name is null counts as one group.  Without rows: no rows.
    """
    blocks = math.ceil(draws / PER_DIGEST)
    rows = counts.select(*labels, F.col(n).alias("lw_n"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("lw_group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("lw_block"))
    rows = rows.withColumn("lw_digest", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("lw_block").cast("string"), "lw_group").cast("binary")))
    rows = rows.withColumns({f"lw_{k}": F.conv(F.substring("lw_digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(PER_DIGEST)})

    def times(k: int) -> Column:
        out = F.when(F.col(f"lw_{k}") < STEPS[0], 0)
        for copies, step in enumerate(STEPS[1:], 1):
            out = out.when(F.col(f"lw_{k}") < step, copies)
        return out.otherwise(len(STEPS))

    sums = rows.groupBy(*labels, "lw_block").agg(*[F.sum(F.col("lw_n") * times(k)).alias(f"lw_m{k}") for k in range(PER_DIGEST)])
    each = F.explode(F.array(*[F.struct((F.col("lw_block") * PER_DIGEST + k).alias("draw"), F.col(f"lw_m{k}").alias("mass")) for k in range(PER_DIGEST)]))
    return sums.select(*labels, each.alias("lw_x")).select("lw_x.draw", *labels, "lw_x.mass").where(F.col("draw") < draws)


def hashed_rates(counts: DataFrame, group: str, label: str, n: str, draws: int, seed: int = 0, whole: DataFrame | None = None) -> DataFrame:
    """``draw, label, rate``: masses of hashed draws over those of all labels, or of ``whole`` (group, n); 0 in a draw that took nothing."""
    masses = hashed_masses(counts, group, [label], n, draws, seed)
    totals = hashed_masses(whole if whole is not None else counts, group, [], n, draws, seed).withColumnRenamed("mass", "lw_total")
    # a row for each draw
    met = masses.join(F.broadcast(totals), "draw", "left")
    return met.select("draw", label, F.when(F.col("lw_total") > 0, F.col("mass") / F.col("lw_total")).otherwise(0.0).alias("rate"))


def percentile_intervals(rates: DataFrame, label: str, alpha: float = 0.05) -> DataFrame:
    """``label, low, high``: percentiles of each label's rates over the draws, within 0 and 1."""
    q = F.percentile("rate", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return rates.groupBy(label).agg(q.alias("q")).select(label, F.greatest(F.col("q")[0], F.lit(0.0)).alias("low"), F.least(F.col("q")[1], F.lit(1.0)).alias("high"))


def pairing_shuffle(pairs: DataFrame, key: str, left: str, right: str, within: str, replicates: int) -> DataFrame:
    """``replicate, key, left, right``: each replicate deals the right sides anew among the rows of a group, in the order of a digest."""
    spark = pairs.sparkSession
    copies = pairs.crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "replicate")))
    by = ["replicate", within]
    a = copies.select(*by, key, left, F.row_number().over(Window.partitionBy(*by).orderBy(key)).alias("place"))
    w = Window.partitionBy(*by).orderBy(draw(F.col("replicate"), F.col(key)), key)
    b = copies.select(*by, right, F.row_number().over(w).alias("place"))
    return a.join(b, [*by, "place"]).drop("place")


def dealt(df: DataFrame, by: list[str], order: Column, tie: str, name: str, bits: int = 12) -> DataFrame:
    """``df`` with the place (from 0) of each row in its group, in the order of a draw (below 2**32), then of ``tie``.

    Draws spread evenly, so their leading bits cut a group of any size into even
    blocks: rows are numbered within blocks, and only the blocks' counts, at most
    2**bits of a group, are summed up in order.
    """
    rows = df.withColumn("lw_draw", order)
    rows = rows.withColumn("lw_block", F.shiftright("lw_draw", 32 - bits))
    sizes = rows.groupBy(*by, "lw_block").agg(F.count(F.lit(1)).alias("lw_size"))
    before = Window.partitionBy(*by).orderBy("lw_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "lw_block", F.coalesce(F.sum("lw_size").over(before), F.lit(0)).alias("lw_offset"))
    within = F.row_number().over(Window.partitionBy(*by, "lw_block").orderBy("lw_draw", tie)) - 1
    met = rows.withColumn("lw_within", within).join(sizes, [*by, "lw_block"])
    return met.withColumn(name, F.col("lw_within") + F.col("lw_offset")).select(*df.columns, name)
