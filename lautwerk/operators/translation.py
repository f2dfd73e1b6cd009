"""Symbol translation tables: the prior from distances and expectation-maximisation (IBM model 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL = "∅"


def softmax_prior(distances: DataFrame, tau: float = 1.0, concentration: float = 5.0) -> DataFrame:
    """``a, b, alpha, log_z`` of a table of distances (a, b, d): alpha is concentration x softmax over b of -tau d."""
    w = Window.partitionBy("a")
    z = F.sum(F.exp(-tau * F.col("d"))).over(w)
    return distances.select("a", "b", (concentration * F.exp(-tau * F.col("d")) / z).alias("alpha"), F.ln(z).alias("log_z"))


def start_table(pairs: DataFrame) -> DataFrame:
    """``s, t, p``: uniform over the targets that a source meets."""
    met = pairs.select(F.explode("source").alias("s"), "target").select("s", F.explode("target").alias("t")).distinct()
    return met.select("s", "t", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("s"))).alias("p"))


def em_step(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """One round on ``pairs(pair, source array, target array, weight)``; the source array holds the null symbol where it may explain targets.

    Each target position shares its weight over the pair's source positions in
    proportion to p(t|s); the shares are summed by (s, t) and normalised by s.
    """
    each = pairs.select("pair", "weight", "source", F.posexplode("target").alias("j", "t"))
    each = each.select("pair", "weight", "j", "t", F.posexplode("source").alias("i", "s"))
    met = each.join(table, ["s", "t"])
    share = F.col("weight") * F.col("p") / F.sum("p").over(Window.partitionBy("pair", "j"))
    mass = met.withColumn("share", share).groupBy("s", "t").agg(F.sum("share").alias("mass"))
    return mass.select("s", "t", (F.col("mass") / F.sum("mass").over(Window.partitionBy("s"))).alias("p"))


def train(pairs: DataFrame, rounds: int, tolerance: float | None = None, keep=None) -> DataFrame:
    """The table after so many rounds, or fewer if a tolerance is given and the likelihood's relative change falls below it.

    keep: a function that writes a round's table and reads it back, which cuts the plan of long runs.
    """
    table, last = start_table(pairs), None
    for _ in range(rounds):
        table = em_step(pairs, table)
        table = keep(table) if keep else table
        if tolerance is not None:
            now = log_likelihood(pairs, table).first()[0]
            if last is not None and abs(now - last) < tolerance * max(1e-12, abs(last)):
                break
            last = now
    return table


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs the other way round; the null symbol goes to the new source side."""
    plain = F.filter("source", lambda x: x != NULL)
    return pairs.select("pair", F.concat(F.array(F.lit(NULL)), F.col("target")).alias("source"), plain.alias("target"), "weight")


def prior_table(distances: DataFrame, tau: float = 1.0) -> DataFrame:
    """``s, t, p``: the table before any training, a softmax of distances (a, b, d) with exp(-1/2) for the null symbol in the normaliser."""
    z = F.sum(F.exp(-tau * F.col("d"))).over(Window.partitionBy("a")) + F.exp(F.lit(-0.5))
    return distances.select(F.col("a").alias("s"), F.col("b").alias("t"), (F.exp(-tau * F.col("d")) / z).alias("p"))


def symmetric(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """``s, t, p``: geometric mean of p(t|s) and p(s|t); pairs that one direction doesn't know have 0 and are left out."""
    back = backward.select(F.col("s").alias("t"), F.col("t").alias("s"), F.col("p").alias("q"))
    return forward.join(back, ["s", "t"]).select("s", "t", F.sqrt(F.col("p") * F.col("q")).alias("p")).where("p > 0")


def best_links(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pair, i, s, j, t, p``: for each source place the target place of the largest probability, the first of equal ones."""
    each = pairs.select("pair", F.posexplode("source").alias("i", "s"), "target").where(F.col("s") != NULL)
    met = each.select("pair", "i", "s", F.posexplode("target").alias("j", "t")).join(table, ["s", "t"]).where("p > 0")
    best = met.groupBy("pair", "i", "s").agg(F.max_by(F.struct("j", "t", "p"), F.struct(F.round("p", 12), -F.col("j"))).alias("b"))
    return best.select("pair", "i", "s", "b.*")


def pair_scores(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pair, score``: the sum of ln p of the best links over the source's length."""
    n = pairs.select("pair", F.size(F.filter("source", lambda x: x != NULL)).alias("n"))
    return best_links(pairs, table).groupBy("pair").agg(F.sum(F.ln("p")).alias("sum")).join(n, "pair").select("pair", (F.col("sum") / F.col("n")).alias("score"))


def seeded(prior: DataFrame, table: DataFrame, concentration: float = 5.0) -> DataFrame:
    """A prior (a, b, alpha, log_z) whose alphas are a trained table's probabilities times the concentration, log_z zero; pairs that the table lacks keep theirs."""
    met = prior.join(table.select(F.col("s").alias("a"), F.col("t").alias("b"), "p"), ["a", "b"], "left")
    return met.select("a", "b", F.coalesce(concentration * F.col("p"), "alpha").alias("alpha"), F.lit(0.0).alias("log_z"))


def log_likelihood(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """One row: the weighted sum of ln of each target's summed probability."""
    each = pairs.select("pair", "weight", "source", F.posexplode("target").alias("j", "t"))
    each = each.select("pair", "weight", "j", "t", F.explode("source").alias("s"))
    met = each.join(table, ["s", "t"]).groupBy("pair", "j").agg(F.first("weight").alias("w"), F.sum("p").alias("p"))
    return met.agg(F.sum(F.col("w") * F.ln("p")).alias("log_likelihood"))
