"""Held-out prediction of categorical outcomes and proper scoring rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def predict(train: DataFrame, test: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Predicted distribution of ``target`` given ``source`` for the (source, target) pairs of ``test``, counted.

    Smoothed conditional rates over the training inventory and one unknown
    category; the test is counted first, so the work is a table of inventories.
    """
    counts = train.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    targets = train.select("target").distinct()
    sources = test.select("source").distinct()
    size = targets.agg(F.count(F.lit(1)).alias("k"))
    grid = sources.crossJoin(F.broadcast(targets)).join(counts, ["source", "target"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("source"))
    grid = grid.crossJoin(F.broadcast(size)).withColumn("p", (F.coalesce("n", F.lit(0)) + smoothing) / (total + smoothing * (F.col("k") + 1)))
    grid = grid.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("p"), "target")))
    seen = test.groupBy("source", "target").agg(F.count(F.lit(1)).alias("observed"))
    square = grid.groupBy("source").agg(F.sum(F.col("p") * F.col("p")).alias("square"), F.max("p").alias("top"))
    floor = smoothing / (F.coalesce("mass", F.lit(0)) + smoothing * (F.col("k") + 1))
    mass = counts.groupBy("source").agg(F.sum("n").alias("mass"))
    out = seen.join(grid.select("source", "target", "p", "place"), ["source", "target"], "left").join(square, "source", "left").join(mass, "source", "left")
    out = out.crossJoin(F.broadcast(size))
    return out.select("source", "target", "observed", F.coalesce("p", floor).alias("p"), "place", "square", "top")


def score(predicted: DataFrame, top_k: int = 3, bins: int = 10, abstain: float = 0.5) -> DataFrame:
    """One row: observations, log loss, top-1 and top-k rates, Brier score, the share below the top probability that is asked for, calibration error in bins of it."""
    w, place = F.col("observed"), F.coalesce("place", F.lit(1 << 30))
    one = predicted.agg(
        F.sum("observed").alias("n"),
        (F.sum(-w * F.ln("p")) / F.sum(w)).alias("log_loss"),
        (F.sum(F.when(place == 1, w).otherwise(0)) / F.sum(w)).alias("top1"),
        (F.sum(F.when(place <= top_k, w).otherwise(0)) / F.sum(w)).alias("top_k"),
        (F.sum(w * (F.col("square") - 2 * F.col("p") + 1)) / F.sum(w)).alias("brier"),
        (F.sum(F.when(F.col("top") < abstain, w).otherwise(0)) / F.sum(w)).alias("abstained"),
    )
    at = F.least(F.floor(F.col("top") * bins), F.lit(bins - 1))
    binned = predicted.groupBy(at.alias("bin")).agg(
        F.sum("observed").alias("m"), F.sum(F.when(place == 1, w).otherwise(0)).alias("hit"), F.sum(w * F.col("top")).alias("said")
    )
    ece = binned.agg((F.sum(F.abs(F.col("hit") - F.col("said"))) / F.sum("m")).alias("ece"))
    return one.crossJoin(ece)


KINDS = ("conditioned", "unconditioned", "identity", "inventory", "feature")
UNKNOWN, FLOOR = "?", 1e-12


def target_inventory(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by.., target, n``: how often each direction's training has a target."""
    return pairs.groupBy(*by, "target").agg(F.count(F.lit(1)).alias("n"))


def united_inventory(inventories: list[DataFrame]) -> DataFrame:
    """Targets of several directions' inventories, each once, in order."""
    out = inventories[0].select("target")
    for more in inventories[1:]:
        out = out.unionByName(more.select("target"))
    return out.distinct()


def distributions(train: DataFrame, conditioned: DataFrame, sources: DataFrame, distances: DataFrame, alpha: float = 1.0, tau: float = 1.0) -> DataFrame:
    """``kind, env, source, target, p`` of the five kinds of prediction, over the training's targets and one unknown category.

    conditioned, unconditioned: alpha and the count, in the environment where training has it there, else in all;
    identity: 1 for the source itself, 1e-6 for others; inventory: the target's count and 1; feature: exp(-d / tau).
    Masses are at least 1e-12 before they are normalised.  ``train(source, target)``, ``conditioned(env, source, target)``,
    ``sources(env, source)`` distinct, ``distances(a, b, d)``.
    """
    counts = train.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    inside = conditioned.groupBy("env", "source", "target").agg(F.count(F.lit(1)).alias("m"))
    fires = inside.select("env", "source").distinct().withColumn("fires", F.lit(True))
    targets = target_inventory(train).select("target", F.col("n").alias("t_n"))
    spark = train.sparkSession
    targets = targets.unionByName(spark.createDataFrame([(UNKNOWN, 0)], "target string, t_n long"))
    grid = sources.crossJoin(F.broadcast(targets)).join(counts, ["source", "target"], "left").join(inside, ["env", "source", "target"], "left").join(fires, ["env", "source"], "left")
    grid = grid.join(distances.select(F.col("a").alias("source"), F.col("b").alias("target"), "d"), ["source", "target"], "left")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    raw = {
        "conditioned": F.when(F.col("fires"), alpha + m).otherwise(alpha + n), "unconditioned": alpha + n,
        "identity": F.when(F.col("source") == F.col("target"), 1.0).otherwise(1e-6), "inventory": F.col("t_n") + 1.0,
        "feature": F.exp(-F.coalesce("d", F.lit(1.0)) / tau),
    }
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.greatest(c.cast("double"), F.lit(FLOOR)).alias("mass")) for k, c in raw.items()]))
    rows = grid.select("env", "source", "target", kinds.alias("x")).select("x.kind", "env", "source", "target", "x.mass")
    return rows.withColumn("p", F.col("mass") / F.sum("mass").over(Window.partitionBy("kind", "env", "source"))).drop("mass")


def pooled(predictions: DataFrame, at: list[str], least: int = 2) -> DataFrame:
    """``at.., target, p``: predictors' distributions of a place pooled by their geometric mean, normalised; places of fewer predictors are left out.

    ``predictions(at.., predictor, target, p)``: every predictor has the same targets.
    """
    w = Window.partitionBy(*at)
    rows = predictions.groupBy(*at, "target").agg(F.exp(F.avg(F.ln("p"))).alias("g"), F.count_distinct("predictor").alias("predictors")).where(F.col("predictors") >= least)
    return rows.select(*at, "target", (F.col("g") / F.sum("g").over(w)).alias("p"))


def confirmed(full: DataFrame, folds: DataFrame, keys: list[str], least_folds: int = 2, least_mass: int = 8) -> DataFrame:
    """``full`` rules with folds, observations, gain and verdict from the held-out rows (keys.., fold, observed, gain) of the same rule found without a fold."""
    held = folds.groupBy(*keys).agg(F.count_distinct("fold").alias("folds"), F.sum("observed").alias("held_out"), F.sum(F.col("observed") * F.col("gain")).alias("sum"))
    met = full.join(held, keys, "left")
    gain = F.col("sum") / F.col("held_out")
    verdict = F.when((F.col("folds") >= least_folds) & (F.col("held_out") >= least_mass) & (gain > 0), "confirmed").when(F.col("folds").isNull(), "not_evaluated").otherwise("not_confirmed")
    return met.select(*full.columns, F.coalesce("folds", F.lit(0)).alias("folds"), F.coalesce("held_out", F.lit(0)).alias("held_out"), gain.alias("gain"), verdict.alias("verdict"))
