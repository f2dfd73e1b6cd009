"""Scoring of categorical splits: which predicate conditions an outcome.

Observations are rows with an outcome and boolean predicates.  One pass sums
the masses of all outcomes inside and outside of every predicate, so the cost
is a scan and a table of predicates x outcomes, whatever the rows are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.functions.stats import lgamma, min_commit, nml_normalizer, xlogx

EPSILON = 1e-12


def masses(df: DataFrame, outcome: str, predicates: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """``predicate, outcome, inside, total`` (rows of counts), for each group of ``by``."""
    sums = [F.count_if(p).alias(name) for name, p in predicates.items()]
    wide = df.groupBy(*by, F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("total"), *sums)
    long = wide.select(*by, "outcome", "total", F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in predicates]), F.array(*[F.col(n) for n in predicates]))).alias("predicate", "inside"))
    return long.select(*by, "predicate", "outcome", "inside", "total")


SCORERS = ("bic", "nml", "dirichlet")


def scores(counted: DataFrame, by: list[str] = (), extra: float = 0.0, scorer: str = "bic") -> DataFrame:
    """Score of every predicate: the change of a code length times two (negative is better), masses, dominant share inside.

    bic: the multinomial's likelihood, (outcomes - 1) x (ln n + extra) for the further parameters; nml: its normalised
    maximum likelihood; dirichlet: the marginal likelihood under a symmetric prior.  The latter two need whole counts.
    """
    if scorer not in SCORERS:
        raise ValueError(f"scorer must be one of {SCORERS}")
    keys = [*by, "predicate"]
    outside = F.col("total") - F.col("inside")
    if scorer == "dirichlet":
        whole = Window.partitionBy(*keys)
        k = F.count(F.lit(1)).over(whole)
        counted = counted.withColumns({f"a_{side}": F.sum(c).over(whole) / k for side, c in (("in", F.col("inside")), ("out", outside), ("all", F.col("total")))})
    sums = [
        F.sum("inside").alias("n_in"), F.sum(outside).alias("n_out"), F.sum("total").alias("n"), F.count(F.lit(1)).alias("outcomes"), F.max("inside").alias("top_in"),
    ]
    for side, c in (("in", F.col("inside")), ("out", outside), ("all", F.col("total"))):
        term = lgamma(c + F.col(f"a_{side}")) - lgamma(F.col(f"a_{side}")) if scorer == "dirichlet" else xlogx(c.cast("double"))
        sums.append(F.sum(term).alias(f"x_{side}"))
    out = counted.groupBy(*keys).agg(*sums)
    cost = {}
    for side, n in (("in", "n_in"), ("out", "n_out"), ("all", "n")):
        total = F.col(n).cast("double")
        if scorer == "dirichlet":
            cost[side] = F.when(F.col(n) > 0, lgamma(total + total) - lgamma(total) - F.col(f"x_{side}")).otherwise(0.0)
        else:
            cost[side] = xlogx(total) - F.col(f"x_{side}") + (nml_normalizer(F.col(n), F.col("outcomes")) if scorer == "nml" else 0)
    delta = 2 * (cost["in"] + cost["out"] - cost["all"])
    if scorer == "bic":
        delta = delta + (F.col("outcomes") - 1) * (F.ln(F.col("n").cast("double")) + extra)
    dominant = F.when(F.col("n_in") > 0, F.col("top_in") / F.col("n_in")).otherwise(0.0)
    return out.select(*keys, "n_in", "n_out", delta.alias("delta"), dominant.alias("dominant"))


def partition_marks(df: DataFrame, identity: str, predicates: dict[str, Column]) -> DataFrame:
    """``predicate, mark``: equal marks are the same division of the rows in two, whichever side is called inside.

    A mark is an order-free fingerprint (count, exclusive or of id hashes) of
    the smaller side in a total order, so it takes one scan and no row leaves its task.
    """
    h = F.xxhash64(identity)
    sums = [F.count_if(p).alias(f"n_{k}") for k, p in enumerate(predicates.values())]
    xors = [F.bit_xor(F.when(p, h)).alias(f"x_{k}") for k, p in enumerate(predicates.values())]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), *sums, *xors)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("predicate"), F.col(f"n_{k}").alias("m"), F.coalesce(f"x_{k}", F.lit(0)).alias("y")) for k, name in enumerate(predicates)
    ]))
    one = one.select("n", "x", rows.alias("r")).select("n", "x", "r.*")
    here, there = F.struct("m", "y"), F.struct(F.col("n") - F.col("m"), F.col("x").bitwiseXOR(F.col("y")))
    mark = F.least(F.concat_ws(":", here["m"], here["y"]), F.concat_ws(":", there["col1"], there["col2"]))
    return one.select("predicate", "m", "n", mark.alias("mark"))


def best(scored: DataFrame, partitions: int, min_obs: int = 3, threshold: float = 0.0, gamma: float = 1.0, order: list[str] = ()) -> DataFrame:
    """The winning predicate: gates, then the charge for the search over distinct partitions, then the lowest score; ties by the order of candidates."""
    charge = gamma * 2 * math.log(partitions) if partitions > 1 else 0.0
    rank = F.coalesce(*[F.when(F.col("predicate") == p, k) for k, p in enumerate(order)], F.lit(len(order))) if order else F.lit(0)
    gated = scored.withColumn("delta", F.col("delta") + charge).where((F.col("n_in") >= min_obs) & (F.col("n_out") >= min_obs) & (F.col("delta") < threshold))
    ranked = gated.withColumn("place", F.row_number().over(Window.orderBy(F.round("delta", 9), rank, "predicate")))
    return ranked.where("place = 1").drop("place").withColumn("margin", threshold - F.col("delta"))


def decision_list(df: DataFrame, outcome: str, predicates: dict[str, Column], identity: str, rounds: int = 2, min_obs: int = 3) -> DataFrame:
    """Rules in order of decision: the best split, then the best of what it left outside, and so on."""
    partitions = partition_marks(df, identity, predicates).select("mark").distinct().count()
    out, left = None, df
    for k in range(rounds):
        won = best(scores(masses(left, outcome, predicates)), partitions, min_obs, order=list(predicates)).first()
        if won is None:
            break
        inside = left.where(predicates[won["predicate"]]).groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("count"))
        inside = inside.select(F.lit(k).cast("long").alias("decision"), F.lit(won["predicate"]).alias("predicate"), "outcome", "count", F.lit(won["delta"]).alias("delta"))
        out = inside if out is None else out.unionByName(inside)
        left = left.where(~predicates[won["predicate"]])
    if out is None:
        return df.sparkSession.createDataFrame([], "decision long, predicate string, outcome string, count long, delta double")
    return out


#: Near rivals that are kept.
RIVALS = 8


def near_rivals(scored: DataFrame, marks: DataFrame, slots: dict[str, str], min_obs: int = 3, threshold: float = 0.0, gamma: float = 1.0, keep: int = RIVALS, order: list[str] = ()) -> DataFrame:
    """``winner, rival, margin``: predicates at another slot than the winner that divide the rows in another way and would have been committed by themselves.

    Of those that divide them alike one counts, the first in the order of candidates; the strongest ``keep`` stay.
    """
    n = marks.select("mark").distinct().count()
    won = best(scored, n, min_obs, threshold, gamma, order)
    charge = gamma * 2 * math.log(n) if n > 1 else 0.0
    slot = F.coalesce(*[F.when(F.col("predicate") == p, F.lit(s)) for p, s in slots.items()], F.lit(""))
    rank = F.coalesce(*[F.when(F.col("predicate") == p, k) for k, p in enumerate(order)], F.lit(len(order))) if order else F.lit(0)
    rows = scored.where((F.col("n_in") >= min_obs) & (F.col("n_out") >= min_obs)).withColumn("margin", threshold - F.col("delta") - charge)
    rows = rows.join(marks.select("predicate", "mark"), "predicate").withColumns({"slot": slot, "rank": rank}).where("margin > 0")
    first = won.select(F.col("predicate").alias("winner")).join(rows, F.col("predicate") == F.col("winner")).select("winner", F.col("slot").alias("w_slot"), F.col("mark").alias("w_mark"))
    others = rows.crossJoin(F.broadcast(first)).where("slot <> w_slot and mark <> w_mark")
    one = others.groupBy("winner", "mark").agg(F.min(F.struct("rank", "predicate", "margin")).alias("r")).select("winner", "r.*")
    place = F.row_number().over(Window.partitionBy("winner").orderBy(F.desc(F.round("margin", 9)), "rank", "predicate"))
    return one.withColumn("place", place).where(F.col("place") <= keep).select("winner", F.col("predicate").alias("rival"), "margin")


def relabelled(winner: str, marks: DataFrame, matches: DataFrame, slots: dict[str, str], tiers: dict[str, int], order: list[str]) -> DataFrame:
    """One row: the predicate that names the winner's division best: ``marks(predicate, mark, side)`` alike and on the same side.

    A lower tier wins; within the winner's tier only predicates of its slot are considered, the one of fewest matches first, then candidates' order.
    """
    tier = F.coalesce(*[F.when(F.col("predicate") == p, k) for p, k in tiers.items()], F.lit(2))
    slot = F.coalesce(*[F.when(F.col("predicate") == p, F.lit(s)) for p, s in slots.items()], F.lit(""))
    rank = F.coalesce(*[F.when(F.col("predicate") == p, k) for k, p in enumerate(order)], F.lit(len(order)))
    rows = marks.join(matches, "predicate").withColumns({"tier": tier, "slot": slot, "rank": rank})
    own = rows.where(F.col("predicate") == winner).select(*[F.col(c).alias(f"w_{c}") for c in ("mark", "side", "tier", "slot")])
    alike = rows.crossJoin(F.broadcast(own)).where("mark = w_mark and side = w_side and (tier < w_tier or (tier = w_tier and slot = w_slot))")
    return alike.orderBy("tier", "matches", "rank").limit(1).select("predicate", "tier", "matches")


def commit(rows: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """Rules by their keys: a repeated one takes what was found last, and keeps the first decision that found it."""
    rest = [c for c in rows.columns if c not in (*keys, decision)]
    out = rows.groupBy(*keys).agg(F.min(decision).alias(decision), F.max(F.struct(decision, *rest)).alias("last"))
    return out.select(*keys, decision, *[F.col(f"last.{c}").alias(c) for c in rest])


def both_sides(df: DataFrame, outcome_by_side: dict[str, str], predicates: dict[str, dict[str, Column]], identity: str, rounds: int = 2) -> DataFrame:
    """Decision lists of both sides, found on the same observations before either is committed: ``side, decision, predicate, outcome, count, delta``."""
    out = None
    for side, outcome in outcome_by_side.items():
        rows = decision_list(df, outcome, predicates[side], identity, rounds).withColumn("side", F.lit(side))
        out = rows if out is None else out.unionByName(rows)
    return commit(out, ["side", "predicate", "outcome"])


def merged(splits: DataFrame) -> DataFrame:
    """``split, into``: a split (key, decision, observation rows) that only restates an earlier one goes into the first such one.

    It does if the earlier split has the same key and holds all of its observations; else it stays by itself.
    """
    sized = splits.groupBy("key", "decision").agg(F.count_distinct("obs").alias("n"))
    rows = splits.select("key", "decision", "obs").distinct()
    earlier = rows.select("key", "obs", F.col("decision").alias("into"))
    held = rows.join(earlier, ["key", "obs"]).where("into < decision").groupBy("key", "decision", "into").agg(F.count(F.lit(1)).alias("m"))
    whole = held.join(sized, ["key", "decision"]).where("m = n").groupBy("key", "decision").agg(F.min("into").alias("into"))
    return sized.join(whole, ["key", "decision"], "left").select("key", "decision", F.coalesce("into", "decision").alias("into"))


def emitted(df: DataFrame, predicate: Column, sister: str, scale: float = 0.5) -> DataFrame:
    """Classes of a committed split: each sister outcome inside, with at least the adaptive minimum, beside the commonest outcome outside.

    ``sister, count, inside, rate, complement, contrast_count, contrast_total``; of equally common complements the lower name counts.
    """
    counted = df.groupBy(F.col(sister).alias("sister")).agg(F.count_if(predicate).alias("count"), F.count_if(~predicate).alias("rest"))
    whole = counted.agg(F.sum("count").alias("inside"), F.sum("rest").alias("contrast_total"), F.min_by("sister", F.struct(-F.col("rest"), F.col("sister"))).alias("complement"))
    rows = counted.crossJoin(F.broadcast(whole)).where(F.col("count") >= min_commit(F.col("inside"), scale))
    return rows.select("sister", "count", "inside", (F.col("count") / F.col("inside")).alias("rate"), "complement", F.col("rest").alias("contrast_count"), "contrast_total")
