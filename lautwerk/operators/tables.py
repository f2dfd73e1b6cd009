"""Tables read off aligned links: gaps, tones, displacement, intervals of classes, lects that are one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.functions.stats import wilson
from lautwerk.operators.alignment import GAP
from lautwerk.operators.resampling import hashed_rates, observation_group, percentile_intervals


def bound(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``lect_a, lect_b, set_id, weight, source, target`` (segments, null on the side of a gap) of links of one and one, and of gaps; of chunks, their parts."""
    words = sets.select("set_id", "lect_id", "segments")
    a = words.select("set_id", F.col("lect_id").alias("lect_a"), F.col("segments").alias("sa"))
    b = words.select("set_id", F.col("lect_id").alias("lect_b"), F.col("segments").alias("sb"))
    flat = "flat" if "flat" in links.columns else "links"
    each = links.select("set_id", "lect_a", "lect_b", "weight", F.explode(flat).alias("l")).join(a, ["set_id", "lect_a"]).join(b, ["set_id", "lect_b"])
    one = each.where("l.s_len = 1 and l.t_len = 1")
    lost, won = each.where("l.t_len = 0"), each.where("l.s_len = 0")
    s, t = F.element_at("sa", F.col("l.s_start") + 1), F.element_at("sb", F.col("l.t_start") + 1)
    none = F.lit(None)
    keys = ["lect_a", "lect_b", "set_id", "weight"]
    out = one.select(*keys, s.alias("source"), t.alias("target"))
    kind = out.schema["source"].dataType
    out = out.unionByName(lost.select(*keys, F.explode(F.slice("sa", F.col("l.s_start") + 1, F.col("l.s_len"))).alias("source"), none.cast(kind).alias("target")))
    return out.unionByName(won.select(*keys, none.cast(kind).alias("source"), F.explode(F.slice("sb", F.col("l.t_start") + 1, F.col("l.t_len"))).alias("target")))


def gap_rows(positions: DataFrame) -> DataFrame:
    """Losses and gains: weight of each gap, the weight with which the kept grapheme occurs, and the interval of their rate."""
    rows = positions.select("lect_a", "lect_b", "weight", F.coalesce("source.grapheme", F.lit(GAP)).alias("source"), F.coalesce("target.grapheme", F.lit(GAP)).alias("target"))
    counted = rows.groupBy("lect_a", "lect_b", "source", "target").agg(F.sum("weight").alias("count"))
    total = F.when(F.col("target") == GAP, F.sum("count").over(Window.partitionBy("lect_a", "lect_b", "source"))).otherwise(F.sum("count").over(Window.partitionBy("lect_a", "lect_b", "target")))
    out = counted.withColumn("total", total).where(f"source = '{GAP}' or target = '{GAP}'")
    low, high = wilson(F.col("count"), F.col("total"))
    return out.withColumns({"low": low, "high": high})


def tonal_counts(positions: DataFrame) -> DataFrame:
    """(tone, tone) weights of links of one and one where either side has a tone."""
    rows = positions.where("source is not null and target is not null and (source.tone <> '' or target.tone <> '')")
    return rows.groupBy("lect_a", "lect_b", F.col("source.tone").alias("source_tone"), F.col("target.tone").alias("target_tone")).agg(F.sum("weight").alias("count"))


def dimension_rules(positions: DataFrame, dimension: str = "tone", least: float = 3.0, context_is_target: bool = False, lect_internal: bool = False) -> DataFrame:
    """Cross-dimensional correspondences: for each feature of the one side's grapheme, the other side's tone (length, stress) where it holds and where it doesn't.

    context_is_target: the environment is read in the target, the value in the source; lect_internal: both in the
    former.  ``delta`` is the change of a two-by-two code; rows whose rate isn't above the contrast, or whose delta
    isn't below zero, are left out.
    """
    from lautwerk.operators.contexts import described
    from lautwerk.operators.crossdim import value_delta

    there = "target" if context_is_target else "source"
    here = there if lect_internal else "source" if context_is_target else "target"
    base = positions.where(f"source is not null and target is not null and {here}.{dimension} <> ''")
    base = base.groupBy("lect_a", "lect_b", F.col(f"{there}.grapheme").alias("grapheme"), F.col(f"{here}.{dimension}").alias("value")).agg(F.sum("weight").alias("w"))
    values = base.groupBy("lect_a", "lect_b", "value").agg(F.sum("w").alias("value_mass"))
    whole = base.groupBy("lect_a", "lect_b").agg(F.sum("w").alias("mass"))
    own = described(base).select("grapheme", F.explode("features").alias("feature"))
    held = base.join(own, "grapheme").groupBy("lect_a", "lect_b", "feature", "value").agg(F.sum("w").alias("a"))
    inside = F.sum("a").over(Window.partitionBy("lect_a", "lect_b", "feature"))
    rows = held.withColumn("inside", inside).join(values, ["lect_a", "lect_b", "value"]).join(whole, ["lect_a", "lect_b"])
    rows = rows.withColumns({"outside": F.col("mass") - F.col("inside"), "c": F.col("value_mass") - F.col("a")}).where("outside > 0")
    delta = value_delta(F.col("a"), F.col("inside"), F.col("c"), F.col("outside"))
    rows = rows.withColumns({"delta": delta, "rate": F.col("a") / F.col("inside"), "contrast_rate": F.col("c") / F.col("outside")})
    kept = rows.where((F.col("a") >= least) & (F.col("rate") > F.col("contrast_rate")) & (F.col("delta") < 0))
    return kept.select(
        "lect_a", "lect_b", F.lit(context_is_target).alias("context_is_target"), F.lit(lect_internal).alias("lect_internal"), "feature", F.lit(dimension).alias("dimension"), "value",
        F.col("a").alias("count"), F.col("inside").alias("total"), "rate", F.col("c").alias("contrast_count"), F.col("outside").alias("contrast_total"), "contrast_rate", "delta",
    )


def all_dimension_rules(positions: DataFrame, least: float = 3.0) -> DataFrame:
    """Both orientations, across lects and within each, of tone, length and stress; rules within a lect are kept once, from the pair of the largest mass."""
    from lautwerk.operators.crossdim import lifted

    out = None
    for dimension in ("tone", "length", "stress"):
        for context_is_target in (False, True):
            for internal in (False, True):
                rows = dimension_rules(positions, dimension, least, context_is_target, internal)
                out = rows if out is None else out.unionByName(rows)
    lect = F.when(F.col("context_is_target"), F.col("lect_b")).otherwise(F.col("lect_a"))
    inner = out.where("lect_internal").withColumns({"lect": lect, "pair": F.concat_ws(">", "lect_a", "lect_b")})
    return out.where("not lect_internal").unionByName(lifted(inner, ["lect", "feature", "dimension", "value"]).drop("lect", "pair"))


UNITS = ("auto", "etymon_group", "source_group", "set")


def units(sets: DataFrame, unit: str = "auto") -> DataFrame:
    """``set_id, unit``: the observation group of each set: those of one etymon or source group, else the set itself.

    auto: etymon groups where any set names one, else sets.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    own = F.col("cognate_id" if "cognate_id" in sets.columns else "set_id")
    each = sets.select("set_id", own.alias("own"), *[c for c in ("etymon_group", "source_group") if c in sets.columns]).dropDuplicates(["set_id"])
    if unit == "auto":
        unit = "etymon_group" if "etymon_group" in sets.columns and not sets.where("etymon_group <> ''").isEmpty() else "set"
    return each.select("set_id", observation_group(None if unit == "set" else F.col(unit), F.col("own")).alias("unit"))


def class_intervals(observations: DataFrame, draws: int = 200, alpha: float = 0.05, sets: DataFrame | None = None, unit: str = "auto", conditioned: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``tuple, low, high``: percentile intervals of classes' shares of all positions when observation groups are drawn anew.

    sets: which group a set is of (``units``); without them each set is its own.
    conditioned: masses of further classes by set (``set_id, tuple, n``), which
    share the denominator but don't add to it; they have been selected on the
    same data, so their intervals don't price the search.
    """
    key = F.array_join(F.transform("members", lambda m: F.concat_ws("=", m["lect"], m["grapheme"])), " ~ ")
    counted = observations.groupBy("set_id", key.alias("tuple")).agg(F.sum("weight").alias("n"))
    whole = counted
    if conditioned is not None:
        counted = counted.unionByName(conditioned.select("set_id", "tuple", "n"))
    if sets is None:
        drawn = lambda rows, *c: rows.select(F.concat(F.lit("own:"), "set_id").alias("unit"), *c, "n")
    else:
        own = units(sets, unit)
        drawn = lambda rows, *c: rows.join(own, "set_id").select("unit", *c, "n")
    counted = drawn(counted, "tuple").groupBy("unit", "tuple").agg(F.sum("n").alias("n"))
    whole = drawn(whole).groupBy("unit").agg(F.sum("n").alias("n"))
    return percentile_intervals(hashed_rates(counted, "unit", "tuple", "n", draws, seed, whole), "tuple", alpha)


def duplicate_lects(sets: DataFrame) -> DataFrame:
    """Pairs of lects whose forms are the same in every set they share."""
    rows = sets.select("set_id", "lect_id", F.to_json("segments").alias("form"))
    a, b = rows.select("set_id", F.col("lect_id").alias("a"), F.col("form").alias("x")), rows.select("set_id", F.col("lect_id").alias("b"), F.col("form").alias("y"))
    met = a.join(b, "set_id").where("a < b").groupBy("a", "b").agg(F.bool_and(F.col("x") == F.col("y")).alias("same"), F.count(F.lit(1)).alias("shared"))
    return met.where("same").select("a", "b", "shared")
