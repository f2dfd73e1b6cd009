"""Groups of forms and sets: doublets, group weights, missing slots, folds, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combinations(forms: DataFrame, set_column: str, lect: str, form: str, cap: int = 8) -> DataFrame:
    """``set, lect, k, combination, combinations``: which form (by its rank k among those of its lect) each combination of a set picks.

    Combinations are at most ``cap``, in mixed radix, the first lect fastest:
    combination i picks form i mod n of the first lect, then goes on with i
    div n.  So form k of a lect whose lects before it have p combinations is
    picked by those i with i div p mod n = k - 1; none below the cap reaches
    further forms than the cap.
    """
    per = forms.groupBy(set_column, lect).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(set_column).orderBy(lect).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(set_column)
    many = F.lit(float(cap))
    stride = F.least(F.coalesce(F.product(F.least(F.col("n").cast("double"), many)).over(before), F.lit(1.0)), many).cast("long")
    total = F.least(F.product(F.least(F.col("n").cast("double"), many)).over(whole), many).cast("long")
    sized = per.select(set_column, lect, "n", stride.alias("stride"), total.alias("combinations"))
    each = sized.withColumn("combination", F.explode(F.sequence(F.lit(0).cast("long"), F.col("combinations") - 1)))
    k = F.floor(F.col("combination") / F.col("stride")).cast("long") % F.col("n") + 1
    return each.select(set_column, lect, k.cast("int").alias("k"), "combination", "combinations")


def doublets(forms: DataFrame, set_column: str, lect: str, form: str, cap: int = 8) -> DataFrame:
    """One row per set and combination of its lects' forms: ``set, combination, forms, confidence``."""
    w = Window.partitionBy(set_column, lect).orderBy(form)
    rows = forms.select(set_column, lect, form, F.row_number().over(w).alias("k")).where(F.col("k") <= cap)
    met = combinations(forms, set_column, lect, form, cap).join(rows, [set_column, lect, "k"])
    named = F.struct(F.col(lect).alias("lect"), F.concat_ws("=", F.col(lect), F.col(form).cast("string")).alias("text"))
    out = met.groupBy(set_column, "combination").agg(F.array_sort(F.collect_list(named)).alias("all"), F.first("combinations").alias("combinations"))
    return out.select(set_column, "combination", F.array_join(F.transform("all", lambda x: x["text"]), ",").alias("forms"), (1.0 / F.col("combinations")).alias("confidence"))


def group_weights(df: DataFrame, label: Column, key: str) -> DataFrame:
    """``key, group_size, weight`` (1 over the size) by a label; labels are compared by digest and counted before they meet rows, so a hot label is no hot task."""
    mark = F.sha2(F.coalesce(label, F.lit("")).cast("binary"), 256)
    rows = df.select(key, mark.alias("mark"))
    sizes = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "mark").select(key, "group_size", (1.0 / F.col("group_size")).alias("weight"))


def missing_slots(df: DataFrame, set_column: str, lect: str) -> DataFrame:
    """(set, lect) combinations that have no form; the inventory of lects is small."""
    have = df.select(set_column, lect).distinct()
    every = have.select(set_column).distinct().crossJoin(F.broadcast(have.select(lect).distinct()))
    return every.join(have, [set_column, lect], "left_anti")


def shared_members(df: DataFrame, owner: str, member: Column) -> DataFrame:
    """``a, b, shared``: how many distinct members each pair of owners has in common."""
    rows = df.select(F.col(owner).alias("owner"), member.alias("member")).distinct()
    owners = rows.groupBy("member").agg(F.array_sort(F.collect_set("owner")).alias("owners")).where(F.size("owners") > 1)
    # owners are an inventory: a set of them is counted once, however many members it has
    sets = owners.groupBy("owners").agg(F.count(F.lit(1)).alias("n"))
    a = sets.select("owners", "n", F.posexplode("owners").alias("i", "a"))
    b = a.select("a", "n", F.explode(F.slice("owners", F.col("i") + 2, F.size("owners"))).alias("b"))
    return b.groupBy("a", "b").agg(F.sum("n").alias("shared"))
