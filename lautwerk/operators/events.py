"""Proposed changes: classes that share an environment, an outcome or a displacement, in groups whose members all agree.

Classes are rows of a small table: an id, a lect, an input, an outcome, an
array of environment tokens, displacement tokens, a count and scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A class is weak below this count if its rate is below this one, too.
WEAK_COUNT, WEAK_RATE = 8, 0.25


def is_identity(graphemes: Column) -> Column:
    return F.size(F.array_distinct(graphemes)) == 1


def is_weak(count: Column, rate: Column, contrast: Column) -> Column:
    """More mass outside the environment than in it, or few observations at a low rate."""
    return (contrast > count) | ((count < WEAK_COUNT) & (rate < WEAK_RATE))


def scope(forms: DataFrame, dimension: str, lect: str = "lect_id") -> DataFrame:
    """``lect, written``: whether a lect writes a dimension anywhere; it counts for a class only where all of its lects do."""
    return forms.groupBy(F.col(lect).alias("lect")).agg(F.max(F.exists("segments", lambda s: F.coalesce(s[dimension], F.lit("")) != "")).alias("written"))


def in_scope(classes: DataFrame, written: DataFrame) -> DataFrame:
    """``classes(class_id, lects)`` with in_scope: every lect of the class writes the dimension."""
    each = classes.select("class_id", F.explode("lects").alias("lect")).join(written, "lect", "left")
    return classes.join(each.groupBy("class_id").agg(F.min(F.coalesce("written", F.lit(False))).alias("in_scope")), "class_id")


def leading(classes: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """``classes`` with leads: whether the class has the largest count of its lects, slot and outcome."""
    return classes.withColumn("leads", F.col(count) == F.max(count).over(Window.partitionBy(*keys)))


def shared(members: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """``by.., members, shared``: the tokens that every row of a group holds; rows are (by.., member, token array)."""
    each = members.select(*by, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    size = members.groupBy(*by).agg(F.count(F.lit(1)).alias("members"))
    common = each.join(size, by).where("n = members").groupBy(*by).agg(F.array_sort(F.collect_list("token")).alias("shared"))
    return size.join(common, by, "left").select(*by, "members", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def without_conditioned(classes: DataFrame, conditioned: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Unconditioned classes that have a conditioned counterpart, and those that have none."""
    marks = conditioned.select(*keys).distinct()
    return classes.join(marks, keys, "left_semi"), classes.join(marks, keys, "left_anti")


def natural_class(members: DataFrame, inventory: DataFrame, within: list[str] = ()) -> DataFrame:
    """``within.., group, name``: the features that all members of a group have and nothing else of the inventory: one, or else the first pair.

    ``members(within.., group, grapheme)``, ``inventory(within.., grapheme, features)``; without such features a group has no row.
    """
    by = [*within, "group"]
    held = members.join(inventory, [*within, "grapheme"])
    size = members.groupBy(*by).agg(F.count_distinct("grapheme").alias("m"))
    common = held.select(*by, "grapheme", F.explode("features").alias("feature")).distinct().groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"))
    common = common.join(size, by).where("n = m").select(*by, "feature", "m")
    spread = inventory.select(*within, "grapheme", F.explode("features").alias("feature"))
    total = spread.groupBy(*within, "feature").agg(F.count(F.lit(1)).alias("k"))
    one = common.join(total, [*within, "feature"]).where("k = m").groupBy(*by).agg(F.min("feature").alias("name"))
    b = common.select(*by, F.col("feature").alias("g"))
    pairs = common.select(*by, F.col("feature").alias("f"), "m").join(b, by).where("f < g")
    both = spread.withColumnRenamed("feature", "f").join(spread.withColumnRenamed("feature", "g"), [*within, "grapheme"]).groupBy(*within, "f", "g").agg(F.count(F.lit(1)).alias("k"))
    two = pairs.join(both, [*within, "f", "g"]).where("k = m").groupBy(*by).agg(F.min(F.concat_ws("+", "f", "g")).alias("pair"))
    return one.join(two, by, "full").select(*by, F.coalesce("name", "pair").alias("name"))


def built(members: DataFrame, by: list[str]) -> DataFrame:
    """Events of groups: members, pooled count, the weakest evidence of any, in order of count: ``rank, by.., inputs, outcomes, count, margin, delta, first_id``."""
    rows = members.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_set("input")), ",").alias("inputs"), F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"),
        F.sum("count").alias("count"), F.min("margin").alias("margin"), F.max("delta").alias("delta"), F.min("class_id").alias("first_id"), F.count(F.lit(1)).alias("members"),
    )
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "first_id")).cast("long"))


AXES = ("environment", "outcome", "displacement")


def agree(a: dict, b: dict, axis: str) -> bool:
    """Whether two classes may stand in one event of an axis."""
    x, y = set(a["environment"]), set(b["environment"])
    if axis == "environment":
        return bool(x) and bool(y) and (x <= y or y <= x) and a["outcome"] != b["outcome"]
    if axis == "outcome":
        return a["outcome"] == b["outcome"] and x != y
    return not x and not y and bool(set(a["displacement"]) & set(b["displacement"]))


def cliques(classes: list[dict], axis: str) -> list[list[dict]]:
    """Groups in which every member agrees with every other: classes by count, each goes to the first group that it fits.

    Displacements of a whole group must have a token in common; inputs of a group are distinct.
    """
    groups: list[list[dict]] = []
    for c in sorted(classes, key=lambda c: (-c["count"], c["class_id"])):
        for g in groups:
            common = set(c["displacement"]).intersection(*(m["displacement"] for m in g))
            if all(agree(c, m, axis) and c["input"] != m["input"] for m in g) and (axis != "displacement" or common):
                g.append(c)
                break
        else:
            groups.append([c])
    return [g for g in groups if len(g) > 1]


def proposed(classes: DataFrame) -> DataFrame:
    """``axis, group, class_id``: groups of each axis among the classes of a lect that change anything, and conditioned classes alone in no group.

    A lect's classes are a table of its inventory; they are grouped in one kernel for each lect.
    """
    import pandas as pd

    schema = "lect string, axis string, group long, class_id long"

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r, environment=list(r["environment"]), displacement=list(r["displacement"])) for r in pdf.to_dict("records") if r["input"] != r["outcome"]]
        out, grouped, n = [], set(), 0
        for axis in AXES:
            for g in cliques([r for r in rows if axis != "displacement" or not r["environment"]], axis):
                out += [(*key, axis, n, int(m["class_id"])) for m in g]
                grouped |= {m["class_id"] for m in g}
                n += 1
        for r in sorted(rows, key=lambda r: (-r["count"], r["class_id"])):
            if r["environment"] and r["class_id"] not in grouped:
                out.append((*key, "single", n, int(r["class_id"])))
                n += 1
        return pd.DataFrame(out, columns=["lect", "axis", "group", "class_id"])

    return classes.groupBy("lect").applyInPandas(kernel, schema)
