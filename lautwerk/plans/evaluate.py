"""Held-out evaluation: dependency folds, training without a fold, prediction of its symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.functions.features import distance
from lautwerk.operators import pairwise, prediction
from lautwerk.operators.alignment import align_pairs, prior_costs
from lautwerk.operators.graph import Scratch, label_components, ranked
from lautwerk.operators.resampling import draw


def folds(sets: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``set_id, fold``: sets that share an id, an etymon or a source stay in one fold; components are dealt out in the order of a digest."""
    rows = sets.select("set_id", "cognate_id", "etymon_group", "source_group").distinct()
    rows = rows.withColumn("key", F.xxhash64("set_id"))
    alone = F.col("set_id")
    rows = rows.withColumns({c: F.when(F.col(c) == "", F.concat(F.lit("#"), alone)).otherwise(F.col(c)) for c in ("etymon_group", "source_group")})
    comp = label_components(rows, "key", [["cognate_id"], ["etymon_group"], ["source_group"]], scratch)
    dealt = ranked(comp.select(draw(F.col("comp")).alias("order"), "comp").distinct().groupBy("order").agg(F.min("comp").alias("comp")), "order")
    dealt = dealt.select("comp", (F.col("place") % k).cast("int").alias("fold"))
    return rows.join(comp, "key").join(dealt, "comp").select("set_id", "fold")


def symbols(links: DataFrame) -> DataFrame:
    """``pair, fold, source, target``: symbols bound one to one by links of rows with source and target words."""
    one = links.select("pair", "fold", "source", "target", F.explode("links").alias("l")).where("l.s_len = 1 and l.t_len = 1")
    return one.select("pair", "fold", F.element_at("source", F.col("l.s_start") + 1).alias("source"), F.element_at("target", F.col("l.t_start") + 1).alias("target"))


def held_out(rows: DataFrame) -> DataFrame:
    """``pair, kind, observed, p, place, square, top`` of predicting ``rows(pair, fold, source, target)`` of each fold from the others of its pair.

    Counts of all folds are made once; what a fold leaves is their difference.  Inventories are a pair's own, of what
    its other folds hold, and one unknown category.
    """
    by = Window.partitionBy("pair", "fold", "source")
    each = rows.groupBy("pair", "fold", "source", "target").agg(F.count(F.lit(1)).alias("here"))
    whole = each.groupBy("pair", "source", "target").agg(F.sum("here").alias("all"))
    folds = each.select("pair", "fold", "source").distinct()
    held = each.groupBy("pair", "fold", "target").agg(F.sum("here").alias("t_here"))
    targets = each.groupBy("pair", "target").agg(F.sum("here").alias("t_all"))
    grid = folds.join(targets, "pair").join(held, ["pair", "fold", "target"], "left").withColumn("t_n", F.col("t_all") - F.coalesce("t_here", F.lit(0))).where("t_n > 0")
    grid = grid.join(whole, ["pair", "source", "target"], "left").join(each, ["pair", "fold", "source", "target"], "left")
    n = F.coalesce("all", F.lit(0)) - F.coalesce("here", F.lit(0))
    k = F.count(F.lit(1)).over(by)
    t_all = F.sum("t_n").over(by)
    grid = grid.withColumns({
        "unconditioned": (n + 1.0) / (F.sum(n).over(by) + k + 1), "inventory": (F.col("t_n") + 1.0) / (t_all + k + 1),
        "rest_unconditioned": 1.0 / (F.sum(n).over(by) + k + 1), "rest_inventory": 1.0 / (t_all + k + 1),
    })
    out = None
    for kind in ("unconditioned", "inventory"):
        p = F.col(kind)
        one = grid.withColumns({"place": F.row_number().over(by.orderBy(F.desc(kind), "target")), "square": F.sum(p * p).over(by), "top": F.max(p).over(by), "p": p, "kind": F.lit(kind)})
        seen = one.where("here is not null").select("pair", "kind", F.col("here").alias("observed"), "p", "place", "square", "top")
        # held-out symbols that training hasn't met: the unknown category's share
        rest = one.groupBy("pair", "fold", "source", "kind").agg(F.max(f"rest_{kind}").alias("p"), F.max("square").alias("square"), F.max("top").alias("top"))
        fresh = each.join(grid.select("pair", "fold", "source", "target"), ["pair", "fold", "source", "target"], "left_anti").join(rest, ["pair", "fold", "source"])
        fresh = fresh.select("pair", "kind", F.col("here").alias("observed"), "p", F.lit(None).cast("int").alias("place"), "square", "top")
        both = seen.unionByName(fresh)
        out = both if out is None else out.unionByName(both)
    return out


def predictive(sets: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``kind`` and scores of predicting each held-out target symbol from its source: log loss, top-1, top-k, Brier, abstention, calibration.

    Words are aligned once, symbol by symbol without a model, as held-out words
    are, so no fold's alignment depends on another's.
    """
    scratch = scratch or Scratch(sets.sparkSession, "evaluate")
    sets = scratch.keep(sets, "sets")
    dealt = folds(sets, k, scratch)
    pairs = scratch.keep(pairwise.form_pairs(sets).join(dealt, "set_id"), "pairs")
    words = align_pairs(pairs.select("source", "target").distinct(), prior_costs(distance, max_chunk=1))
    met = pairs.select(F.concat_ws(">", "lect_a", "lect_b").alias("pair"), "fold", "source", "target").join(words, ["source", "target"])
    rows = scratch.keep(held_out(scratch.keep(symbols(met), "symbols")), "held")
    out = None
    for kind in ("unconditioned", "inventory"):
        one = prediction.score(rows.where(F.col("kind") == kind)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


# --- models trained without a fold


def fold_name(fold, lect):
    """A lect of the training that leaves a fold out: folds are part of the lects' names, so all of them train side by side."""
    return F.concat_ws("/", fold.cast("string"), lect)


class FoldModels:
    """Training without each fold, at once: symbols, rules of both sides, and what they say of the fold that was left out.

    A fold's pairs are aligned symbol by symbol under the model that hasn't seen them.
    """

    def __init__(self, sets: DataFrame, k: int = 5, scorer: str = "bic"):
        self.k = k
        self.scratch = scratch = Scratch(sets.sparkSession, "folds")
        self.sets = scratch.keep(sets, "sets")
        pairs = scratch.keep(pairwise.form_pairs(self.sets).join(folds(self.sets, k, scratch), "set_id"), "pairs")
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: x != F.col("fold")))
        named = lambda rows: rows.withColumns({c: fold_name(F.col("without"), F.col(c)) for c in ("lect_a", "lect_b")})
        self.training = named(pairs.withColumn("without", others))
        self.left_out = named(pairs.withColumn("without", F.col("fold")))
        self.models = pairwise.trained(self.training)
        self.environments = scratch.keep(pairwise.word_environments(self.sets), "environments")
        singles = pairwise.single_links(pairwise.aligned(self.training, 1, self.models))
        self.rules = scratch.keep(pairwise.conditions(scratch.keep(singles, "singles"), self.environments, scorer), "rules")
        words = self.sets.select("lect_id", F.xxhash64("segments", "breaks", "syllables").alias("word"), F.posexplode("segments.grapheme").alias("pos", "grapheme")).distinct()
        every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        words = words.withColumn("without", every).select(fold_name(F.col("without"), F.col("lect_id")).alias("lect_id"), "word", "pos", "grapheme")
        self.holding = scratch.keep(pairwise.holding(self.rules, self.environments, words), "holding")

    @property
    def links(self) -> DataFrame:
        """Left-out pairs, aligned; symbols that the training hasn't met have their prior only."""
        by, zero = ["lect_a", "lect_b"], F.lit(0.0)
        met = self.left_out.select(*by, F.explode(F.array_union("source", "target")).alias("source")).distinct()
        new = met.join(self.models.where("kind = 'inventory'").select(*by, "source"), [*by, "source"], "left_anti")
        new = new.select(*by, "source", F.col("source").alias("target"), zero.alias("count"), zero.alias("source_total"), zero.alias("cost"), F.lit("inventory").alias("kind"))
        return pairwise.aligned(self.left_out, 1, self.models.select(*new.columns).unionByName(new))

    def observed(self) -> DataFrame:
        """``side, lect_a, lect_b, env, source, target, observed`` of both directions, summed; env: the counts of the rules that hold, by partner, or null."""
        singles = self.scratch.keep(pairwise.single_links(self.links), "left_out")
        out = None
        for side, own, other in (("source", "a", "b"), ("target", "b", "a")):
            held = self.holding.where(F.col("side") == side).select("lect_a", "lect_b", F.col("word").alias(f"{own}_word"), "rules")
            rows = singles.join(held, ["lect_a", "lect_b", f"{own}_word"], "left")
            here = F.filter("rules", lambda r: r["pos"] == F.col(f"{own}_pos"))
            env = F.when(F.size(here) > 0, F.array_sort(F.transform(here, lambda r: F.struct(r["partner"].alias("target"), r["count"].alias("m")))))
            one = rows.select(F.lit(side).alias("side"), "lect_a", "lect_b", env.alias("env"), F.col(f"{own}_seg.grapheme").alias("source"), F.col(f"{other}_seg.grapheme").alias("target"), "weight")
            out = one if out is None else out.unionByName(one)
        return out.groupBy("side", "lect_a", "lect_b", "env", "source", "target").agg(F.sum("weight").alias("observed"))

    def predictions(self, alpha: float = 1.0, tau: float = 1.0) -> DataFrame:
        """``kind, side, lect_a, lect_b, env, source, target, observed, p, place, square, top`` of what was left out, by the five kinds of ``prediction``."""
        by = ["side", "lect_a", "lect_b"]
        seen = self.scratch.keep(self.observed(), "observed")
        counted = self.models.where("kind = 'segment'").select("lect_a", "lect_b", "source", "target", "count")
        there = counted.select(F.lit("target").alias("side"), "lect_a", "lect_b", F.col("target").alias("source"), F.col("source").alias("target"), "count")
        counted = self.scratch.keep(counted.withColumn("side", F.lit("source")).unionByName(there), "counted")
        targets = counted.groupBy(*by, "target").agg(F.sum("count").alias("t_n"))
        unknown = targets.select(*by).distinct().select(*by, F.lit(prediction.UNKNOWN).alias("target"), F.lit(0.0).alias("t_n"))
        grid = seen.select(*by, "env", "source").distinct().join(targets.unionByName(unknown), by).join(counted, [*by, "source", "target"], "left")

        @F.pandas_udf("double")
        def apart(a, b):
            return a.combine(b, lambda x, y: 1.0 if y == prediction.UNKNOWN else distance(x, y))

        far = grid.select("source", "target").distinct().withColumn("d", apart("source", "target"))
        grid = grid.join(far, ["source", "target"])
        n = F.coalesce("count", F.lit(0.0))
        none = F.array().cast("array<struct<target:string,m:double>>")
        m = F.aggregate(F.coalesce("env", none), F.lit(0.0), lambda s, r: s + F.when(r["target"] == F.col("target"), r["m"]).otherwise(0.0))
        raw = {
            "conditioned": alpha + F.when(F.col("env").isNotNull(), m).otherwise(n), "unconditioned": alpha + n, "identity": F.when(F.col("source") == F.col("target"), 1.0).otherwise(1e-6),
            "inventory": F.col("t_n") + 1.0, "feature": F.exp(-F.col("d") / tau),
        }
        kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.greatest(c, F.lit(prediction.FLOOR)).alias("mass")) for k, c in raw.items()]))
        rows = grid.select(*by, "env", "source", "target", kinds.alias("x")).select(*by, "env", "source", "target", "x.*")
        context = Window.partitionBy("kind", *by, "env", "source")
        rows = rows.withColumn("p", F.col("mass") / F.sum("mass").over(context)).drop("mass")
        rows = rows.withColumns({"place": F.row_number().over(context.orderBy(F.desc("p"), "target")), "square": F.sum(F.col("p") * F.col("p")).over(context), "top": F.max("p").over(context)})
        # a symbol that the training never had is the unknown category
        known = targets.select(*by, "target", F.lit(True).alias("known"))
        told = seen.join(known, [*by, "target"], "left").withColumn("target", F.when(F.col("known"), F.col("target")).otherwise(prediction.UNKNOWN)).drop("known")
        told = told.groupBy(*by, "env", "source", "target").agg(F.sum("observed").alias("observed"))
        same = [F.equal_null(rows[c], told[c]) if c == "env" else rows[c] == told[c] for c in (*by, "env", "source", "target")]
        return rows.join(told, same).select("kind", *[rows[c] for c in (*by, "env", "source", "target")], "observed", "p", "place", "square", "top")

    def scores(self) -> DataFrame:
        """``kind`` and scores of all that was left out."""
        rows = self.scratch.keep(self.predictions(), "predictions")
        out = None
        for kind in prediction.KINDS:
            one = prediction.score(rows.where(F.col("kind") == kind)).withColumn("kind", F.lit(kind))
            out = one if out is None else out.unionByName(one)
        return out

    def confirmed(self, full: DataFrame) -> DataFrame:
        """Rules of the whole corpus (``pairwise.conditions``) with the verdict of what the same rules, found without a fold, gain on it over unconditioned counts."""
        rows = self.scratch.keep(self.predictions(), "gains").where("kind in ('conditioned', 'unconditioned') and env is not null")
        by = ["side", "lect_a", "lect_b", "source", "target"]
        both = rows.groupBy(*by, "env").agg(F.sum(F.when(F.col("kind") == "conditioned", F.col("observed"))).alias("observed"), F.sum(F.when(F.col("kind") == "conditioned", F.ln("p")).otherwise(-F.ln("p"))).alias("gain"))
        lect = lambda c: F.expr(f"substr({c}, instr({c}, '/') + 1)")
        fold = F.split_part("lect_a", F.lit("/"), F.lit(1)).cast("int")
        held = both.select(fold.alias("fold"), lect("lect_a").alias("lect_a"), lect("lect_b").alias("lect_b"), "side", F.col("source").alias("pivot"), F.col("target").alias("partner"), "observed", "gain")
        return prediction.confirmed(full, held, ["lect_a", "lect_b", "side", "pivot", "partner"])
