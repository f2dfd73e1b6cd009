"""Training: from a corpus of sets to counts, classes, conditioned classes, changes, fit and outliers."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.operators import chunks, classes, contexts, counts, crossdim, pairwise, splits, tables
from lautwerk.operators.graph import Scratch
from lautwerk.operators.resampling import dealt, draw
from lautwerk.sources import corpus


@dataclass(frozen=True)
class Options:
    max_chunk: int = 3
    null_draws: int = classes.DRAWS
    #: Shuffled copies of the corpus that the baseline trains on.
    permutations: int = 0
    #: Draws of the classes' intervals, and what is drawn as a whole: auto, etymon_group, source_group or set.
    bootstrap: int = 200
    bootstrap_unit: str = "auto"
    #: Whether searches pay for the number of their candidates.
    charge: bool = True
    seed: int = 20260815
    min_lects: int = 2
    #: bic, nml or dirichlet: how splits are scored.
    scorer: str = "bic"
    #: Least count of a cross-dimensional rule's value, and rounds of its search.
    cross_least: float = crossdim.LEAST
    cross_rounds: int = crossdim.ROUNDS
    #: Whether rules found on the first alignment price the second.
    feedback: bool = True

    @classmethod
    def of(cls, values: dict) -> Options:
        """From a flat mapping; a key that isn't known is refused by name."""
        known = {f.name for f in fields(cls)}
        for k in values:
            if k not in known:
                raise ValueError(f"unknown option: {k}")
        if values.get("scorer", "bic") not in splits.SCORERS:
            raise ValueError(f"scorer must be one of {splits.SCORERS}")
        if values.get("bootstrap_unit", "auto") not in tables.UNITS:
            raise ValueError(f"bootstrap_unit must be one of {tables.UNITS}")
        return cls(**values)


class Cancelled(RuntimeError):
    """A run that was ended by its progress function or by ``cancel``, in or after the stage named."""


class Model:
    """Tables of a run.  What several of them read is written into the shared folder once; the rest is computed when it is read."""

    def __init__(self, sets: DataFrame, options: Options):
        self.options = options
        self.scratch = Scratch(sets.sparkSession, "train")
        self.tag = f"train-{uuid.uuid4().hex}"
        self._stop = threading.Event()
        self.sets = self.scratch.keep(sets, "sets")

    @property
    def stages(self) -> list[str]:
        """Names of the tables that a run writes, in their order."""
        out = ["pairs", "models", "first_links", "environments", "singles", "pair_rules", "cross", "links", "observations", "conditioned"]
        skipped = () if self.options.feedback else ("singles", "pair_rules", "cross")
        return [s for s in out if s not in skipped] + ["baseline"] * (self.options.permutations > 0)

    def run(self, progress: Callable[[str, int, int], bool | None] | None = None) -> Model:
        """Write all tables, stage by stage.

        progress: called after each with its name, its number and how many there
        are; what it returns as true cancels the run.  Stages that are written stay, so
        another run goes on from there.
        """
        context = self.sets.sparkSession.sparkContext
        self._stop.clear()
        for done, name in enumerate(self.stages, 1):
            context.addJobTag(self.tag)
            try:
                getattr(self, name)
            except Exception as error:
                if self._stop.is_set():
                    raise Cancelled(name) from error
                raise
            finally:
                context.removeJobTag(self.tag)
            if progress is not None and progress(name, done, len(self.stages)):
                self._stop.set()
            if self._stop.is_set():
                raise Cancelled(name)
        return self

    def cancel(self) -> None:
        """End a run from another thread: its jobs are cancelled by their tag, other jobs of the session go on."""
        self._stop.set()
        self.sets.sparkSession.sparkContext.cancelJobsWithTag(self.tag)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.scratch.keep(pairwise.form_pairs(self.sets), "pairs")

    @cached_property
    def models(self) -> DataFrame:
        return self.scratch.keep(pairwise.trained(self.pairs, max_chunk=self.options.max_chunk), "models")

    @cached_property
    def first_links(self) -> DataFrame:
        """Links under symbols and chunks alone, which rules are searched on."""
        return self.scratch.keep(pairwise.aligned(self.pairs, self.options.max_chunk, self.models), "first")

    @cached_property
    def environments(self) -> DataFrame:
        return self.scratch.keep(pairwise.word_environments(self.sets), "environments")

    @cached_property
    def singles(self) -> DataFrame:
        return self.scratch.keep(pairwise.single_links(self.first_links), "singles")

    @cached_property
    def words(self) -> DataFrame:
        """``lect_id, word, form`` of the distinct words of each lect."""
        return self.sets.select("lect_id", F.xxhash64("segments", "breaks", "syllables").alias("word"), F.col("segments").alias("form")).dropDuplicates(["lect_id", "word"])

    @cached_property
    def pair_rules(self) -> DataFrame:
        """Rules of each pair of lects, conditioned by either side's environment."""
        return self.scratch.keep(pairwise.conditions(self.singles, self.environments, self.options.scorer), "rules")

    @property
    def tones(self) -> DataFrame:
        toned = self.singles.where("a_seg.tone <> '' or b_seg.tone <> ''")
        return toned.groupBy("lect_a", "lect_b", F.col("a_seg.tone").alias("source_tone"), F.col("b_seg.tone").alias("target_tone")).agg(F.sum("weight").alias("count"))

    @cached_property
    def cross(self) -> DataFrame:
        """Cross-dimensional rules of every pair, pass and dimension; those within a lect once, from the pair of the largest mass."""
        seen = crossdim.contexts_of(self.singles, self.words.dropDuplicates(["word"]).select("word", "form"))
        rows = self.scratch.keep(crossdim.discovered(seen, self.options.cross_least, self.options.cross_rounds, self.options.scorer), "cross")
        rows = rows.where(crossdim.publishable(F.col("environment"), "dimension"))
        lect = F.when(F.col("context_is_target"), F.col("lect_b")).otherwise(F.col("lect_a"))
        inner = rows.where("lect_internal").withColumns({"lect": lect, "pair": F.concat_ws(">", "lect_a", "lect_b")})
        return rows.where("not lect_internal").unionByName(crossdim.lifted(inner, ["lect", "environment", "dimension", "value"]).drop("lect", "pair"))

    @cached_property
    def links(self) -> DataFrame:
        """Links that follow the rules of the first ones: conditioned symbols, tones, cross-dimensional rules."""
        if not self.options.feedback:
            return self.first_links
        places = self.words.select("lect_id", "word", F.posexplode("form.grapheme").alias("pos", "grapheme"))
        rules = self.scratch.keep(pairwise.holding(pairwise.shared(self.pair_rules, self.models), self.environments, places), "holding")
        return self.scratch.keep(pairwise.aligned(self.pairs, self.options.max_chunk, self.models, rules, self.tones, self.cross), "links")

    @cached_property
    def positions(self) -> DataFrame:
        return self.scratch.keep(tables.bound(self.links, self.sets), "positions")

    @cached_property
    def observations(self) -> DataFrame:
        return self.scratch.keep(classes.reconciled(self.links, self.sets), "observations")

    @cached_property
    def conditioned(self) -> DataFrame:
        return self.scratch.keep(classes.conditioned(self.observations, self.sets, self.options.null_draws, self.options.seed, self.options.scorer, self.environments, self.options.charge), "conditioned")

    @property
    def segments(self) -> DataFrame:
        one = self.positions.where("source is not null and target is not null").select("lect_a", "lect_b", F.col("source.grapheme").alias("source"), F.col("target.grapheme").alias("target"), "weight")
        return counts.pair_counts(one, F.col("weight"), ["lect_a", "lect_b"])

    @property
    def chunks(self) -> DataFrame:
        return self.models.where("kind = 'chunk'").drop("kind", "count", "source_total")

    @property
    def gaps(self) -> DataFrame:
        return tables.gap_rows(self.positions)

    @property
    def chunk_report(self) -> DataFrame:
        """Promoted chunks taken apart: what their parts are, the process, how plainly they read, how many others lie within."""
        return chunks.diagnosed(self.models)

    @property
    def classes(self) -> DataFrame:
        return classes.buckets(self.observations)

    @cached_property
    def intervals(self) -> DataFrame:
        """``tuple, low, high`` of unconditioned and conditioned classes, by drawing observation groups anew."""
        environments, names = contexts.coded(self.environments)
        rows = classes.pivot_rows(self.observations, self.sets, environments)
        held = classes.conditioned_masses(rows, self.conditioned, ["set_id"], names)
        found = tables.class_intervals(self.observations, self.options.bootstrap, sets=self.sets, unit=self.options.bootstrap_unit, conditioned=held, seed=self.options.seed)
        return self.scratch.keep(found, "intervals")

    @property
    def merged(self) -> DataFrame:
        """Conditioned classes in which what several lects' pivots found of one correspondence is one row."""
        return classes.merged_over_pivots(self.observations, self.sets, self.conditioned, self.environments)

    @cached_property
    def baseline(self) -> DataFrame | None:
        """What training finds in shuffled copies of the corpus; None without permutations."""
        if self.options.permutations < 1:
            return None
        return self.scratch.keep(baseline(null_models(self.sets, self.options.permutations, self.options)), "baseline")

    @property
    def events(self) -> DataFrame:
        return classes.events(self.conditioned, self.sets)

    @property
    def outliers(self) -> DataFrame:
        return classes.cost_outliers(pairwise.set_costs(self.links))

    def fit(self) -> DataFrame:
        """One row: lects, sets, pairs, mean cost per segment, numbers of rules and of those above noise, of forms with syllables and of those whose nucleus was inferred."""
        costs = pairwise.set_costs(self.links)
        one = self.sets.agg(F.count_distinct("lect_id").alias("lects"), F.count_distinct("set_id").alias("sets"))
        cost = costs.agg(F.avg("cost").alias("cost_per_segment"), F.sum("pairs").alias("pairs"))
        rules = self.conditioned.agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("standing") == "above_noise").alias("above_noise"))
        return one.crossJoin(cost).crossJoin(rules).crossJoin(contexts.syllable_counts(self.sets))

    def provenance(self) -> dict:
        """Options and an order-free checksum of the corpus: a sum of row hashes, to which equal rows add up."""
        row = checksum(self.sets).first()
        return {"options": asdict(self.options), "checksum": row.checksum, "forms": row.forms}


def checksum(sets: DataFrame) -> DataFrame:
    """One row: ``checksum, forms``; the sum of md5 prefixes of the rows, modulo 2 ** 61."""
    text = F.concat_ws("|", "set_id", "lect_id", F.array_join("segments.grapheme", " "), F.col("confidence").cast("double").cast("string"), "etymon_group")
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("decimal(20,0)")
    return sets.agg(F.lower(F.hex((F.sum(part) % F.lit(2**61).cast("decimal(20,0)")).cast("long"))).alias("checksum"), F.count(F.lit(1)).alias("forms"))


def train(forms: DataFrame, options: Options | None = None) -> Model:
    """All tables from loaded forms; refuses empty forms and confidences outside 0..1."""
    options = options or Options()
    clash = corpus.label_conflicts(forms).first()
    if clash is not None:
        raise ValueError(f"set {clash.cognate_id}: {clash.label} is {clash.first} and {clash.last}")
    model = train_sets(corpus.publish(forms, options.min_lects), options)
    wrong = corpus.faults(model.sets).select("set_id").first()
    if wrong is not None:
        raise ValueError(f"set {wrong.set_id}: empty form or confidence outside 0..1")
    return model


def train_sets(sets: DataFrame, options: Options) -> Model:
    return Model(sets, options)


def shuffled_sets(sets: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """``replicate`` copies of the corpus in which each lect's forms are dealt anew over the sets that have it, by a digest.

    What belongs to a form (breaks, syllables) goes with it; a set's confidence and groups stay.
    """
    of_form = [c for c in ("segments", "breaks", "syllables") if c in sets.columns]
    of_set = [c for c in sets.columns if c not in ("lect_id", *of_form)]
    slot = draw(F.lit("slot"), F.concat_ws("|", "lect_id", "set_id"))
    slots = dealt(sets.select("lect_id", *of_set), ["lect_id"], slot, "set_id", "place")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("replicate")
    words = sets.select("lect_id", "set_id", *of_form, every)
    own = draw(F.lit(seed), F.col("replicate"), F.concat_ws("|", "lect_id", "set_id"))
    words = dealt(words, ["replicate", "lect_id"], own, "set_id", "place").drop("set_id")
    return words.join(slots, ["lect_id", "place"]).drop("place")


def null_models(sets: DataFrame, replicates: int, options: Options) -> Model:
    """One training over all shuffled copies: a copy's number is part of its sets' and lects' names, so copies train side by side and never meet.

    Searches aren't charged for their size: what they reach by chance is what is asked.
    """
    mixed = shuffled_sets(sets, replicates, options.seed)
    number = F.col("replicate").cast("string")
    named = {c: F.concat_ws("/", number, c) for c in ("set_id", "lect_id")}
    named |= {c: F.when(F.col(c) != "", F.concat_ws("/", number, c)).otherwise(F.col(c)) for c in ("etymon_group", "source_group") if c in sets.columns}
    mixed = mixed.withColumns(named).drop("replicate")
    return Model(mixed, replace(options, permutations=0, null_draws=0, charge=False))


def replicate_of(name: Column | str) -> Column:
    return F.split_part(F.col(name) if isinstance(name, str) else name, F.lit("/"), F.lit(1)).cast("long")


def null_runs(model: Model) -> DataFrame:
    """``replicate, cost, unconditioned, conditioned``: mean cost per segment and numbers of classes of each shuffled copy of ``null_models``."""
    costs = pairwise.set_costs(model.links).groupBy(replicate_of("set_id").alias("replicate")).agg(F.avg("cost").alias("cost"))
    lect = F.split_part("tuple", F.lit("="), F.lit(1))
    bare = model.classes.groupBy(replicate_of(lect).alias("replicate")).agg(F.count(F.lit(1)).alias("unconditioned"))
    held = model.conditioned.groupBy(replicate_of("pivot_lect").alias("replicate")).agg(F.count(F.lit(1)).alias("conditioned"))
    rows = costs.join(bare, "replicate", "left").join(held, "replicate", "left")
    return rows.select("replicate", "cost", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("unconditioned", "conditioned")])


QUANTILE = 0.95


def baseline(model: Model) -> DataFrame:
    """One row: ``runs, cost_mean, cost_sd, unconditioned_mean, conditioned_mean, search_margin``: what training finds where no forms correspond.

    search_margin: the margin at place floor(0.95 n), from 0, of all n rules of the shuffled copies in order; null without rules.
    """
    runs = null_runs(model).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("cost").alias("cost_mean"), F.coalesce(F.stddev_samp("cost"), F.lit(0.0)).alias("cost_sd"),
        F.avg("unconditioned").alias("unconditioned_mean"), F.avg("conditioned").alias("conditioned_mean"),
    )
    return runs.crossJoin(margin_at(model.conditioned, QUANTILE))


def margin_at(rules: DataFrame, quantile: float) -> DataFrame:
    """``search_margin``: the margin at place floor(quantile * n); equal margins are counted first."""
    counted = rules.groupBy("margin").agg(F.count(F.lit(1)).alias("n"))
    # distinct margins of classes: as many rows as inventories and replicates give
    upto = counted.select("margin", F.sum("n").over(Window.orderBy("margin")).alias("upto"))
    n = rules.agg(F.count(F.lit(1)).alias("n"))
    at = F.least(F.floor(F.lit(quantile) * F.col("n")), F.col("n") - 1)
    return upto.crossJoin(F.broadcast(n)).where(F.col("upto") > at).agg(F.min("margin").alias("search_margin"))


def null_costs(sets: DataFrame, replicates: int, max_chunk: int = 3) -> DataFrame:
    """``replicate, cost``: the mean cost per segment after training on each shuffled corpus, replicates side by side."""
    mixed = shuffled_sets(sets, replicates).withColumn("set_id", F.concat_ws("/", F.col("replicate").cast("string"), "set_id"))
    pairs = pairwise.form_pairs(mixed).withColumn("lect_a", F.concat_ws("/", F.split_part("set_id", F.lit("/"), F.lit(1)), "lect_a"))
    costs = pairwise.set_costs(pairwise.aligned(pairs, max_chunk))
    return costs.groupBy(replicate_of("set_id").alias("replicate")).agg(F.avg("cost").alias("cost"))
