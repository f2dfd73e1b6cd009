"""Multi-way classes: pairwise links reconciled within each set, classes counted, and environments that condition them."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.functions.features import features
from lautwerk.operators import splits
from lautwerk.operators.alignment import GAP
from lautwerk.operators.contexts import coded, codes_of, described
from lautwerk.operators.counts import published
from lautwerk.operators.grouping import group_weights
from lautwerk.operators.pairwise import word_environments

# Gates of the search.
MIN_IMMEDIATE, MIN_LONG, DOMINANT, DEPTH, MAX_COMMITS, DRAWS, RIVALS = 3, 5, 0.6, 3, 12, 99, 8
EPSILON = 1e-12


def reconciled(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_id, weight, members`` (lect, position, grapheme): components of linked positions of a set.

    Components with two positions of one lect, or of one lect only, are left
    out; a kept segment that a lect has lost gets that lect's gap as a member.
    Sets of the same words are reconciled once, on the first of them.
    """
    name = F.xxhash64("segments", "breaks", "syllables") if "breaks" in sets.columns else F.xxhash64("segments")
    forms = sets.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("lect_id", name.alias("word")))).alias("forms"))
    first = forms.groupBy("forms").agg(F.min("set_id").alias("first"))
    whose = forms.join(first, "forms").select("set_id", "first")
    own = first.select(F.col("first").alias("set_id"))
    words = sets.join(own, "set_id", "left_semi").groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("lect_id", F.col("segments.grapheme")))).alias("words"))
    base = sets.select("set_id", "confidence", "etymon_group").distinct()
    shares = group_weights(base.where("etymon_group <> ''"), F.col("etymon_group"), "set_id").select("set_id", F.col("weight").alias("share"))
    weights = base.join(shares, "set_id", "left").select("set_id", (F.col("confidence") * F.coalesce("share", F.lit(1.0))).alias("weight"))
    each = links.join(own, "set_id", "left_semi").groupBy("set_id")
    grouped = each.agg(F.collect_list(F.struct("lect_a", "lect_b", F.col("flat" if "flat" in links.columns else "links").alias("links"))).alias("all")).join(words, "set_id")
    schema = "first string, members array<struct<lect:string,pos:int,grapheme:string>>"

    def kernel(batches):
        from lautwerk.operators.pairwise import bound_positions

        for pdf in batches:
            out = []
            for i, every, held in zip(pdf["set_id"], pdf["all"], pdf["words"]):
                held = dict(held)
                parent = {(lect, k): (lect, k) for lect, word in held.items() for k in range(len(word))}

                def root(x):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                lost = defaultdict(set)
                for e in every:
                    a, b = e["lect_a"], e["lect_b"]
                    spans = [tuple(x[c] for c in ("s_start", "s_len", "t_start", "t_len")) for x in e["links"]]
                    pairs, gaps, _ = bound_positions(spans, list(held[a]), list(held[b]))
                    for p, q in pairs:
                        x, y = root((a, p)), root((b, q))
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                    for p, q in gaps:
                        lost[(a, p) if q is None else (b, q)].add(b if q is None else a)
                groups = defaultdict(list)
                for x in sorted(parent):
                    groups[root(x)].append(x)
                for own in groups.values():
                    lects = [lect for lect, _ in own]
                    if len(set(lects)) < len(lects):
                        continue
                    members = [(lect, k, held[lect][k]) for lect, k in own]
                    members += [(lect, -1, GAP) for lect in sorted(set().union(*(lost[x] for x in own)) - set(lects))]
                    if len(members) > 1:
                        out.append((i, [dict(zip(("lect", "pos", "grapheme"), m)) for m in sorted(members)]))
            yield pd.DataFrame(out, columns=["first", "members"])

    return whose.join(grouped.mapInPandas(kernel, schema), "first").join(weights, "set_id").select("set_id", "weight", "members")


def buckets(observations: DataFrame) -> DataFrame:
    """Classes: tuples of (lect, grapheme) with their mass, sets, and share of what their lects hold, in publication order."""
    key = F.transform("members", lambda m: F.concat_ws("=", m["lect"], m["grapheme"]))
    lects = F.array_join(F.transform("members", lambda m: m["lect"]), ",")
    rows = observations.select("set_id", "weight", F.array_join(key, " ~ ").alias("tuple"), lects.alias("lects"))
    rows = rows.groupBy("tuple", "lects").agg(F.sum("weight").alias("count"), F.count_distinct("set_id").alias("sets"))
    return published(rows.withColumn("rate", F.col("count") / F.sum("count").over(Window.partitionBy("lects"))))


class Bucket:
    """Weighted observations of one pivot: sets of tokens, and the outcome of each sister lect.

    All tokens are scored together: a matrix of tokens by observations times the masses of the outcomes, a block of
    observations at a time.
    """

    BLOCK = 1 << 14

    def __init__(self, tokens: list, outcomes: list[dict], weight: np.ndarray, scorer: str = "bic", charge: bool = True):
        self.outcomes, self.weight, self.scorer = outcomes, weight, scorer
        self.sisters = sorted({lect for o in outcomes for lect in o})
        names = sorted({t for own in tokens for t in own})
        place = {t: k for k, t in enumerate(names)}
        held = np.zeros((len(names), len(tokens)), bool)
        for k, own in enumerate(tokens):
            held[[place[t] for t in own], k] = True
        some = held.any(1) & ~held.all(1)
        self.names, self.held = [t for t, ok in zip(names, some) if ok], held[some]
        self.long = np.array([t.startswith(("somewhere", "preceding@", "following@", "syllable")) for t in self.names], bool)
        self.partitions = max(1, len({(h if h[0] else ~h).tobytes() for h in self.held})) if charge else 1
        self.codes, self.kinds = {}, {}
        for lect in self.sisters:
            values = sorted({o[lect] for o in outcomes if lect in o})
            at = {v: k for k, v in enumerate(values)}
            self.codes[lect] = np.array([at.get(o.get(lect), -1) for o in outcomes])
            self.kinds[lect] = len(values)

    def inside(self, masses: np.ndarray) -> np.ndarray:
        """Masses (observations by columns) summed over what each token holds."""
        out = np.zeros((len(self.names), masses.shape[1]))
        for k in range(0, len(masses), self.BLOCK):
            out += self.held[:, k : k + self.BLOCK].astype(float) @ masses[k : k + self.BLOCK]
        return out

    def masses(self, live: np.ndarray) -> np.ndarray:
        """A column for all live mass, then those of each sister's outcomes."""
        columns = [(self.weight * live)[:, None]]
        for lect in self.sisters:
            own = np.zeros((len(live), self.kinds[lect]))
            ok = live & (self.codes[lect] >= 0)
            own[np.flatnonzero(ok), self.codes[lect][ok]] = self.weight[ok]
            columns.append(own)
        return np.hstack(columns)

    def scored(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each predicate's score with the charge for the search, and whether it passes all gates."""
        masses = self.masses(live)
        whole, inside = masses.sum(0), self.inside(masses)
        n_in, n_out = inside[:, 0], whole[0] - inside[:, 0]
        ok = np.minimum(n_in, n_out) >= np.where(self.long, MIN_LONG, MIN_IMMEDIATE) - EPSILON
        delta, used, top, at = np.zeros(len(n_in)), np.zeros(len(n_in), bool), np.zeros(len(n_in)), 1
        for lect in self.sisters:
            k = self.kinds[lect]
            own, all_ = inside[:, at : at + k], whole[at : at + k]
            at += k
            mass, n = own.sum(1), all_.sum()
            top = np.maximum(top, np.divide(own.max(1), mass, out=np.zeros(len(mass)), where=mass > EPSILON))
            both = (mass > EPSILON) & (n - mass > EPSILON)
            if k < 2 or not both.any():
                continue
            rest = np.maximum(all_ - own, 0.0)
            rest[rest < EPSILON] = 0.0
            gain = 2 * (row_codes(own, self.scorer) + row_codes(rest, self.scorer) - row_codes(all_[None, :], self.scorer))
            if self.scorer == "bic":
                gain = gain + (k - 1) * math.log(max(2.0, n))
            delta, used = delta + np.where(both, gain, 0.0), used | both
        delta = delta + 2 * math.log(self.partitions)
        return delta, ok & used & (delta < -EPSILON) & (~self.long | (top >= DOMINANT))

    def ordered(self, live: np.ndarray, delta: np.ndarray, ok: np.ndarray) -> list[int]:
        """Predicates that pass, best first: by score, ties by kind, mass and name."""
        count = self.inside(live[:, None].astype(float))[:, 0]
        return sorted(np.flatnonzero(ok), key=lambda k: (round(delta[k], 9), self.long[k], int(count[k]), self.names[k]))

    def best(self, live: np.ndarray) -> tuple[str, float] | None:
        """The predicate of the least score below zero."""
        if not self.names:
            return None
        delta, ok = self.scored(live)
        won = self.ordered(live, delta, ok)
        return (self.names[won[0]], float(delta[won[0]])) if won else None

    def rivals(self, live: np.ndarray, winner: str) -> tuple[list[str], list[str]]:
        """Predicates at other slots than the winner's that would have been committed too: those that divide the live rows alike, and of those that divide them otherwise the strongest, one of each division."""
        delta, ok = self.scored(live)
        slot = lambda name: name.split(":", 1)[0]
        mark = lambda h: np.packbits(h if h[0] else ~h).tobytes()
        own = mark(self.held[self.names.index(winner)][live])
        alike, others = [], {}
        for k in self.ordered(live, delta, ok):
            if slot(self.names[k]) != slot(winner):
                division = mark(self.held[k][live])
                if division == own:
                    alike.append(self.names[k])
                else:
                    others.setdefault(division, self.names[k])
        return alike, list(others.values())[:RIVALS]

    def rules(self, depth: int = DEPTH, commits: int = MAX_COMMITS) -> list[tuple[list[str], np.ndarray, float, list[str], list[str]]]:
        """Decision list: commit what the best predicate holds, refined by further ones, and go on with the rest.

        Each with its tokens, rows, margin, and the rivals of its first predicate on what was left then.
        """
        live, out, column = np.ones(len(self.weight), bool), [], dict(zip(self.names, self.held))
        while len(out) < commits:
            won = self.best(live)
            if won is None:
                break
            tokens, inside, margin = [won[0]], live & column[won[0]], -won[1]
            alike, others = self.rivals(live, won[0])
            while len(tokens) < depth and (more := self.best(inside)):
                tokens.append(more[0])
                inside = inside & column[more[0]]
            out.append((sorted(tokens), inside, margin, alike, others))
            live = live & ~inside
        return out

    def null_margin(self, rng: np.random.Generator, draws: int = DRAWS) -> np.ndarray:
        """Largest margins when contexts are dealt anew among the observations."""
        codes, out = self.codes, []
        whole = np.ones(len(self.weight), bool)
        for _ in range(draws):
            order = rng.permutation(len(self.weight))
            self.codes = {lect: c[order] for lect, c in codes.items()}
            won = self.best(whole)
            out.append(-won[1] if won else 0.0)
        self.codes = codes
        return np.array(out)


def _cost(mass: np.ndarray) -> float:
    mass = mass[mass > 0]
    return float(mass.sum() * math.log(mass.sum()) - (mass * np.log(mass)).sum()) if len(mass) else 0.0


def _nml(mass: np.ndarray) -> float:
    """Stochastic complexity: the likelihood's code, and the logarithm of its normaliser by the recurrence over outcomes."""
    return _cost(mass) + _normalizer(int(round(mass.sum())), len(mass))


@lru_cache(maxsize=1 << 16)
def _normalizer(n: int, kinds: int) -> float:
    if n < 1 or kinds < 2:
        return 0.0
    root = math.sqrt(math.pi / 2 * n)
    if n > 1000:
        here = root + 2 / 3 + root / (12 * n) - 4 / (135 * n) + root / (288 * n * n) + 8 / (2835 * n * n)
    else:
        h = np.arange(n + 1, dtype=float)
        gamma = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
        x = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0.0)
        here = float(np.exp(gamma[n] - gamma - gamma[::-1] + x(h) + x(n - h) - n * math.log(n)).sum())
    below = 1.0
    for k in range(3, kinds + 1):
        below, here = here, here + n / (k - 2) * below
    return math.log(here)


def _dirichlet(mass: np.ndarray) -> float:
    """Negative log marginal likelihood under a symmetric prior of the group's own mass."""
    n, g = mass.sum(), math.lgamma
    each = n / len(mass)
    return g(2 * n) - g(n) - sum(g(c + each) - g(each) for c in mass) if n > 0 else 0.0


def row_codes(mass: np.ndarray, scorer: str) -> np.ndarray:
    """Code length of each row of masses."""
    if scorer == "dirichlet":
        return np.array([_dirichlet(m) for m in mass])
    x = lambda v: np.where(v > 0, v * np.log(np.where(v > 0, v, 1.0)), 0.0)
    out = x(mass.sum(1)) - x(mass).sum(1)
    return out + np.array([_normalizer(int(round(n)), mass.shape[1]) for n in mass.sum(1)]) if scorer == "nml" else out


#: Code length of the masses of a group, by the name of the scorer.
CODES = {"bic": _cost, "nml": _nml, "dirichlet": _dirichlet}


def _top(codes: np.ndarray, weight: np.ndarray, at: np.ndarray) -> float:
    ok = at & (codes >= 0)
    return float(np.bincount(codes[ok], weight[ok]).max() / weight[ok].sum()) if ok.any() else 0.0


RULES = "pivot_lect string, pivot string, decision int, environment string, outcome string, count double, rate double, contrast_count double, contrast_rate double, margin double, p_value double, standing string, alike array<string>, rivals array<string>"


def pivot_rows(observations: DataFrame, sets: DataFrame, held: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """``set_id, pivot_lect, pivot, tokens, sisters, weight, keep..``: each position with a sister's symbol, as a pivot in its environment.

    Environments are looked up by distinct words; keep: further columns of the observations.  Of ``coded`` environments
    tokens are numbers.
    """
    held = word_environments(sets) if held is None else held
    rows = pivot_places(observations, sets, keep).join(held, ["word", "pos"])
    return rows.select("set_id", "pivot_lect", "pivot", "tokens", "sisters", "weight", *keep)


def pivot_places(observations: DataFrame, sets: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``set_id, pivot_lect, pivot, word, pos, sisters, weight, keep..`` of the rows of ``pivot_rows``."""
    form = F.xxhash64("segments", "breaks", "syllables")
    rows = observations.select("set_id", "weight", "members", *keep, F.explode("members").alias("m")).where(F.col("m.pos") >= 0)
    rows = rows.select("set_id", "weight", *keep, F.col("m.lect").alias("pivot_lect"), F.col("m.pos").alias("pos"), F.col("m.grapheme").alias("pivot"), "members")
    named = sets.select("set_id", F.col("lect_id").alias("pivot_lect"), form.alias("word"))
    rows = rows.join(named, ["set_id", "pivot_lect"])
    sisters = F.filter("members", lambda m: (m["lect"] != F.col("pivot_lect")) & (m["grapheme"] != GAP))
    rows = rows.withColumn("sisters", F.transform(sisters, lambda m: F.struct(m["lect"].alias("lect"), m["grapheme"].alias("grapheme")))).where("size(sisters) > 0")
    return rows.select("set_id", "pivot_lect", "pivot", "word", "pos", "sisters", "weight", *keep)


def conditioned(observations: DataFrame, sets: DataFrame, draws: int = DRAWS, seed: int = 20260815, scorer: str = "bic", held: DataFrame | None = None, charge: bool = True) -> DataFrame:
    """Conditioned classes of every pivot (lect, grapheme): environment, sister outcome, contrast outside, and verdict against permuted contexts."""
    held, names = coded(word_environments(sets) if held is None else held)
    rows = pivot_places(observations, sets).groupBy("pivot_lect", "pivot", "word", "pos", "sisters").agg(F.sum("weight").alias("weight"))
    return searched(rows.join(held, ["word", "pos"]), draws, seed, scorer=scorer, charge=charge, names=names)


def decided(rows: DataFrame, rules: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """``by.., pivot_lect, pivot, decision, environment, outcome, n``: rows (``pivot_rows``) under the first decision of their pivot whose environment holds, where their outcome is published.

    Rows that agree are summed first; a pivot's decisions are at most
    MAX_COMMITS, and meet them in one join.  names: those of the rows' tokens, if they are ``coded``.
    """
    rows = rows.groupBy(*by, "pivot_lect", "pivot", "tokens", "sisters").agg(F.sum("weight").alias("weight"))
    lists = rules.select("pivot_lect", "pivot", "decision", F.split("environment", ";").alias("environment")).distinct()
    if names is not None:
        lists = lists.withColumn("environment", codes_of("environment", names))
    lists = lists.groupBy("pivot_lect", "pivot").agg(F.array_sort(F.collect_list(F.struct("decision", "environment"))).alias("decisions"))
    first = F.filter("decisions", lambda r: F.size(F.array_except(r["environment"], F.col("tokens"))) == 0)
    named = F.array_join(F.transform(F.array_sort("sisters"), lambda m: F.concat_ws("=", m["lect"], m["grapheme"])), " ")
    met = rows.join(lists, ["pivot_lect", "pivot"]).select(*by, "pivot_lect", "pivot", F.try_element_at(first, F.lit(1)).alias("d"), named.alias("outcome"), "weight")
    known = rules.select("pivot_lect", "pivot", "decision", "environment", "outcome")
    met = met.where("d is not null").withColumn("decision", F.col("d.decision")).join(known, ["pivot_lect", "pivot", "decision", "outcome"])
    return met.groupBy(*by, "pivot_lect", "pivot", "decision", "environment", "outcome").agg(F.sum("weight").alias("n"))


def conditioned_masses(rows: DataFrame, rules: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """``by.., tuple, n``: the mass of ``rows`` (``pivot_rows``) that each conditioned class holds."""
    return decided(rows, rules, by, names).groupBy(*by, conditioned_key().alias("tuple")).agg(F.sum("n").alias("n"))


def merged_over_pivots(observations: DataFrame, sets: DataFrame, rules: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``tuple, environments, splits, count, rate, contrast_count, contrast_rate, margin, p_value, standing``: conditioned classes, of which one found from several lects' pivots is one row.

    Of splits with the same correspondence, a later one (by pivot, then
    decision) whose observations an earlier one holds only restates it: its
    environment joins the earlier's, its figures don't.  One that brings any
    observation of its own stays by itself.  Observations are told apart by
    words and places, so what is compared grows with the vocabulary.
    """
    form = F.xxhash64("segments", "breaks", "syllables")
    forms = sets.groupBy("set_id").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("lect_id", form.alias("word"))))).alias("forms"))
    seen = observations.join(forms, "set_id").withColumn("obs", F.xxhash64("forms", "members"))
    key = F.array_join(F.array_sort(F.concat(F.split("outcome", " "), F.array(F.concat_ws("=", "pivot_lect", "pivot")))), " ~ ")
    split = F.struct("pivot_lect", "pivot", "decision", "outcome")
    held, names = coded(word_environments(sets) if held is None else held)
    rows = decided(pivot_rows(seen, sets, held, ["obs"]).drop("set_id"), rules, ["obs"], names).select(key.alias("key"), split.alias("decision"), "obs")
    into = splits.merged(rows).select("key", "decision", "into")
    own = rules.withColumns({"key": key, "decision": split})
    environments = own.select("key", "decision", "pivot_lect", "environment").join(into, ["key", "decision"])
    environments = environments.groupBy("key", "into").agg(F.array_sort(F.collect_set(F.concat(F.col("pivot_lect"), F.lit("/"), F.col("environment")))).alias("environments"), F.count(F.lit(1)).alias("splits"))
    figures = own.select("key", F.col("decision").alias("into"), "count", "rate", "contrast_count", "contrast_rate", "margin", "p_value", "standing")
    return environments.join(figures, ["key", "into"]).withColumnRenamed("key", "tuple").drop("into")


def conditioned_key() -> Column:
    """The name of a conditioned class: pivot, outcome and environment."""
    return F.concat(F.concat_ws("=", "pivot_lect", "pivot"), F.lit(" ~ "), "outcome", F.lit(" / "), "environment")


def searched(rows: DataFrame, draws: int = DRAWS, seed: int = 20260815, depth: int = DEPTH, commits: int = MAX_COMMITS, scorer: str = "bic", charge: bool = True, names: list[str] | None = None) -> DataFrame:
    """Decision lists of ``rows(pivot_lect, pivot, tokens, sisters, weight)``, one for each pivot.

    Observations that agree in tokens and outcomes are summed before they come
    to a pivot's kernel, which so grows with the vocabulary, not with the corpus.
    charge: whether scores pay for the number of partitions searched.
    names: those of tokens that are numbers (``contexts.coded``); such rows are taken as summed by word and place, and
    go to their pivots at once.
    """
    if names is not None:
        rows = rows.repartition("pivot_lect", "pivot")
    rows = rows.groupBy("pivot_lect", "pivot", "tokens", "sisters").agg(F.sum("weight").alias("weight"))

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [x.split(" ")[0] for x in RULES.split(", ")]
        outcomes = [{s["lect"]: s["grapheme"] for s in own} for own in pdf["sisters"]]
        order = sorted(range(len(pdf)), key=lambda k: (sorted(outcomes[k].items()), list(pdf["tokens"].iloc[k])))
        tokens = pdf["tokens"] if names is None else [[names[t] for t in own] for own in pdf["tokens"]]
        bucket = Bucket([tokens[k] for k in order], [outcomes[k] for k in order], pdf["weight"].to_numpy(float)[order], scorer, charge)
        if bucket.weight.sum() < 4 or max(bucket.kinds.values(), default=0) < 2:
            return pd.DataFrame(columns=columns)
        found = bucket.rules(depth, commits)
        if not found:
            return pd.DataFrame(columns=columns)
        digest = sum(ord(c) * 31**k for k, c in enumerate("".join(map(str, key)))) % 2**32
        null = bucket.null_margin(np.random.default_rng([seed, digest]), draws)
        least = max(2, math.ceil(0.5 * math.log2(bucket.weight.sum() + 1)))
        texts = np.array([" ".join(f"{lect}={g}" for lect, g in sorted(o.items())) for o in bucket.outcomes])
        out = []
        for k, (tokens, inside, margin, alike, others) in enumerate(found):
            mass, rest = bucket.weight[inside].sum(), bucket.weight[~inside].sum()
            p = (1 + (null >= margin).sum()) / (len(null) + 1)
            for text in sorted(set(texts[inside])):
                n, m = bucket.weight[inside & (texts == text)].sum(), bucket.weight[~inside & (texts == text)].sum()
                rate, other = n / mass, m / rest if rest else 0.0
                if n >= least and rate > other:
                    standing = "above_noise" if p <= 0.05 and n >= 8 else "within_noise"
                    out.append((*key, k, ";".join(tokens), text, n, rate, m, other, margin, p, standing, alike, others))
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy("pivot_lect", "pivot").applyInPandas(kernel, RULES)


def changes(rules: DataFrame) -> DataFrame:
    """Conditioned classes as changes: ``lect, class_id, input, outcome, environment, displacement, count, margin, delta, alike, rivals`` (arrays of tokens)."""

    @F.pandas_udf("array<string>")
    def moved(inputs: pd.Series, outcomes: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(inputs, outcomes):
            x, y = features(a), features(b)
            out.append([f"-{f}" for f in sorted(x - y)] + [f"+{f}" for f in sorted(y - x)])
        return pd.Series(out)

    order = Window.orderBy("pivot_lect", "pivot", "decision", "outcome")
    rows = rules.withColumns({"class_id": F.row_number().over(order).cast("long") - 1, "to": F.regexp_extract("outcome", "=([^ ]*)$", 1)})
    return rows.select(
        F.col("pivot_lect").alias("lect"), "class_id", F.col("pivot").alias("input"), F.col("to").alias("outcome"), F.split("environment", ";").alias("environment"),
        moved("pivot", "to").alias("displacement"), "count", "margin", (-F.col("margin")).alias("delta"), "alike", "rivals",
    )


def events(rules: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Proposed changes of the conditioned classes: groups whose members all agree, with their pooled count and weakest evidence.

    environment, alike, rivals: what every member states, so a group may be
    pinned down better than its members.  With the corpus's sets, also name: the
    features that tell a group's inputs from the rest of the lect's inventory,
    null where none do.
    """
    from lautwerk.operators import events as proposing

    by = ["lect", "axis", "group"]
    rows = changes(rules)
    members = proposing.proposed(rows.drop("alike", "rivals")).join(rows, ["lect", "class_id"])
    out = proposing.built(members, by)
    for column, text in (("environment", ";"), ("alike", ";"), ("rivals", ";")):
        common = proposing.shared(members.select(*by, "class_id", column), by, column)
        out = out.join(common.select(*by, F.array_join("shared", text).alias(column)), by)
    if sets is not None:
        seen = sets.select(F.col("lect_id").alias("lect"), F.explode("segments.grapheme").alias("grapheme")).distinct()
        inventory = seen.join(described(seen), "grapheme").select("lect", "grapheme", "features")
        named = members.select("lect", F.concat_ws("/", "axis", F.col("group").cast("string")).alias("group"), F.col("input").alias("grapheme")).distinct()
        names = proposing.natural_class(named, inventory, ["lect"]).select("lect", F.split_part("group", F.lit("/"), F.lit(1)).alias("axis"), F.split_part("group", F.lit("/"), F.lit(2)).cast("long").alias("group"), "name")
        out = out.join(names, by, "left")
    return out.drop("group")


def cost_outliers(costs: DataFrame) -> DataFrame:
    from lautwerk.operators.outliers import outliers

    return outliers(costs, "set_id", "cost").orderBy(F.desc("z"), "set_id")
