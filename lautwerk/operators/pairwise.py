"""Pairwise correspondence models: expectation-maximisation of symbol costs over the pairs of two lects.

Distinct pairs of forms, weighted, are dealt to tasks of a bounded size beside
the small model of their lects; a task aligns its pairs together and returns
summed counts, which a ``groupBy`` adds up to the next model.  A round is one
job for all lect pairs at once; those whose cost has settled leave the loop.
Permutations and folds are further grouping columns, so they run side by side.

Once symbols have settled, chunks are promoted, and rules conditioned by either
side's environment are searched (``conditions``).  The last alignment
(``aligned``) follows all of them: a pair of symbols costs what the most
specific rule that holds at its places says and what its tones cost, alone or
within a span, and a link of one and one also what the cross-dimensional rules
make of its place.  Which rules hold where is a join of environments with rules
on (lect, symbol), done before.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.functions.environments import is_subset, specificity
from lautwerk.functions.features import distance, features
from lautwerk.operators.alignment import GAP, Costs, as_rows, reordering
from lautwerk.operators.contexts import coded, codes_of, environments
from lautwerk.operators.graph import Scratch
from lautwerk.operators.lattice import Coded, align_many

# Defaults of training.
CONCENTRATION, TAU, MAX_ROUNDS, TOLERANCE = 5.0, 1.0, 30, 1e-4
SEGMENT_WEIGHT, DISPLACEMENT_WEIGHT, TONE_WEIGHT = 0.7, 0.3, 1.0
CHUNK_MIN_COUNT, CHUNK_MIN_LENGTH = 2, 3


def chunk_tier(s: tuple, t: tuple) -> float:
    """0 for plain phonetic processes (one vowel for another span of vowels, a nasal and its consonant), 2 within a major class, 4 across."""
    kinds = [{("vowel" if "vowel" in features(x) else "consonant") for x in side} for side in (s, t)]
    if kinds[0] == kinds[1] == {"vowel"} and len(s) != len(t):
        return 0.0
    if kinds[0] == kinds[1] == {"consonant"}:
        manners = [set().union(*(features(x) for x in side)) for side in (s, t)]
        if len(s) != len(t) and (("affricate" in manners[0]) != ("affricate" in manners[1]) or "prenasalized" in manners[0] | manners[1]):
            return 0.0
        if len(s) != len(t) and "nasal" in manners[0] & manners[1]:
            return 0.0
    return 2.0 if kinds[0] == kinds[1] and len(kinds[0]) == 1 else 4.0


@dataclass
class Pairwise:
    """What is learnt of two lects: counts of symbol pairs, of displacement vectors, and promoted chunks."""

    counts: dict
    alpha: dict
    log_z: dict
    moves: dict
    chunks: dict
    rounds: int = 0

    def __post_init__(self):
        self.of_source, self.of_target = defaultdict(float), defaultdict(float)
        for (s, t), n in self.counts.items():
            self.of_source[s] += n
            self.of_target[t] += n
        self.all_moves = sum(self.moves.values())

    def one(self, s: str, t: str) -> float:
        if (s, t) not in self.alpha:
            return distance(s, t)
        n, c = self.counts.get((s, t), 0.0), CONCENTRATION
        up = (c + self.of_source.get(s, 0.0)) * (c + self.of_target.get(t, 0.0))
        down = (self.alpha[s, t] + n) * (self.alpha[t, s] + n)
        return self.layered(s, t, 0.5 * math.log(up / down))

    def layered(self, s: str, t: str, half: float) -> float:
        """Half the surprisals of both directions, less the spread of the priors, and the surprisal of the displacement."""
        cost = half - 0.5 * (self.log_z[s] + self.log_z[t])
        if self.moves:
            v = len(self.moves) + 1
            moved = -math.log((1 + self.moves.get(move(s, t), 0.0)) / (v + self.all_moves)) - math.log(v)
            cost = SEGMENT_WEIGHT * cost + DISPLACEMENT_WEIGHT * moved
        return cost

    def under_rule(self, s: str, t: str, n: float) -> float:
        """Cost of a pair where a rule that counted it n times holds: the rule has no prior of its own."""
        c = CONCENTRATION
        return self.layered(s, t, 0.5 * math.log((c + self.of_source.get(s, 0.0)) * (c + self.of_target.get(t, 0.0)) / n**2))

    def coded(self, max_chunk: int = 3, reorder: bool = True) -> Coded:
        """As arrays; without any counts, costs are distances."""
        names = sorted(self.log_z)
        one = self.one if self.counts else distance
        return Coded(names, np.array([[one(a, b) for b in names] for a in names]).reshape(len(names), len(names)), self.chunks, max_chunk, reorder)

    def costs(self, max_chunk: int = 3) -> Costs:
        return Costs(one=self.one, chunks=self.chunks, tier=chunk_tier, max_chunk=max_chunk)


def move(s: str, t: str) -> tuple:
    a, b = features(s), features(t)
    return tuple(sorted(a - b)), tuple(sorted(b - a))


def prior(inventory: list[str], tau: float = TAU) -> tuple[dict, dict]:
    alpha, log_z = {}, {}
    for a in inventory:
        w = {b: math.exp(-tau * distance(a, b)) for b in inventory}
        z = sum(w.values())
        log_z[a] = math.log(z)
        alpha.update({(a, b): CONCENTRATION * x / z for b, x in w.items()})
    return alpha, log_z


def bound_positions(links, source, target):
    """(source position or None, target position or None) that links bind one to one, gaps, and spans that stay chunks."""
    pairs, gaps, spans = [], [], []
    for a, k, b, l in links:
        s, t = tuple(source[a : a + k]), tuple(target[b : b + l])
        if k == l:
            to = reordering(s, t) or list(range(l))
            pairs += [(a + i, b + j) for i, j in enumerate(to)]
        elif not k or not l:
            gaps += [(a + i, None) for i in range(k)] + [(None, b + j) for j in range(l)]
        else:
            spans.append((a, k, b, l))
    return pairs, gaps, spans


def form_pairs(sets: DataFrame) -> DataFrame:
    """Every two lects of a set, in order of their names; sets without confidence are left out.

    ``source`` and ``target`` are the symbols, ``a_form`` and ``b_form`` the segments with their dimensions, ``a_word``
    and ``b_word`` name the words with their breaks, as ``contexts`` looks them up.
    """
    rows = sets.where("confidence > 0")
    if "breaks" not in sets.columns:
        rows = rows.withColumns({"breaks": F.array().cast("array<int>"), "syllables": F.array().cast("array<int>")})
    rows = rows.select("set_id", "lect_id", "confidence", "segments", F.col("segments.grapheme").alias("word"), F.xxhash64("segments", "breaks", "syllables").alias("name"))
    a = rows.select("set_id", F.col("lect_id").alias("lect_a"), F.col("word").alias("source"), F.col("confidence").alias("weight"), F.col("segments").alias("a_form"), F.col("name").alias("a_word"))
    b = rows.select("set_id", F.col("lect_id").alias("lect_b"), F.col("word").alias("target"), F.col("segments").alias("b_form"), F.col("name").alias("b_word"))
    return a.join(b, "set_id").where("lect_a < lect_b")


MODEL = "source string, target string, count double, source_total double, cost double, kind string"
#: Distinct pairs of forms that come to a task, about.
DEAL = 1024


def _types(df: DataFrame, by) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"{c} {types[c]}, " for c in by)


def dealt(forms: DataFrame, by: list[str], *key: str) -> DataFrame:
    """``forms`` with deal and deals: tasks of about DEAL rows of each group, however large the group."""
    sizes = forms.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("deals"))
    return forms.join(sizes, by).withColumn("deal", F.pmod(F.xxhash64(*key), F.col("deals")).cast("int"))


def spread(forms: DataFrame, by: list[str]) -> DataFrame:
    """Forms dealt out to as many tasks as a shuffle has: their bytes are few, their alignments aren't."""
    return forms.repartition(int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "deal")


def beside(models: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    """A copy of a group's model for each of its tasks; tasks: by.., deals."""
    return models.join(tasks, by).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")


def link_counts(links: np.ndarray, sources: list, targets: list, weight: np.ndarray, coded: Coded) -> dict[tuple[str, str], float]:
    """Weights of the pairs of symbols that links of equal length bind."""
    one = links[(links[:, 2] == 1) & (links[:, 4] == 1)]
    v = len(coded.symbols)
    code = lambda words, c: np.array([coded.code[words[k][i]] for k, i in one[:, [0, c]].tolist()], np.int64)
    mass = np.bincount(code(sources, 1) * v + code(targets, 3), weight[one[:, 0]], v * v) if len(one) else np.zeros(v * v)
    out = {(coded.symbols[k // v], coded.symbols[k % v]): float(mass[k]) for k in np.flatnonzero(mass)}
    for k, a, n, b, m in links[(links[:, 2] == links[:, 4]) & (links[:, 2] > 1)].tolist():
        s, t = tuple(sources[k][a : a + n]), tuple(targets[k][b : b + m])
        for i, j in enumerate(reordering(s, t) or range(n)):
            out[s[i], t[j]] = out.get((s[i], t[j]), 0.0) + float(weight[k])
    return out


def expected(forms: DataFrame, tasks: DataFrame, models: DataFrame, by: list[str], max_chunk: int) -> DataFrame:
    """One round: ``by.., source, target, count, kind`` summed over tasks; kind cost has the weighted cost of all alignments."""
    schema = _types(forms, by) + "source string, target string, count double, kind string"
    names = [*by, "source", "target", "count", "kind"]

    def kernel(key: tuple, words: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if words.empty:
            return pd.DataFrame(columns=names)
        coded = rebuilt(model).coded(max_chunk)
        sources, targets, weight = list(words["source"]), list(words["target"]), words["weight"].to_numpy(float)
        links, cost = align_many(sources, targets, coded)
        rows = [(*key[:-1], s, t, n, "segment") for (s, t), n in link_counts(links, sources, targets, weight, coded).items()]
        return pd.DataFrame([*rows, (*key[:-1], "", "", float(weight @ cost), "cost")], columns=names)

    parts = spread(forms, by).groupBy(*by, "deal").cogroup(beside(models, tasks, by).groupBy(*by, "deal")).applyInPandas(kernel, schema)
    return parts.groupBy(*by, "source", "target", "kind").agg(F.sum("count").alias("count"))


def flattened(links: np.ndarray, sources: list, targets: list, model: Pairwise) -> np.ndarray:
    """Links whose spans of unequal lengths are taken apart: each is aligned again symbol by symbol, without the chunk that promoted it."""
    uneven = (links[:, 2] != links[:, 4]) & (links[:, 2] > 0) & (links[:, 4] > 0)
    if not uneven.any():
        return links
    spans: dict = {}
    for row, (k, a, n, b, m) in zip(np.flatnonzero(uneven).tolist(), links[uneven].tolist()):
        spans.setdefault((tuple(sources[k][a : a + n]), tuple(targets[k][b : b + m])), []).append(row)
    plain = Coded(*(lambda c: (c.symbols, c.one))(model.coded()), max_chunk=1, reorder=False)
    parts, _ = align_many([s for s, _ in spans], [t for _, t in spans], plain)
    rows = [links[~uneven]]
    for at, every in enumerate(spans.values()):
        own = parts[parts[:, 0] == at]
        for row in every:
            k, a, _, b, _ = links[row]
            rows.append(own * [0, 1, 1, 1, 1] + [k, a, 0, b, 0])
    out = np.concatenate(rows)
    return out[np.lexsort((out[:, 1] + out[:, 3], out[:, 0]))]


def chunk_candidates(forms: DataFrame, tasks: DataFrame, models: DataFrame, by: list[str], max_chunk: int) -> DataFrame:
    """``by.., s, t, count, parts, price, spread, ones``: spans of contiguous links, what spelling them out costs, and their tier."""
    schema = _types(forms, by) + "s array<string>, t array<string>, count double, parts double, price double, spread double"
    names = [*by, "s", "t", "count", "parts", "price", "spread"]

    def kernel(key: tuple, words: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if words.empty:
            return pd.DataFrame(columns=names)
        m = rebuilt(model)
        sources, targets = list(words["source"]), list(words["target"])
        weight = words["weight"].to_numpy(float)
        links, _ = align_many(sources, targets, m.coded(max_chunk))
        seen, ones = defaultdict(float), float(weight[links[(links[:, 2] == 1) & (links[:, 4] == 1), 0]].sum())
        cuts = np.searchsorted(links[:, 0], np.arange(len(sources) + 1))
        rows = links.tolist()
        for k in range(len(sources)):
            own = rows[cuts[k] : cuts[k + 1]]
            for x in range(len(own)):
                _, a, _, b, _ = own[x]
                for y in range(x, min(len(own), x + 2 * max_chunk)):
                    n, l = own[y][1] + own[y][2] - a, own[y][3] + own[y][4] - b
                    if n > max_chunk or l > max_chunk:
                        break
                    if n and l and n + l >= CHUNK_MIN_LENGTH:
                        seen[tuple(sources[k][a : a + n]), tuple(targets[k][b : b + l])] += float(weight[k])
        v = max(2, len({s for s, _ in m.counts} | {t for _, t in m.counts}))
        out = [(*key[:-1], [], [], ones, 0.0, 0.0, 0.0)]
        for (s, t), n in seen.items():
            parts = sum(m.one(a, b) + 0.5 * (m.log_z.get(a, 0) + m.log_z.get(b, 0)) for a, b in zip(s, t)) + abs(len(s) - len(t)) * math.log(v)
            out.append((*key[:-1], list(s), list(t), n, parts, max(len(s), len(t)) + chunk_tier(s, t), sum(m.log_z.get(x, 0.0) for x in s)))
        return pd.DataFrame(out, columns=names)

    parts = spread(forms, by).groupBy(*by, "deal").cogroup(beside(models, tasks, by).groupBy(*by, "deal")).applyInPandas(kernel, schema)
    rows = parts.groupBy(*by, "s", "t").agg(F.sum("count").alias("count"), *[F.max(c).alias(c) for c in ("parts", "price", "spread")])
    ones = rows.where("size(s) = 0").select(*by, F.greatest(F.lit(2.0), F.col("count")).alias("ones"))
    return rows.where("size(s) > 0").join(ones, by)


def promoted(candidates: DataFrame, by: list[str]) -> DataFrame:
    """``by.., source, target, cost``: chunks whose own code is shorter than spelling out their parts, the price of the entry included."""
    of_s, of_t = Window.partitionBy(*by, "s"), Window.partitionBy(*by, "t")
    total = lambda w: F.sum("count").over(w) + F.count(F.lit(1)).over(Window.partitionBy(*by, "t" if w is of_s else "s"))
    rows = candidates.withColumn("own", 0.5 * F.ln(total(of_s) * total(of_t) / ((F.col("count") + 1) * (F.col("count") + 1))))
    gain = -2 * F.col("count") * (F.col("parts") - F.col("own")) + F.col("price") * F.ln("ones")
    rows = rows.where((F.col("count") >= CHUNK_MIN_COUNT) & (F.size("s") != F.size("t")) & (gain < 0))
    return rows.select(*by, F.array_join("s", " ").alias("source"), F.array_join("t", " ").alias("target"), (F.col("own") - F.col("spread")).alias("cost"))


def trained(pairs: DataFrame, by: tuple[str, ...] = ("lect_a", "lect_b"), max_chunk: int = 3, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``by.., source, target, count, source_total, cost, kind`` of a model for each group: counted symbol pairs, promoted chunks, and its inventory.

    Alignment and counting alternate until a group's total cost settles; all groups that haven't settled go through a round together.
    """
    by = list(by)
    out = Scratch(pairs.sparkSession, "models")
    with out:
        scratch = Scratch(pairs.sparkSession, "em")
    forms = scratch.keep(dealt(pairs.groupBy(*by, "source", "target").agg(F.sum("weight").alias("weight")), by, "source", "target"), "forms")
    symbol = F.explode(F.array_distinct(F.concat("source", "target"))).alias("source")
    zero = F.lit(0.0)
    inventory = scratch.keep(forms.select(*by, symbol).distinct().select(*by, "source", F.col("source").alias("target"), zero.alias("count"), F.lit("inventory").alias("kind")), "inventory")
    tasks = scratch.keep(forms.groupBy(*by).agg(F.max("deals").alias("deals")), "tasks")
    live, known, then, finished = forms, inventory, None, []
    for k in range(max_rounds):
        step = scratch.keep(expected(live, tasks, known, by, max_chunk), "round")
        cost = step.where("kind = 'cost'").select(*by, F.col("count").alias("now"))
        if then is None:
            left = cost.where(F.lit(max_rounds > 1))
        else:
            apart = F.abs(F.col("now") - F.col("then")) > tolerance * F.greatest(F.abs("then"), F.lit(1e-12))
            left = cost.join(then, by).where(apart & F.lit(k + 1 < max_rounds)).select(*by, "now")
        left = scratch.keep(left, "left")
        open_, counts = left.select(*by), step.where("kind = 'segment'")
        finished.append(counts.join(open_, by, "left_anti"))
        if left.isEmpty():
            break
        then = left.withColumnRenamed("now", "then")
        live, known = forms.join(open_, by, "left_semi"), inventory.unionByName(counts).join(open_, by, "left_semi")
    held = inventory
    for rows in finished:
        held = held.unionByName(rows)
    held = scratch.keep(held, "held")

    def costed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = rebuilt(rows)
        done = [(*key, s, t, n, m.of_source[s], m.one(s, t), "segment") for (s, t), n in sorted(m.counts.items())]
        done += [(*key, g, g, 0.0, 0.0, 0.0, "inventory") for g in sorted(m.log_z)]
        return pd.DataFrame(done, columns=[*by, "source", "target", "count", "source_total", "cost", "kind"])

    rows = held.groupBy(*by).applyInPandas(costed, _types(pairs, by) + MODEL)
    chunks = promoted(chunk_candidates(forms, tasks, held, by, max_chunk), by).select(*by, "source", "target", zero.alias("count"), zero.alias("source_total"), "cost", F.lit("chunk").alias("kind"))
    model = out.keep(rows.unionByName(chunks), "model")
    scratch.clear()
    return model


def rebuilt(rows: pd.DataFrame) -> Pairwise:
    """A model from its rows."""
    part = {k: rows[rows["kind"] == k] for k in ("segment", "chunk", "inventory")}
    alpha, log_z = prior(sorted(part["inventory"]["source"]))
    counts = {(s, t): n for s, t, n in sorted(zip(part["segment"]["source"], part["segment"]["target"], part["segment"]["count"]))}
    moves: dict = defaultdict(float)
    for (s, t), n in counts.items():
        moves[move(s, t)] += n
    chunks = {(tuple(s.split(" ")), tuple(t.split(" "))): c for s, t, c in zip(part["chunk"]["source"], part["chunk"]["target"], part["chunk"]["cost"])} if len(part["chunk"]) else {}
    return Pairwise(counts, alpha, log_z, dict(moves), chunks)


# --- rules of either side's environment


def single_links(links: DataFrame) -> DataFrame:
    """``lect_a, lect_b, weight, a_word, a_pos, a_seg, b_word, b_pos, b_seg`` of links of one and one."""
    each = links.select("lect_a", "lect_b", "weight", "a_word", "b_word", "a_form", "b_form", F.explode("flat").alias("l")).where("l.s_len = 1 and l.t_len = 1")
    at = lambda c, k: F.element_at(c, F.col(f"l.{k}") + 1)
    return each.select("lect_a", "lect_b", "weight", "a_word", F.col("l.s_start").alias("a_pos"), at("a_form", "s_start").alias("a_seg"), "b_word", F.col("l.t_start").alias("b_pos"), at("b_form", "t_start").alias("b_seg"))


def word_environments(sets: DataFrame) -> DataFrame:
    """``word, pos, tokens`` of the distinct words of a corpus."""
    name = F.xxhash64("segments", "breaks", "syllables")
    words = sets.select(name.alias("word"), F.col("segments.grapheme").alias("graphemes"), F.col("syllables").alias("given"), F.col("breaks").alias("morphemes"), F.col("segments.stress").alias("stress"))
    return environments(words.dropDuplicates(["word"]))


RULES = ("lect_a", "lect_b", "side", "pivot", "partner", "tokens", "count", "rate", "contrast_rate", "margin", "decision")


def conditions(singles: DataFrame, held: DataFrame, scorer: str = "bic") -> DataFrame:
    """Rules of each pair of lects (RULES): a symbol of one side, where its environment holds, answers to a symbol of the other.

    Both sides are searched on the same links before either is used; what agrees in environment and outcome is summed first.
    """
    from lautwerk.operators.classes import searched

    out = None
    held, names = coded(held)
    for side, own, other in (("source", "a", "b"), ("target", "b", "a")):
        rows = singles.select("lect_a", "lect_b", F.col(f"{own}_word").alias("word"), F.col(f"{own}_pos").alias("pos"), F.col(f"{own}_seg.grapheme").alias("pivot"), F.col(f"{other}_seg.grapheme").alias("partner"), "weight")
        # places of words are summed before they meet their tokens, which so are shuffled once, to their pivots
        rows = rows.groupBy("lect_a", "lect_b", "word", "pos", "pivot", "partner").agg(F.sum("weight").alias("weight"))
        rows = rows.join(held, ["word", "pos"]).withColumn("side", F.lit(side))
        out = rows if out is None else out.unionByName(rows)
    name = F.to_json(F.array("lect_a", "lect_b", "side"))
    sisters = F.array(F.struct(F.lit("other").alias("lect"), F.col("partner").alias("grapheme")))
    rows = out.select(name.alias("pivot_lect"), "pivot", "tokens", sisters.alias("sisters"), "weight")
    found = searched(rows, 0, scorer=scorer, names=names)
    part = F.from_json("pivot_lect", "array<string>")
    return found.select(
        part[0].alias("lect_a"), part[1].alias("lect_b"), part[2].alias("side"), "pivot", F.expr("substr(outcome, 7)").alias("partner"), F.split("environment", ";").alias("tokens"),
        "count", "rate", "contrast_rate", "margin", "decision",
    )


def shared(rules: DataFrame, models: DataFrame) -> DataFrame:
    """``rules`` (RULES) with the count by which each prices its pair: what the model would have counted, had the rule held everywhere.

    A rule's own count is of where it holds, but costs divide by all that the two symbols have: a rare rule without
    exceptions would make its pair dearer than no rule does, up to gaps instead.  So its rate is taken of all of the
    pivot, the other direction stays as counted, and the count is their geometric mean; it never is less than without the rule.
    """
    by = ["lect_a", "lect_b"]
    names = ["lect_a", "lect_b", "side", "pivot", "partner", "tokens", "count", "decision"]

    def kernel(key: tuple, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=names)
        m = rebuilt(model)
        out = []
        for side, pivot, partner, rate in zip(rows["side"], rows["pivot"], rows["partner"], rows["rate"]):
            n, of = m.counts.get((pivot, partner) if side == "source" else (partner, pivot), 0.0), m.of_source if side == "source" else m.of_target
            there, back = m.alpha[pivot, partner] + max(n, rate * of[pivot]), m.alpha[partner, pivot] + n
            out.append(math.sqrt(there * back))
        return rows[names].assign(count=out)

    own = rules.select(*names, "rate")
    return own.groupBy(*by).cogroup(models.groupBy(*by)).applyInPandas(kernel, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.drop("rate").schema.fields))


def holding(rules: DataFrame, held: DataFrame, words: DataFrame) -> DataFrame:
    """``lect_a, lect_b, side, word, rules`` (pos, partner, count, size, place): of the rules that hold at a place for a partner the most specific one, the first on a tie.

    words: ``lect_id, word, pos, grapheme`` of distinct words.  Rules meet places on lect and symbol, then their tokens must be among the place's.
    """
    held, names = coded(held)
    order = F.row_number().over(Window.partitionBy("lect_a", "lect_b", "side", "pivot", "partner").orderBy("decision", F.array_join("tokens", ";")))
    lect = F.when(F.col("side") == "source", F.col("lect_a")).otherwise(F.col("lect_b"))
    asked = rules.select("lect_a", "lect_b", "side", lect.alias("lect_id"), F.col("pivot").alias("grapheme"), "partner", codes_of("tokens", names).alias("needs"), "count", order.alias("place"))
    met = words.join(asked, ["lect_id", "grapheme"]).join(held, ["word", "pos"]).where(is_subset(F.col("needs"), F.col("tokens")))
    size = specificity(F.col("needs"))
    best = met.groupBy("lect_a", "lect_b", "side", "word", "pos", "partner").agg(F.max_by(F.struct(F.col("count"), size.alias("size"), "place"), F.struct(size, -F.col("place"))).alias("r"))
    return best.groupBy("lect_a", "lect_b", "side", "word").agg(F.array_sort(F.collect_list(F.struct("pos", "partner", F.col("r.count").alias("count"), F.col("r.size").alias("size"), F.col("r.place").alias("place")))).alias("rules"))


class Overlay:
    """What rules and tones make of pairs of symbols, and cross-dimensional rules of links of one and one; pairs of words are those of a task."""

    def __init__(self, model: Pairwise, coded: Coded, words: pd.DataFrame, tones: list, cross: list):
        self.model, self.coded = model, coded
        self.rules = [[(0, *(r[k] for k in ("pos", "partner", "count", "size", "place"))) for r in (a if a is not None else [])] + [(1, *(r[k] for k in ("pos", "partner", "count", "size", "place"))) for r in (b if b is not None else [])] for a, b in zip(words["a_rules"], words["b_rules"])]
        self.forms = list(zip(words["a_form"], words["b_form"]))
        self.tones = {(s, t): n for s, t, n in tones}
        self.cross = cross

    def tone_cost(self, s: str, t: str) -> float:
        """Surprisal of a tone given its counterpart over the observed pairs, less that of an even choice; 0 without tones."""
        rows = len(self.tones)
        if not rows or (not s and not t):
            return 0.0
        n = self.tones.get((s, t))
        whole = sum(x for (a, _), x in self.tones.items() if a == s) + rows
        return -math.log((1 + n) / whole) - math.log(max(2, rows)) if n is not None else 0.0

    def adjustment(self, rule: dict, actual: str) -> float:
        """Gain of the rule's rate over the value's own, or the loss where another value stands."""
        if not actual:
            return 0.0
        side = 0 if rule["context_is_target"] else 1
        seen = [(pair[side], n) for pair, n in self.tones.items()]
        kinds = max(2, len({v for v, _ in seen if v}))
        inside = (rule["count"] + 1) / (rule["total"] + kinds)
        base = (sum(n for v, n in seen if v == rule["value"]) + 1) / (sum(n for _, n in seen) + kinds) if seen else 1 / kinds
        inside, base = (min(max(p, 1e-12), 1 - 1e-12) for p in (inside, base))
        return math.log(base / inside) if actual == rule["value"] else math.log((1 - base) / (1 - inside))

    def __call__(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, names = ones.copy(), self.coded.symbols
        told = np.zeros_like(out)
        for b, k in enumerate(at):
            best: dict = {}
            for side, pos, partner, count, size, place in self.rules[k]:
                code = self.coded.code.get(partner, -1)
                for other in np.flatnonzero((y if side == 0 else x)[b] == code):
                    cell = (pos, other) if side == 0 else (other, pos)
                    best[cell] = max(best.get(cell, (0, 0, 0, 0)), (size, -side, -place, count))
            for (i, j), (_, _, _, count) in best.items():
                out[b, i, j] = self.model.under_rule(names[x[b, i]], names[y[b, j]], count)
            if self.tones or self.cross:
                a_form, b_form = self.forms[k]
                if self.tones:
                    out[b, : len(a_form), : len(b_form)] += TONE_WEIGHT * np.array([[self.tone_cost(p["tone"] or "", q["tone"] or "") for q in b_form] for p in a_form])
                for rule in self.cross:
                    here, there = (b_form, a_form) if rule["context_is_target"] else (a_form, b_form)
                    gain = np.array([self.adjustment(rule, q[rule["dimension"]] or "") for q in there])
                    for pos in range(len(here)):
                        if cross_holds(rule["environment"], here, pos):
                            if rule["context_is_target"]:
                                told[b][: len(there), pos] += gain
                            else:
                                told[b][pos, : len(there)] += gain
        return out, out + told


SLOTS = {"preceding": -1, "self": 0, "following": 1}


def cross_holds(environment: list[str], form, pos: int) -> bool:
    """Whether all predicates hold: ``slot:feature=+|-`` of a neighbour or the segment itself, ``slot:tone=v|≠v|-``; none does off the word's edge."""
    for token in environment:
        slot, _, predicate = token.partition(":")
        name, _, want = predicate.partition("=")
        k = pos + SLOTS[slot]
        if not 0 <= k < len(form):
            return False
        if name in ("tone", "length", "stress"):
            value = form[k][name] or ""
            holds = not value if want == "-" else value != want[1:] if want.startswith("≠") else value == want
        else:
            holds = (name in features(form[k]["grapheme"])) == (want == "+")
        if not holds:
            return False
    return bool(environment)


NO_RULES = "array<struct<pos:int,partner:string,count:double,size:int,place:int>>"


def aligned(pairs: DataFrame, max_chunk: int = 3, models: DataFrame | None = None, rules: DataFrame | None = None, tones: DataFrame | None = None, cross: DataFrame | None = None, reorder: bool = True) -> DataFrame:
    """Links of all pairs under the model trained on their lects, as they are and with chunks taken apart (``flat``); each distinct pair of words is aligned once and joined back.

    rules: those of ``holding``; tones: counts of tones (``tables.tonal_counts``); cross: rows of ``crossdim.discovered``.
    """
    by = ["lect_a", "lect_b"]
    models = trained(pairs, max_chunk=max_chunk) if models is None else models
    extra = models.select(*by, "source", "target", "count", "source_total", "cost", "kind")
    zero = F.lit(0.0)
    if tones is not None:
        extra = extra.unionByName(tones.select(*by, F.col("source_tone").alias("source"), F.col("target_tone").alias("target"), "count", zero.alias("source_total"), zero.alias("cost"), F.lit("tone").alias("kind")))
    if cross is not None:
        said = F.to_json(F.struct("context_is_target", "dimension", "value", "environment"))
        extra = extra.unionByName(cross.where("not lect_internal").select(*by, said.alias("source"), F.lit("").alias("target"), "count", F.col("total").alias("source_total"), zero.alias("cost"), F.lit("cross").alias("kind")))
    words = pairs.select(*by, "a_word", "b_word", "source", "target", "a_form", "b_form").dropDuplicates([*by, "a_word", "b_word"])
    for side in ("a", "b"):
        if rules is None:
            words = words.withColumn(f"{side}_rules", F.lit(None).cast(NO_RULES))
        else:
            own = rules.where(F.col("side") == ("source" if side == "a" else "target")).select(*by, F.col("word").alias(f"{side}_word"), F.col("rules").cast(NO_RULES).alias(f"{side}_rules"))
            words = words.join(own, [*by, f"{side}_word"], "left")
    words = dealt(words, by, "a_word", "b_word")
    link = "array<struct<s_start:int,s_len:int,t_start:int,t_len:int>>"
    names = [*by, "a_word", "b_word", "links", "flat", "cost"]
    schema = f"lect_a string, lect_b string, a_word long, b_word long, links {link}, flat {link}, cost double"

    def kernel(key: tuple, words: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if words.empty:
            return pd.DataFrame(columns=names)
        m = rebuilt(model)
        coded = m.coded(max_chunk, reorder)
        toned = model[model["kind"] == "tone"]
        told = model[model["kind"] == "cross"]
        cross = []
        for text, count, total in sorted(zip(told["source"], told["count"], told["source_total"])):
            rule = json.loads(text)
            cross.append(rule | {"environment": rule["environment"].split(";"), "count": count, "total": total})
        overlay = Overlay(m, coded, words, sorted(zip(toned["source"], toned["target"], toned["count"])), cross)
        some = len(toned) or cross or any(overlay.rules)
        sources, targets = list(words["source"]), list(words["target"])
        links, cost = align_many(sources, targets, coded, overlay if some else None)
        flat = flattened(links, sources, targets, m)
        return pd.DataFrame({"lect_a": key[0], "lect_b": key[1], "a_word": words["a_word"], "b_word": words["b_word"], "links": as_rows(links, len(words)), "flat": as_rows(flat, len(words)), "cost": cost})

    tasks = words.groupBy(*by).agg(F.max("deals").alias("deals"))
    done = spread(words, by).groupBy(*by, "deal").cogroup(beside(extra, tasks, by).groupBy(*by, "deal")).applyInPandas(kernel, schema)
    met = pairs.join(done, [*by, "a_word", "b_word"])
    return met.select("set_id", *by, "weight", "a_word", "b_word", "a_form", "b_form", F.size("source").alias("a_len"), F.size("target").alias("b_len"), "links", "flat", "cost")


def set_costs(links: DataFrame) -> DataFrame:
    """Mean cost per segment of each set, over its pairs."""
    per = F.col("cost") / ((F.col("a_len") + F.col("b_len")) / 2)
    return links.groupBy("set_id").agg(F.avg(per).alias("cost"), F.count(F.lit(1)).alias("pairs"))


__all__ = ["GAP", "Costs", "Pairwise", "aligned", "conditions", "form_pairs", "holding", "set_costs", "trained"]
