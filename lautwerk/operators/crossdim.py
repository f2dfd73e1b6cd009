"""Cross-dimensional correspondences: what about one form conditions a tone, length or stress of the other.

Observations are rows with the value of the conditioned dimension and nullable
boolean predicates (null: undefined, off the edge of the word).  A predicate
and its negation, and conjunctions of two of the best ones, are scored
together; environments are committed one at a time, best first, against what
those before haven't accounted for.

Observations that agree in everything are summed before they come to a search,
whose size so follows inventories: contexts that occur, times predicates.  The
search is a matrix of the two.  Candidates are compared as divisions of the
live observations, so two predicates of equal masses that divide them in
another way are two findings.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lautwerk.functions.stats import xlogx
from lautwerk.operators.splits import EPSILON, masses, scores

# Best single predicates that conjunctions are made of, rounds, least count.
BASE, ROUNDS, LEAST = 16, 5, 3


def value_delta(a: Column, inside: Column, c: Column, outside: Column) -> Column:
    """Change of a two-by-two code, times two, by telling a value's rate inside (a of inside) from that outside (c of outside)."""

    def code(hit: Column, total: Column) -> Column:
        return xlogx(total.cast("double")) - xlogx(hit.cast("double")) - xlogx((total - hit).cast("double"))

    return 2 * (code(a, inside) + code(c, outside) - code(a + c, inside + outside)) + F.ln((inside + outside).cast("double"))


def negated(name: str) -> str:
    """A predicate's complement: - for a boolean feature, ≠v for a value."""
    feature, _, value = name.partition("=")
    if value in ("+", "-", ""):
        return f"{feature}={'+' if value == '-' else '-'}"
    return f"{feature}={value[1:]}" if value.startswith("≠") else f"{feature}=≠{value}"


def satisfied(predicate: Column, negate: bool = False) -> Column:
    """A predicate or its negation; undefined stays undefined."""
    return ~predicate if negate else predicate


def singles(obs: DataFrame, value: str, predicates: dict[str, Column], base: int = BASE) -> DataFrame:
    """``predicate, n_in, n_out, delta`` of the best ``base`` predicates by score, over the rows where each is defined."""
    return _scored(obs, value, predicates).orderBy(F.round("delta", 9), "predicate").limit(base)


def _scored(obs: DataFrame, value: str, predicates: dict[str, Column]) -> DataFrame:
    """Scores of nullable predicates, each over the rows where it is defined."""
    counted = masses(obs, value, predicates)
    defined = masses(obs, value, {k: c.isNotNull() for k, c in predicates.items()}).select("predicate", "outcome", F.col("inside").alias("known"))
    counted = counted.join(defined, ["predicate", "outcome"]).where("known > 0").select("predicate", "outcome", "inside", F.col("known").alias("total"))
    return scores(counted).where("n_in > 0 and n_out > 0")


class Matrix:
    """Candidates (rows) over distinct observations (columns): where each holds and where it is defined."""

    def __init__(self, names: list[str], holds: np.ndarray, defined: np.ndarray, values: list[str], weight: np.ndarray, scorer: str = "bic"):
        from lautwerk.operators.classes import CODES

        self.code, self.bic = CODES[scorer], scorer == "bic"
        self.names, self.holds, self.defined, self.weight = list(names), holds & defined, defined, weight
        self.kinds = sorted(set(values))
        self.value = np.array([self.kinds.index(v) for v in values], int)
        self.live = np.ones(len(weight), bool)
        self.parts: list[tuple[int, ...]] = [(k,) for k in range(len(names))]

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Masses of the values inside and outside of every candidate, over what is live and defined."""
        each = np.zeros((len(self.weight), len(self.kinds)))
        each[np.arange(len(self.weight)), self.value] = self.weight * self.live
        inside = self.holds.astype(float) @ each
        return inside, self.defined.astype(float) @ each - inside

    def marks(self) -> list[tuple[bytes, bytes]]:
        """The live observations inside and outside of each candidate."""
        return [(np.packbits(h & self.live).tobytes(), np.packbits(d & ~h & self.live).tobytes()) for h, d in zip(self.holds, self.defined)]

    def deltas(self, least: float, divisions: int) -> np.ndarray:
        """Scores with the charge for the search; infinite where a side is too small or nothing is told apart."""
        inside, outside = self.sides()
        charge = 2 * math.log(divisions) if divisions > 1 else 0.0
        out = np.full(len(inside), np.inf)
        for k, (a, c) in enumerate(zip(inside, outside)):
            some = (a + c) > 0
            if min(a.sum(), c.sum()) >= least and some.sum() > 1:
                d = 2 * (self.code(a[some]) + self.code(c[some]) - self.code((a + c)[some]))
                out[k] = d + charge + ((some.sum() - 1) * math.log((a + c).sum()) if self.bic else 0.0)
        return out

    def conjoin(self, base: int, least: float) -> None:
        """Adds conjunctions of the best single candidates; two values of one feature at one slot can't both hold."""
        scores = self.deltas(least, 1)
        best = [k for k in np.argsort(scores, kind="stable")[:base] if scores[k] < np.inf]
        feature = lambda k: self.names[k].partition("=")[0]
        pairs = [(a, b) for a, b in itertools.combinations(best, 2) if feature(a) != feature(b)]
        if pairs:
            a, b = np.array(pairs).T
            self.holds, self.defined = np.vstack([self.holds, self.holds[a] & self.holds[b]]), np.vstack([self.defined, self.defined[a] & self.defined[b]])
            self.names += [f"{self.names[i]};{self.names[j]}" for i, j in pairs]
            self.parts += pairs

    def decisions(self, rounds: int = ROUNDS, least: float = LEAST, base: int = BASE) -> list[dict]:
        """Committed environments, the rows that each publishes, best first."""
        if base > 1:
            self.conjoin(base, least)
        out, done, shut, used = [], [], [], set()
        for decision in range(rounds):
            marks = self.marks()
            divisions = len({min(m, m[::-1]) for m in marks})
            scores = self.deltas(least, divisions)
            # a single predicate has published both of its sides
            taken = {m for k in done for m in ((marks[k], marks[k][::-1]) if len(self.parts[k]) == 1 else (marks[k],))}
            best = None
            for k, score in enumerate(scores):
                if not score < 0 or k in done or marks[k] in taken or any(self._within(k, other) for other in shut):
                    continue
                # of equal scores a conjunction stands for the residue it restates
                residue = len(self.parts[k]) > 1 and bool(used & set(self.parts[k])) and self._narrows(k)
                if best is None or score < scores[best] - EPSILON or (residue and len(self.parts[best]) == 1 and score < scores[best] + EPSILON):
                    best = k
            if best is None:
                break
            rows = self._published(best, least)
            charge = 2 * math.log(divisions) if divisions > 1 else 0.0
            margin = (charge - scores[best]) / charge if charge else 0.0
            extra = {"decision": decision, "delta": float(scores[best]), "margin": float(margin), "alternatives": self._alternatives(best)}
            out += [row | extra for row, _ in rows]
            single = len(self.parts[best]) == 1
            for side in {side for _, side in rows}:
                raised = [row["value"] for row, s in rows if s == side]
                if len(raised) == 1:
                    inside = self.holds[best] if side == 0 else self.defined[best] & ~self.holds[best]
                    if single:
                        self.live &= ~(inside & (self.value == self.kinds.index(raised[0])))
                    else:
                        shut.append(best)
            done.append(best)
            used |= set(self.parts[best])
            if not rows:
                break
        return out

    def _published(self, k: int, least: float) -> list[tuple[dict, int]]:
        """Values that a side of a candidate raises, with the side: both of a single predicate, the inside of a conjunction."""
        inside, outside = (x[k] for x in self.sides())
        out = []
        for side in range(2 if len(self.parts[k]) == 1 else 1):
            here, there = (inside, outside) if side == 0 else (outside, inside)
            for v, name in enumerate(self.kinds):
                a, n, c, m = here[v], here.sum(), there[v], there.sum()
                if a >= least and a / n > c / m and self._apart(a, n, c, m) < 0:
                    out.append(({"environment": self.names[k] if side == 0 else negated(self.names[k]), "value": name, "count": float(a), "total": float(n), "contrast_count": float(c), "contrast_total": float(m)}, side))
        return out

    def _apart(self, a: float, n: float, c: float, m: float) -> float:
        two = lambda x, y: self.code(np.array([x, y - x]))
        if not 0 < a + c < n + m:
            return 0.0
        return 2 * (two(a, n) + two(c, m) - two(a + c, n + m)) + (math.log(n + m) if self.bic else 0.0)

    def _within(self, a: int, b: int) -> bool:
        """Whether all live observations that a selects are selected by b."""
        own = self.holds[a] & self.live
        return bool(own.any()) and not (own & ~self.holds[b]).any()

    def _narrows(self, k: int) -> bool:
        a, b = self.parts[k]
        known = self.live & self.defined[k]
        return bool((known & (self.holds[a] ^ self.holds[b])).any())

    def _alternatives(self, k: int) -> int:
        """Other features, at other slots, whose lone predicate divides all observations in the same two."""
        slot = lambda name: name.rpartition("=")[0].partition(":")[0]
        feature = lambda name: name.rpartition("=")[0].rpartition(":")[2]
        own = self.names[k].split(";")
        seen = set()
        for c, parts in enumerate(self.parts):
            if len(parts) > 1 or feature(self.names[c]) in map(feature, own) or slot(self.names[c]) in map(slot, own) or (self.defined[c] != self.defined[k]).any():
                continue
            differ = (self.holds[c] != self.holds[k])[self.defined[k]]
            if not differ.any() or differ.all():
                seen.add(feature(self.names[c]))
        return len(seen)


FOUND = "decision long, environment string, value string, count double, total double, contrast_count double, contrast_total double, delta double, margin double, alternatives long"


def search(obs: DataFrame, value: str, predicates: dict[str, Column], rounds: int = ROUNDS, least: float = LEAST, conjoin: bool = True, scorer: str = "bic") -> DataFrame:
    """Committed environments (FOUND) of observations with given nullable predicates.

    A single predicate publishes both its sides, a conjunction only its inside.  A value is published where its mass
    reaches ``least``, its rate is above that on the other side, and its own two-by-two score is below zero.  Where a
    side raised one value only, by a single predicate, the observations it accounts for are retired; by a conjunction,
    what lies within it is settled.
    """
    names = list(predicates)
    columns = [c.cast("int").alias(f"p{k}") for k, c in enumerate(predicates.values())]
    summed = obs.select(F.col(value).alias("value"), *columns).groupBy("value", *[f"p{k}" for k in range(len(names))]).agg(F.count(F.lit(1)).alias("weight"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(pdf.columns)).reset_index(drop=True)
        marks = pdf[[f"p{k}" for k in range(len(names))]].astype("Float64").to_numpy(float, na_value=np.nan).T
        m = Matrix(names, marks == 1, ~np.isnan(marks), list(pdf["value"]), pdf["weight"].to_numpy(float), scorer)
        return pd.DataFrame(m.decisions(rounds, least, BASE if conjoin else 0), columns=[x.split(" ")[0] for x in FOUND.split(", ")])

    return summed.groupBy(F.lit(1).alias("all_")).applyInPandas(kernel, FOUND)


DIMENSIONS = ("tone", "length", "stress")
PASSES = "lect_a string, lect_b string, context_is_target boolean, lect_internal boolean, dimension string"


def contexts_of(singles: DataFrame, forms: DataFrame) -> DataFrame:
    """Observations of all four passes and three dimensions, summed: PASSES, before, here, after (segments), value, weight.

    The environment is read in one form, the value in the other at the linked place, or (within a lect) in the same one.
    singles: links of one and one; forms: ``word, form`` of distinct words.
    """
    out = None
    for target in (False, True):
        own, other = ("b", "a") if target else ("a", "b")
        named = forms.select(F.col("word").alias(f"{own}_word"), "form")
        rows = singles.join(named, f"{own}_word")
        at = F.col(f"{own}_pos")
        near = lambda k: F.try_element_at("form", F.when((at + k >= 0) & (at + k < F.size("form")), at + k + 1))
        for internal in (False, True):
            said = F.col(f"{own if internal else other}_seg")
            values = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), said[d].alias("value")) for d in DIMENSIONS]))
            one = rows.select("lect_a", "lect_b", F.lit(target).alias("context_is_target"), F.lit(internal).alias("lect_internal"), near(-1).alias("before"), near(0).alias("here"), near(1).alias("after"), "weight", values.alias("v"))
            one = one.select("*", "v.*").drop("v").where("value <> ''")
            out = one if out is None else out.unionByName(one)
    keys = [x.split(" ")[0] for x in PASSES.split(", ")]
    return out.groupBy(*keys, "before", "here", "after", "value").agg(F.sum("weight").alias("weight"))


def discovered(observations: DataFrame, least: float = LEAST, rounds: int = ROUNDS, scorer: str = "bic") -> DataFrame:
    """PASSES and FOUND of every pair of lects, pass and dimension that ``contexts_of`` observed.

    Predicates: features that some but not all segments of the environment's lect have (of those with the same carriers
    the first), and the tones, lengths and stresses that occur there, before, at and after the place, and their negations.
    Off the word's edge they are undefined, and so is the conditioned dimension of the segment itself within a lect.
    """
    from lautwerk.functions.features import features

    keys = [x.split(" ")[0] for x in PASSES.split(", ")]
    names = [*keys, *[x.split(" ")[0] for x in FOUND.split(", ")]]

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        slots = [("preceding", "before"), ("self", "here"), ("following", "after")]
        flat = lambda x: None if x is None else (x["grapheme"], *(x[d] or "" for d in DIMENSIONS))
        cells = {slot: [flat(x) for x in pdf[c]] for slot, c in slots}
        order = sorted(range(len(pdf)), key=lambda k: (pdf["value"].iloc[k], *(cells[s][k] or () for s, _ in slots)))
        cells = {slot: [own[k] for k in order] for slot, own in cells.items()}
        seen = {x for own in cells.values() for x in own if x is not None}
        inventory = sorted({x[0] for x in seen})
        carriers: dict = {}
        for f in sorted({f for g in inventory for f in features(g)}):
            held = frozenset(g for g in inventory if f in features(g))
            if len(held) < len(inventory):
                carriers.setdefault(held, f)
        told, holds, defined = [], [], []
        for slot, _ in slots:
            own = cells[slot]
            there = np.array([x is not None for x in own])
            tests = [(f"{f}=+", np.array([x is not None and x[0] in held for x in own])) for held, f in sorted(carriers.items(), key=lambda c: c[1])]
            for d, name in enumerate(DIMENSIONS, 1):
                for v in sorted({x[d] for x in seen} - {""}):
                    tests.append((f"{name}={v}", np.array([x is not None and x[d] == v for x in own])))
            for predicate, mark in tests:
                known = np.zeros_like(there) if key[3] and slot == "self" and predicate.startswith(f"{key[4]}=") else there
                told += [f"{slot}:{predicate}", negated(f"{slot}:{predicate}")]
                holds += [mark & known, ~mark & known]
                defined += [known, known]
        if not told or pdf["value"].nunique() < 2:
            return pd.DataFrame(columns=names)
        m = Matrix(told, np.array(holds), np.array(defined), [pdf["value"].iloc[k] for k in order], pdf["weight"].to_numpy(float)[order], scorer)
        return pd.DataFrame([dict(zip(keys, key)) | row for row in m.decisions(rounds, least)], columns=names)

    return observations.groupBy(*keys).applyInPandas(kernel, f"{PASSES}, {FOUND}")


def publishable(environment: Column, dimension: str) -> Column:
    """Whether an environment (tokens joined by ;) says anything besides the conditioned dimension itself; dimension: its name, or a column that is called ``dimension``."""
    name = F.col(dimension) if dimension == "dimension" else F.lit(dimension)
    return F.exists(F.split(environment, ";"), lambda t: F.split_part(F.split_part(t, F.lit("="), F.lit(1)), F.lit(":"), F.lit(-1)) != name)


def lifted(rows: DataFrame, keys: list[str], mass: str = "total") -> DataFrame:
    """Rules found within one lect by several pairs, once each: that of the largest mass, then of the first pair."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(mass), "pair")
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
