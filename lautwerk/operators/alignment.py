"""Alignment of symbol sequences: a join on order whose links are spans.

A link takes k source and l target symbols, up to a chunk each, or one
equal-length span of up to eight whose symbols are reordered.  ``align`` says
for one pair what the least links are; ``align_pairs`` finds the same for whole
Arrow batches at once (``lattice``), so pairs spread over tasks as the input
does; what it needs to know is a small cost object that is shipped with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

GAP_COST, GAP = 0.5, "∅"
#: A better link must win by this much; and the price of a longer link that costs the same.
EPSILON, LENGTH_PRICE = 1e-12, 1e-9
MAX_CHUNK, MAX_REORDER = 3, 8
UNEQUAL, EXTRA, PRIOR_STEP = 0.5, 0.25, 0.20


@dataclass
class Costs:
    """Cost of a link between two spans (tuples of symbols), and what spans are allowed."""

    one: Callable[[str, str], float]
    gap: Callable[[str, bool], float] = lambda symbol, lost: GAP_COST
    chunks: dict = field(default_factory=dict)
    tier: Callable[[tuple, tuple], float] = lambda s, t: 0.0
    max_chunk: int = MAX_CHUNK
    reorder: bool = True

    def __post_init__(self):
        self.known: dict = {}

    def link(self, s: tuple, t: tuple) -> float:
        """Cost of a link; each pair of spans is costed once."""
        out = self.known.get((s, t))
        if out is None:
            out = self.known[s, t] = self.fresh(s, t)
        return out

    def fresh(self, s: tuple, t: tuple) -> float:
        if (s, t) in self.chunks:
            return self.chunks[s, t]
        if not s or not t:
            return sum(self.gap(x, True) for x in s) + sum(self.gap(x, False) for x in t)
        if len(s) == len(t) == 1:
            return self.one(s[0], t[0])
        moved = reordering(s, t)
        if moved is not None:
            return sum(self.one(s[i], t[j]) for i, j in enumerate(moved))
        apart = abs(len(s) - len(t))
        return sum(self.one(a, b) for a, b in zip(s, t)) + (UNEQUAL + EXTRA) * apart + PRIOR_STEP * self.tier(s, t)


@lru_cache(maxsize=1 << 18)
def reordering(s: tuple, t: tuple) -> list[int] | None:
    """For equal-length spans of the same symbols in another order: where each went, leftmost first."""
    if len(s) != len(t) or not 2 <= len(s) <= MAX_REORDER or s == t or sorted(s) != sorted(t):
        return None
    free = list(range(len(t)))
    out = []
    for x in s:
        k = next(j for j in free if t[j] == x)
        free.remove(k)
        out.append(k)
    return out


def align(source: list[str], target: list[str], costs: Costs) -> tuple[list[tuple[int, int, int, int]], float]:
    """Links (source start, length, target start, length) of least cost, and that cost."""
    n, m = len(source), len(target)
    far = float("inf")
    cost = [[far] * (m + 1) for _ in range(n + 1)]
    back: list[list] = [[None] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    steps = [(1, 0), (0, 1)] + [(k, l) for k in range(1, costs.max_chunk + 1) for l in range(1, costs.max_chunk + 1)]
    steps = sorted(set(steps))
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            best, how = far, None
            for k, l in steps:
                if k <= i and l <= j and cost[i - k][j - l] < far:
                    c = cost[i - k][j - l] + costs.link(tuple(source[i - k : i]), tuple(target[j - l : j])) + LENGTH_PRICE * max(0, k + l - 2)
                    if c < best - EPSILON:
                        best, how = c, (k, l)
            if costs.reorder:
                balance: dict = {}
                for k in range(1, min(i, j, MAX_REORDER) + 1):
                    # spans that hold the same symbols leave no balance
                    for x, sign in ((source[i - k], 1), (target[j - k], -1)):
                        balance[x] = balance.get(x, 0) + sign
                        if not balance[x]:
                            del balance[x]
                    if balance or k < 2:
                        continue
                    s, t = tuple(source[i - k : i]), tuple(target[j - k : j])
                    if cost[i - k][j - k] < far and reordering(s, t) is not None:
                        c = cost[i - k][j - k] + costs.link(s, t) + LENGTH_PRICE * (2 * k - 2)
                        if c < best - EPSILON:
                            best, how = c, (k, k)
            cost[i][j], back[i][j] = best, how
    links, i, j = [], n, m
    while i or j:
        k, l = back[i][j]
        i, j = i - k, j - l
        links.append((i, k, j, l))
    links.reverse()
    total = sum(costs.link(tuple(source[a : a + k]), tuple(target[b : b + l])) for a, k, b, l in links)
    return links, total


def unit_costs() -> Costs:
    """Substitutions and gaps of cost one, single symbols only: the edit distance."""
    return Costs(one=lambda a, b: float(a != b), gap=lambda symbol, lost: 1.0, max_chunk=1, reorder=False)


def prior_costs(distance: Callable[[str, str], float], max_chunk: int = MAX_CHUNK, tier=None) -> Costs:
    """No model yet: distances of symbols."""
    return Costs(one=distance, max_chunk=max_chunk, tier=tier or (lambda s, t: 0.0))


def as_rows(links: np.ndarray, pairs: int) -> list[list[dict]]:
    """Links of each of so many pairs, as rows."""
    out: list[list[dict]] = [[] for _ in range(pairs)]
    for k, *x in links.tolist():
        out[k].append(dict(zip(("s_start", "s_len", "t_start", "t_len"), x)))
    return out


LINK = T.StructType([T.StructField(n, T.IntegerType()) for n in ("s_start", "s_len", "t_start", "t_len")])


def align_pairs(pairs: DataFrame, costs: Costs, source: str = "source", target: str = "target") -> DataFrame:
    """``pairs`` (two arrays of symbols) with links and cost."""
    schema = T.StructType(list(pairs.schema.fields) + [T.StructField("links", T.ArrayType(LINK)), T.StructField("cost", T.DoubleType())])

    def kernel(batches):
        from lautwerk.operators import lattice

        for pdf in batches:
            symbols = sorted({x for c in (source, target) for w in pdf[c] for x in w})
            one = np.array([[costs.one(a, b) for b in symbols] for a in symbols]).reshape(len(symbols), len(symbols))
            coded = lattice.Coded(symbols, one, costs.chunks, costs.max_chunk, costs.reorder, np.array([[costs.gap(g, True) for g in symbols], [costs.gap(g, False) for g in symbols]]))
            links, cost = lattice.align_many(pdf[source], pdf[target], coded)
            yield pd.concat([pdf, pd.DataFrame({"links": as_rows(links, len(pdf)), "cost": cost}, index=pdf.index)], axis=1)

    return pairs.mapInPandas(kernel, schema)
