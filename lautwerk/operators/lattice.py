"""Alignment of many pairs at once: the lattices of pairs of about one shape are filled together, an anti-diagonal at a time.

Shorter words are padded, as a lattice is filled forwards: no cell of a pair depends on one beyond its ends.  Costs of all spans are known before the lattice is filled, as arrays over
pairs and places, so the fill itself is a few additions and comparisons for
each diagonal and kind of link.  Links, prices and ties are those of
``alignment.align``.  Costs of pairs of symbols may depend on their places: a
caller hands in what it makes of them, for pairs wherever they stand and, if
that differs, for links of one and one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from lautwerk.functions.features import features
from lautwerk.operators.alignment import EPSILON, EXTRA, GAP_COST, LENGTH_PRICE, MAX_CHUNK, MAX_REORDER, PRIOR_STEP, UNEQUAL, reordering

#: Cells of a batch of lattices, about, and the steps that lengths of words are padded to.
CELLS, STEP = 1 << 17, 4


@dataclass
class Coded:
    """Costs of an inventory's symbols as arrays over their codes."""

    symbols: list[str]
    one: np.ndarray
    chunks: dict = field(default_factory=dict)
    max_chunk: int = MAX_CHUNK
    reorder: bool = True
    #: Costs of losing and of gaining each symbol.
    gap: np.ndarray | None = None

    def __post_init__(self):
        self.code = {g: k for k, g in enumerate(self.symbols)}
        own = [features(g) for g in self.symbols]
        self.vowel, self.affricate, self.nasal = (np.array([f in x for x in own], bool) for f in ("vowel", "affricate", "nasal"))
        self.prenasal = np.array(["prenasalized" in x for x in own], bool)
        self.mark = np.random.default_rng(1).integers(1, 2**63, len(own), dtype=np.uint64)
        self.spans: dict = {}
        v = max(2, len(own))
        for (s, t), cost in sorted(self.chunks.items()):
            if all(x in self.code for x in (*s, *t)):
                key = 0
                for x in (*s, *t):
                    key = key * v + self.code[x]
                self.spans.setdefault((len(s), len(t)), []).append((key, cost))
        self.spans = {k: (np.array([a for a, _ in sorted(x)], np.int64), np.array([c for _, c in sorted(x)])) for k, x in self.spans.items()}
        self.base = v
        if self.gap is None:
            self.gap = np.full((2, len(own)), GAP_COST)

    def coded(self, words) -> list[np.ndarray]:
        return [np.array([self.code[g] for g in w], np.int64) for w in words]


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    """Windows of k along the last axis."""
    return np.lib.stride_tricks.sliding_window_view(x, k, axis=-1)


def tiers(c: Coded, s: np.ndarray, t: np.ndarray, k: int, l: int) -> np.ndarray:
    """Prior tier of each span of k against each of l (pairs, starts, starts): 0 for plain processes, 2 within a major class, 4 across."""

    def side(x, n):
        w = _windows(x, n)
        return c.vowel[w].all(-1), (~c.vowel[w]).all(-1), c.affricate[w].any(-1), c.prenasal[w].any(-1), c.nasal[w].any(-1)

    (sv, sc, sa, sp, sn), (tv, tc, ta, tp, tn) = ((y[:, :, None] for y in side(s, k)), (y[:, None, :] for y in side(t, l)))
    plain = (k != l) & ((sv & tv) | (sc & tc & ((sa != ta) | sp | tp | (sn & tn))))
    return np.where(plain, 0.0, np.where((sv & tv) | (sc & tc), 2.0, 4.0))


def span_costs(c: Coded, s: np.ndarray, t: np.ndarray, ones: np.ndarray, k: int, l: int, placed: bool, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cost of a link of each span of k source symbols with each of l target symbols; placed: whether costs depend on places; ends: lengths of the words."""
    n, m = s.shape[1] - k + 1, t.shape[1] - l + 1
    total = sum(ones[:, q : q + n, q : q + m] for q in range(min(k, l)))
    if k == l:
        return np.where(np.isfinite(other := reordered(c, s, t, ones, k, placed, ends)), other, total + PRIOR_STEP * tiers(c, s, t, k, l))
    out = total + (UNEQUAL + EXTRA) * abs(k - l) + PRIOR_STEP * tiers(c, s, t, k, l)
    if (k, l) in c.spans:
        keys, costs = c.spans[k, l]
        place = lambda x, w: (_windows(x, w) * c.base ** np.arange(w - 1, -1, -1)).sum(-1)
        own = place(s, k)[:, :, None] * c.base**l + place(t, l)[:, None, :]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out = np.where(keys[at] == own, costs[at], out)
    return out


def reordered(c: Coded, s: np.ndarray, t: np.ndarray, ones: np.ndarray, k: int, placed: bool, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cost of spans of k that hold the same symbols in another order, each with its own; infinite for others."""
    n, m = s.shape[1] - k + 1, t.shape[1] - k + 1
    bag = lambda x: _windows(c.mark[x], k).sum(-1, dtype=np.uint64)
    equal = s[:, :, None] == t[:, None, :]
    identical = np.logical_and.reduce([equal[:, q : q + n, q : q + m] for q in range(k)])
    inner = [np.arange(w)[None, :] + k <= end[:, None] for w, end in zip((n, m), ends)]
    moved = (bag(s)[:, :, None] == bag(t)[:, None, :]) & ~identical & inner[0][:, :, None] & inner[1][:, None, :]
    if not placed or not moved.any():
        return np.where(moved, _windows(c.one[s, s], k).sum(-1)[:, :, None], np.inf)
    out = np.full(moved.shape, np.inf)
    for b, i, j in np.argwhere(moved).tolist():
        to = reordering(tuple(s[b, i : i + k].tolist()), tuple(t[b, j : j + k].tolist()))
        out[b, i, j] = sum(ones[b, i + x, j + y] for x, y in enumerate(to))
    return out


def fill(c: Coded, s: np.ndarray, t: np.ndarray, placed: tuple[np.ndarray, np.ndarray] | None = None, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (pair, source start, length, target start, length), in order, and costs of pairs: codes (pairs, n) and (pairs, m).

    placed: costs of pairs of symbols by place, within spans and as links of their own.
    ends: lengths of the words, whose codes go on with any others; all codes count without.
    """
    pairs, n, m = len(s), s.shape[1], t.shape[1]
    ends = ends or (np.full(pairs, n), np.full(pairs, m))
    ones, singles = placed or (c.one[s[:, :, None], t[:, None, :]],) * 2
    steps = sorted({(0, 1), (1, 0)} | {(k, l) for k in range(1, c.max_chunk + 1) for l in range(1, c.max_chunk + 1)})
    kinds, planes = [], []

    def offer(k, l, cost):
        plane = np.full((pairs, n + 1, m + 1), np.inf)
        plane[:, k:, l:] = cost
        kinds.append((k, l))
        planes.append(plane)

    for k, l in steps:
        if k <= n and l <= m:
            lost = c.gap[0][s][:, :, None] if not l else c.gap[1][t][:, None, :]
            offer(k, l, lost if not k or not l else singles if k == l == 1 else span_costs(c, s, t, ones, k, l, placed is not None, ends))
    for k in range(2, min(n, m, MAX_REORDER) + 1) if c.reorder else ():
        other = reordered(c, s, t, ones, k, placed is not None, ends)
        if np.isfinite(other).any():
            offer(k, k, other)
    pad = MAX_REORDER
    cost = np.full((pairs, n + 1 + pad, m + 1 + pad), np.inf)
    cost[:, pad, pad] = 0.0
    back = np.zeros((pairs, n + 1, m + 1), np.int8)
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        best, how = np.full((pairs, len(i)), np.inf), np.zeros((pairs, len(i)), np.int8)
        for x, (k, l) in enumerate(kinds):
            here = cost[:, i - k + pad, j - l + pad] + planes[x][:, i, j]
            if k + l > 2:
                here = here + LENGTH_PRICE * (k + l - 2)
            better = here < best - EPSILON
            best, how = np.where(better, here, best), np.where(better, np.int8(x), how)
        cost[:, i + pad, j + pad], back[:, i, j] = best, how
    # all pairs walk back together
    at, i, j = np.arange(pairs), *ends
    spans, links, total = np.array(kinds or [(0, 0)]), [], np.zeros(pairs)
    while len(at):
        live = (i > 0) | (j > 0)
        at, i, j = at[live], i[live], j[live]
        how = back[at, i, j]
        k, l = spans[how, 0], spans[how, 1]
        for x in np.unique(how):
            own = how == x
            total[at[own]] += planes[x][at[own], i[own], j[own]]
        i, j = i - k, j - l
        links.append(np.stack([at, i, k, j, l], axis=1))
    out = np.concatenate(links) if links else np.zeros((0, 5), int)
    return out[np.lexsort((out[:, 1] + out[:, 3], out[:, 0]))], total


#: What a caller makes of pairs of symbols: places of the pairs of words, their codes and costs (pairs, n, m; padded) to costs within spans and of single links.
Overlay = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def padded(words: list[np.ndarray], n: int) -> np.ndarray:
    """Codes of words, one a row, with the first symbol's after their ends."""
    out = np.zeros((len(words), n), np.int64)
    for row, w in zip(out, words):
        row[: len(w)] = w
    return out


def align_many(sources, targets, c: Coded, overlay: Overlay | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (pair, source start, length, target start, length), sorted by pair and place, and the cost of each pair."""
    s, t = c.coded(sources), c.coded(targets)
    shapes: dict = {}
    for k, (a, b) in enumerate(zip(s, t)):
        shapes.setdefault(tuple(-(-len(x) // STEP) * STEP for x in (a, b)), []).append(k)
    cost, links = np.zeros(len(s)), [np.zeros((0, 5), int)]
    for (n, m), every in sorted(shapes.items()):
        size = max(1, CELLS // ((n + 1) * (m + 1)))
        for k in range(0, len(every), size):
            at = np.array(every[k : k + size])
            x, y = padded([s[i] for i in at], n), padded([t[i] for i in at], m)
            ends = tuple(np.array([len(w[i]) for i in at]) for w in (s, t))
            own, cost[at] = fill(c, x, y, overlay(at, x, y, c.one[x[:, :, None], y[:, None, :]]) if overlay and n and m else None, ends)
            own[:, 0] = at[own[:, 0]]
            links.append(own)
    out = np.concatenate(links)
    return out[np.argsort(out[:, 0], kind="stable")], cost
