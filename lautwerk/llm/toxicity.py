"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, with word ends), and each
n-gram has a vector.  The vectors of a window of consecutive words are
averaged, and a linear softmax over two classes reads the average; vectors and
softmax are trained jointly, in numpy.  A document's value is that of its most
toxic window, so length doesn't drown a few words, and an unseen misspelling or
ending shares n-grams with what was seen.  A text of one window at most is its
plain average.

Training is on the documents' labels: the loss is that of each document's value,
whose gradient goes through the window that is its maximum under the model so
far.  It begins with windows drawn at random, of either label; clean documents
bring a further window at random besides their most toxic ones.

Scoring folds softmax and vectors into one number per n-gram bucket, so it is
running sums over the whole text, in numpy, in blocks.

Defined cases: a null or empty text has no words and gets the lowest score;
texts of any length are scored whole (only those longer than MAX_CHARS don't
train); repeated rows score alike; a score of exactly one half counts as toxic;
a null id isn't held out and never trains, repeated labels of an id count once
(the smallest value); columns besides doc_id and text aren't looked at,
whatever their names; an empty table gives an empty result; without labels of
both kinds every document gets 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lautwerk.llm.common import cut_between, fold, labelled_sample

#: At most so many labelled rows of either label train the model, and only texts of at most so many code points.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1_500, 3_000, 16_000
BUCKETS, DIM, SIZES = 1 << 18, 12, (3, 4, 5)
#: Words of a window; rounds of choosing windows; epochs of a round; windows that begin.
WINDOW, ROUNDS, EPOCHS, FIRST = 5, 6, 2, 8
#: Code points scored at once.
BLOCK = 1 << 19
SEPARATORS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r.,;:!?\"()[]{}|"})


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").lower().translate(SEPARATORS).split(" ") if w]


def grams(points: np.ndarray):
    """For words set apart by single or more spaces: per size, (start, bucket) of n-grams within a word and its two ends."""
    space = points == 32
    p = points.astype(np.uint32)
    for n in SIZES:
        if len(p) < n:
            continue
        m = len(p) - n + 1
        h = np.full(m, 2166136261 + n, np.uint32)
        inner = np.ones(m, bool)
        for k in range(n):
            h ^= p[k : m + k]
            h *= np.uint32(16777619)
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                inner &= ~space[k : m + k]
        at = np.flatnonzero(inner)
        yield at.astype(np.int32), (h[at] >> np.uint32(3)) % np.uint32(BUCKETS)


def word_sums(points: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``table`` over the n-grams of each word, and their number; points: a space, then words each followed by a space."""
    number = np.cumsum(points == 32) - 1
    words = int(number[-1]) if len(number) else 0
    total, count = np.zeros(words + 1), np.zeros(words + 1)
    for at, bucket in grams(points):
        total += np.bincount(number[at], table[bucket], words + 1)
        count += np.bincount(number[at], minlength=words + 1)
    return total[:words], count[:words]


def window_values(total: np.ndarray, count: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Averages of all windows of ``size`` words within documents (bounds: first words, and the end), and each document's first window.

    A document of fewer words is one window, one without words a window of value -inf.
    """
    length = np.diff(bounds)
    windows = np.maximum(1, length - size + 1)
    first = np.concatenate([[0], np.cumsum(windows)])
    begin = np.arange(first[-1]) - np.repeat(first[:-1] - bounds[:-1], windows)
    end = np.minimum(begin + size, np.repeat(bounds[1:], windows))
    s, n = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(count)])
    grams_in = n[end] - n[begin]
    return np.where(grams_in > 0, (s[end] - s[begin]) / np.maximum(grams_in, 1), -np.inf), first


class Subwords:
    """One number per bucket (its vector times the softmax's difference of classes, and the bias), and how a document's value becomes a score."""

    def __init__(self, table: np.ndarray, cut: float, slope: float, window: int = WINDOW):
        self.table, self.cut, self.slope, self.window = table.astype(np.float32), cut, slope, window

    def values(self, texts: list) -> np.ndarray:
        """The value of each text; texts are read whole, several at once."""
        out = np.full(len(texts), -np.inf)
        held, size = [], 0
        for i, t in enumerate(texts):
            own = words_of(t)
            if own:
                held.append((i, own))
                size += len(t)
                if size >= BLOCK:
                    self._read(held, out)
                    held, size = [], 0
        self._read(held, out)
        return out

    def _read(self, held: list, out: np.ndarray) -> None:
        if not held:
            return
        points = code_points(f" {' '.join([w for _, own in held for w in own])} ")
        bounds = np.concatenate([[0], np.cumsum([len(own) for _, own in held])])
        values, first = window_values(*word_sums(points, self.table), bounds, self.window)
        out[[i for i, _ in held]] = np.maximum.reduceat(values, first[:-1])

    def score(self, texts: list) -> np.ndarray:
        at = self.slope * (self.values(texts) - self.cut)
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


class _Trainer:
    """Vectors of buckets and the softmax, by adaptive gradient steps on windows of words."""

    def __init__(self, forms: list[str], seed: int):
        self.rng = rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.ge, self.gw = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
        # buckets of each word form, one after the other
        points = code_points(f" {' '.join(forms)} ")
        number = np.cumsum(points == 32) - 1
        owner, bucket = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for at, b in grams(points):
            ok = number[at] < len(forms)
            owner.append(number[at][ok])
            bucket.append(b[ok])
        owner, bucket = np.concatenate(owner), np.concatenate(bucket)
        self.bucket = bucket[np.argsort(owner, kind="stable")].astype(np.int32)
        self.size = np.bincount(owner, minlength=len(forms))
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Each form's sum of the table, and its n-grams."""
        s = np.concatenate([[0], np.cumsum(self.table()[self.bucket], dtype=np.float64)])
        return s[self.start + self.size] - s[self.start], self.size.astype(float)

    def run(self, begin: np.ndarray, length: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray, batch: int = 1024, rate: float = 0.3) -> None:
        """Windows (place of the first word in ``words``, number of words) of documents labelled y."""
        order = self.rng.permutation(len(begin))
        for k in range(0, len(order), batch):
            take = order[k : k + batch]
            form = words[_ranges(begin[take], length[take])]
            grams_in = np.add.reduceat(self.size[form], np.concatenate([[0], np.cumsum(length[take])[:-1]]))
            take, grams_in = take[grams_in > 0], grams_in[grams_in > 0]
            if not len(take):
                continue
            g = self.bucket[_ranges(self.start[form], self.size[form])]
            at = np.concatenate([[0], np.cumsum(grams_in)[:-1]])
            mean = np.add.reduceat(self.e[g], at, axis=0) / grams_in[:, None]
            logit = mean @ self.w + self.b
            logit -= logit.max(1, keepdims=True)
            d = np.exp(logit)
            d /= d.sum(1, keepdims=True)
            d[np.arange(len(take)), y[take]] -= 1
            d *= weight[take][:, None]
            gw = mean.T @ d / len(take)
            back = np.repeat((d @ self.w.T) / grams_in[:, None], grams_in, axis=0)
            by = np.argsort(g, kind="stable")
            gs = g[by]
            first = np.flatnonzero(np.concatenate([[True], gs[1:] != gs[:-1]]))
            ids, grad = gs[first], np.add.reduceat(back[by], first, axis=0)
            self.ge[ids] += (grad * grad).mean(1)
            self.e[ids] -= rate * grad / np.sqrt(self.ge[ids])[:, None]
            self.gw += gw * gw
            self.w -= 0.1 * gw / np.sqrt(self.gw)
            self.b -= 0.1 * d.mean(0)

    def table(self) -> np.ndarray:
        """What each bucket adds to a window's log odds; buckets that training never met say what the bias says."""
        seen = (self.ge > 1e-6)[:, None]
        return (np.where(seen, self.e, 0) @ (self.w[:, 1] - self.w[:, 0]) + (self.b[1] - self.b[0])).astype(np.float32)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] of them, then those of start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def fit(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, seed: int = 11, window: int = WINDOW) -> Subwords | None:
    """Alternates between finding each document's most toxic window and training vectors and softmax on these, by the documents' labels."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int32) for t in texts]
    some = np.array([len(d) > 0 for d in docs])
    docs, label = [d for d in docs if len(d)], np.asarray(y)[some]
    if not (label == 1).any() or not (label == 0).any():
        return None
    words = np.concatenate(docs)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    model = _Trainer(list(place), seed)
    span = np.minimum(window, np.diff(bounds))
    windows = np.maximum(1, np.diff(bounds) - window + 1)
    share = (label == 0).sum() / max(1, (label == 1).sum())

    def drawn(these: np.ndarray) -> np.ndarray:
        return bounds[these] + (model.rng.random(len(these)) * windows[these]).astype(np.int64)

    every = np.arange(len(docs))
    for k in range(rounds + 1):
        if k == 0:
            at = np.repeat(every, FIRST)
            begin = drawn(at)
        else:
            total, count = model.sums()
            values, first = window_values(total[words], count[words], bounds, window)
            top = np.array([first[i] + np.argmax(values[first[i] : first[i + 1]]) for i in every])
            other = values.copy()
            other[top] = -np.inf
            near = np.array([first[i] + np.argmax(other[first[i] : first[i + 1]]) for i in every])
            clean = every[label == 0]
            at = np.concatenate([every, clean, clean])
            begin = np.concatenate([top - first[:-1] + bounds[:-1], (near - first[:-1] + bounds[:-1])[clean], drawn(clean)])
        weight = np.where(label[at] == 1, min(8.0, max(1.0, share)) * (1.0 if k == 0 else 2.0), 1.0).astype(np.float32)
        for _ in range(EPOCHS):
            model.run(begin, span[at], words, label[at], weight)
    out = Subwords(model.table(), 0.0, 1.0, window)
    total, count = model.sums()
    values, first = window_values(total[words], count[words], bounds, window)
    value = np.maximum.reduceat(values, first[:-1])
    out.cut = cut_between(value, label)
    out.slope = 4 / max(1e-6, float(np.abs(value[label == 1] - out.cut).mean()))
    return out


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Subwords | None:
    """Fits on a bounded sample outside the held-out fold: at most so many texts of either label, of bounded length, come to the driver."""
    short = docs.where(F.length("text") <= max_chars)
    sample = labelled_sample(short, labels.where("toxic = 1"), "toxic", max_toxic).unionByName(
        labelled_sample(short, labels.where("toxic = 0"), "toxic", max_clean)
    )
    # repeated rows of an id train once
    rows = sample.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).toPandas().sort_values("doc_id")
    if rows.empty:
        return None
    return fit(rows["text"].tolist(), rows["y"].to_numpy())


def score_column(model: Subwords | None, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.0] * len(texts), pa.float64())
        return pa.array(model.score(texts.to_pylist()), pa.float64())

    return score(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", score_column(train(docs, labels), F.col("text")).alias("score"))
    return out.select(
        "doc_id",
        F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
