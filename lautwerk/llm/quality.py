"""Quality classifier by Bradley-Terry pairwise ranking.

Every text becomes a short vector of surface features.  From labelled rows,
pairs (a good one, a poor one) are drawn; the ranking's weights minimise the
logistic loss on differences of features, so the model is a Bradley-Terry
model whose strengths are linear in the features.  Strengths become scores in
0..1 so that the chosen quantile of the training strengths lies at the
threshold (0.3 by default).

Defined cases: a null text scores as an empty one; empty texts score by their
features like any other; repeated rows score alike; an empty table gives an
empty result; without labels of both kinds every document gets 0.5 and stays;
columns of other names pass through ``score_column`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lautwerk.llm.common import cut_between, fold, labelled_sample, texts_of

#: At most so many labelled rows train the ranking, and so many pairs of them.
MAX_ROWS, MAX_PAIRS = 12_000, 100_000
THRESHOLD = 0.3
N_FEATURES = 15

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:'\"-()"]] = True
_MARKS = np.zeros(256, bool)
_MARKS[33:127] = True
_MARKS &= ~(_UPPER | _LOWER | _DIGIT | _STOPS)


def features(text: str | None) -> list[float]:
    """Shares of character kinds, and how varied words and lines are."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = raw.split(b"\n")
    n, w = max(1, len(raw)), max(1, len(words))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, marks = (int(count[k].sum()) for k in (_UPPER, _LOWER, _DIGIT, _MARKS))
    high = int(count[128:].sum())
    distinct = len(set(words))
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        upper / max(1, upper + lower + high),
        digit / n,
        np.sqrt(marks / n),
        np.sqrt(count[124] / n),
        np.sqrt(count[33] / n),
        int(count[_STOPS].sum()) / n,
        high / n,
        int(count[32] + count[10]) / n,
        min(len(raw) / w, 40) / 10,
        np.log1p(distinct) / np.log1p(w),
        distinct / w,
        len(set(lines)) / len(lines),
        min(w / len(lines), 200) / 100,
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)


class Ranking:
    """Strength = weights . (features and their squares, standardised); score = logistic of the strength about the cut."""

    def __init__(self, mean, scale, weights, cut, spread, threshold):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.cut, self.spread, self.threshold = cut, spread, threshold

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z]) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.threshold / (1 - self.threshold))
        at = np.clip((self.strength(x) - self.cut) / self.spread + shift, -30, 30)
        return 1 / (1 + np.exp(-at))


def fit(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, max_pairs: int = MAX_PAIRS, seed: int = 7) -> Ranking | None:
    """Newton steps on the logistic loss of preference pairs."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return None
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.hstack([z, z * z])
    d = z[rng.choice(good, max_pairs)] - z[rng.choice(poor, max_pairs)]
    w, ridge = np.zeros(z.shape[1]), 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the poorer one winning
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    model = Ranking(mean, scale, w, 0.0, 1.0, threshold)
    s = model.strength(x)
    share = len(poor) / len(y)
    model.cut = cut_between(s, y, 0.0, min(1.0, 2 * share))
    model.spread = max(1e-6, float(np.median(np.abs(s - model.cut))) / 3)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ranking | None:
    """Fits on a bounded sample of labelled rows outside the held-out fold; their features are computed where they lie."""
    sample = labelled_sample(docs, labels, "quality", max_rows)

    @F.arrow_udf("array<double>")
    def vector(text: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts_of(text)], pa.list_(pa.float64()))

    rows = sample.select("doc_id", "y", vector("text").alias("x")).toPandas().sort_values(["doc_id", "y"])
    if rows.empty:
        return None
    return fit(np.array(rows["x"].tolist(), float), rows["y"].to_numpy())


def score_column(model: Ranking | None, text: Column) -> Column:
    """Score of each text in 0..1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.5] * len(texts), pa.float64())
        return pa.array(model.score(feature_matrix(texts_of(texts))), pa.float64())

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, max_rows)
    out = docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
    return out.select(
        "doc_id",
        F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they were."""
    model = train(docs, labels, max_rows)
    return docs.where(score_column(model, F.col("text")) >= THRESHOLD)
