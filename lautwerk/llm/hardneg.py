"""Hard negatives from inverted lists of k-means, visited by bound.

Vectors are quantised to whole numbers and dealt to the clusters of a k-means
that is fitted on a bounded sample; each cluster keeps its centroid and the
radius that covers all its members.  A query's inner product with a member is
at most ``<q, c> + |q| r`` and at least ``<q, c> - |q| r``.  A query visits
clusters in the order of the upper bound, a few at a time: clusters that lie
outside its window of scores are skipped, and it stops when the next bound is
strictly below its kth score, as a bound that equals it may hide a tie with a
smaller id.  So the result is exact.

A round is a join of open queries with the lists they visit; lists and the
queries of a list are dealt out in blocks, whose scores are one product of
matrices, and a block returns the best few of each query.  The number of
rounds is a logarithm of the number of clusters.  The same search serves
positives (own label, no window) and negatives (other labels, a window for
each positive score).

Of equal vectors of a label only the smallest few ids can be returned, as ties
go by id; the others are put aside exactly, before any shuffle of theirs, so
copies make no hot list.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part; vectors of different lengths never meet;
ids count once for each row, and rows with the anchor's own id are none of its
partners; repeated rows of an anchor are one anchor; a score past 64 bits is
cut to them; columns besides those named aren't looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lautwerk.llm.common import Scratch

#: Rows that k-means is fitted on, at most; clusters, at most; its rounds; members of a block of a list, about; queries of a block, about; clusters visited in the first round, and the factor of each further one.
SAMPLE, CLUSTERS, FIT_ROUNDS, BLOCK, QUERIES, FIRST, FACTOR = 16_384, 1024, 8, 4096, 4096, 8, 8
#: Positives of an anchor, negatives of a positive; the window in hundredths of the positive's score; levels of a component.
POSITIVES, NEGATIVES, LOW, HIGH, LEVELS = 5, 3, 50, 95, 256
LARGEST = np.iinfo(np.int64).max
SLACK = 1e-9


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` (whole numbers, as doubles) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite)
    # doubles from 2 ** 52 on are whole already, and may be past a long
    whole = F.transform("vector", lambda x: F.when(F.abs(x * LEVELS) < 2.0**52, F.floor(x * LEVELS).cast("double")).otherwise(x * LEVELS))
    return rows.select("vec_id", "label", whole.alias("vector"))


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id gets the next label of ten, which makes close rows of another label."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    largest = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1]
    if largest < 2.0**53:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(x) @ whole(y).T, -LARGEST - 1, LARGEST).astype(np.int64)


class Lists:
    """Centroids, radii and sizes of the clusters, by the length of their vectors."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids = centroids
        self.first, n = {}, 0
        for d in sorted(centroids):
            self.first[d] = n
            n += len(centroids[d])
        self.radius = np.zeros(n)
        self.size = np.zeros(n, np.int64)

    @classmethod
    def fitted(cls, sample: list, count: int, lengths: list[int]) -> Lists:
        out = {}
        for d in lengths:
            own = np.array([v for v in sample if len(v) == d], float)
            out[d] = _k_means(own, max(1, min(CLUSTERS, round(count**0.5)))) if len(own) else np.zeros((1, d))
        return cls(out)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and distance of each row."""
        c = self.centroids[x.shape[1]]
        k = _nearest(x, c)
        return k + self.first[x.shape[1]], np.sqrt(((x - c[k]) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters, lower and upper bounds of the scores of queries (rows) with their members."""
        d = q.shape[1]
        c = self.centroids[d]
        own = np.arange(self.first[d], self.first[d] + len(c))
        middle, reach = q @ c.T, np.sqrt((q * q).sum(1))[:, None] * self.radius[own]
        slack = SLACK * (np.abs(middle) + reach) + SLACK
        return own, middle - reach - slack, middle + reach + slack


    def blocks(self, spark: SparkSession) -> DataFrame:
        """``cluster, blocks``: a row for each cluster, whose number is bounded."""
        return spark.createDataFrame(pd.DataFrame({"cluster": np.arange(len(self.size)), "blocks": np.maximum(1, -(-self.size // BLOCK))}), "cluster long, blocks long")


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (half - x[k : k + 4096] @ c.T).argmin(1)
    return out


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of distinct rows; clusters that run empty keep their place."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.random.default_rng(7).permutation(len(distinct))[:k]].copy()
    for _ in range(FIT_ROUNDS):
        own = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def few(rows: DataFrame, by: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n of each group: Spark keeps no more than n of a group in any task before it shuffles."""
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place_") <= n).drop("place_")


def inverted(rows: DataFrame, scratch: Scratch) -> tuple[Lists, DataFrame]:
    """The clusters, and ``cluster, block, vec_id, label, vector`` of all rows that can be returned."""
    keyed = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(17), "vector")})
    held = few(keyed, ["label", "h1", "h2"], POSITIVES + 1, "vec_id").drop("h1", "h2")
    sample = held.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["vector"].tolist()
    sizes = {r.d: r.n for r in held.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    lists = Lists.fitted(sample, sum(sizes.values()), sorted(sizes))

    def dealt(frames):
        for f in frames:
            cluster, far = np.zeros(len(f), np.int64), np.zeros(len(f))
            length = f["vector"].map(len).to_numpy()
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                cluster[at], far[at] = lists.nearest(np.array(f["vector"].iloc[at].tolist(), float))
            yield f.assign(cluster=cluster, far=far)

    dealt_out = scratch.keep(held.mapInPandas(dealt, "vec_id long, label long, vector array<double>, cluster long, far double"), "dealt")
    # a row for each cluster, whose number is bounded
    for r in dealt_out.groupBy("cluster").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("size")).collect():
        lists.radius[r.cluster], lists.size[r.cluster] = r.radius, r.size
    of = F.broadcast(lists.blocks(rows.sparkSession))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block")
    return lists, dealt_out.join(of, "cluster").select("cluster", block, "vec_id", "label", "vector")


def leading(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best fitting scores of each row; of equal ones those of the first columns."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 2**62 // max(1, n):  # score and column in one number
        key = np.where(fits, scores * n + np.arange(n)[::-1], -LARGEST)
        at = np.argpartition(-key, k, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), key.shape)
    else:
        at = np.array([np.lexsort((np.arange(n), -s.astype(object), ~f))[:k] for s, f in zip(scores, fits)]).reshape(len(scores), -1)
    i, j = np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()
    ok = fits[i, j]
    return i[ok], j[ok]


def search(queries: DataFrame, lists: Lists, members: DataFrame, same: bool, k: int, scratch: Scratch) -> DataFrame:
    """``anchor, slot, vec_id, score``: for each window (slot) of an anchor the k best members of its own label, or of others.

    queries: ``anchor, label, vector, windows`` (array of low, high); an
    anchor's few windows travel with one copy of its vector.
    """
    spark = queries.sparkSession
    asked = F.broadcast(lists.blocks(spark))
    best, visited, batch = None, 0, FIRST
    state = queries.withColumn("kth", F.lit(None).cast("map<int,long>"))
    windows = "array<struct<low:long,high:long>>"

    while visited < len(lists.size):
        start, end = visited, visited + batch

        def visits(frames, start=start, end=end):
            for f in frames:
                at, to, narrowed = [], [], list(f["windows"])
                length = f["vector"].map(len).to_numpy()
                for d in np.unique(length) if len(f) else ():
                    mine = np.flatnonzero(length == d)
                    names, least, most = lists.bounds(np.array(f["vector"].iloc[mine].tolist(), float))
                    for row, i in enumerate(mine):
                        low, high = _windows(f["windows"].iloc[i])
                        found = dict(f["kth"].iloc[i] or {})
                        kth = np.array([found.get(n, -np.inf) for n in range(len(low))], float)
                        # members below what is known already needn't come back
                        narrowed[i] = [{"low": max(int(a), found.get(n, -LARGEST)), "high": int(b)} for n, (a, b) in enumerate(zip(low, high))]
                        up, down = most[row][:, None], least[row][:, None]
                        inside = (up >= low) & (down <= high)
                        # the order doesn't depend on what was found, so a round goes on where the last one ended
                        order = np.flatnonzero(inside.any(1) & (lists.size[names] > 0))
                        order = order[np.argsort(-most[row][order], kind="stable")][start:end]
                        order = order[(inside & (up >= kth))[order].any(1)]
                        at += [i] * len(order)
                        to += names[order].tolist()
                yield f.drop(columns="kth").assign(windows=narrowed).iloc[at].assign(cluster=to)

        # few bytes, but a product with all centroids each: as many tasks as a shuffle has
        spread = state.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor")
        met = scratch.keep(spread.mapInPandas(visits, f"anchor long, label long, vector array<double>, windows {windows}, cluster long"), f"visits{start}_")
        if met.isEmpty():
            scratch.drop(met)
            break
        # queries and members of a list meet in blocks; a row for each cluster says how many
        parts = F.broadcast(met.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")))
        left = met.join(parts, "cluster").join(asked, "cluster")
        left = left.select(*met.columns, F.pmod(F.xxhash64("anchor"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        right = members.join(parts, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        by = ["cluster", "block", "part"]

        def kernel(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(m):
                m = m.sort_values("vec_id")
                ids, labels = m["vec_id"].to_numpy(), m["label"].to_numpy()
                y = np.array(m["vector"].tolist(), float)
                rows = max(1, (1 << 22) // len(y))
                for a in range(0, len(q), rows):
                    own = q.iloc[a : a + rows]
                    anchors = own["anchor"].to_numpy()
                    scores = products(np.array(own["vector"].tolist(), float), y)
                    fits = ((own["label"].to_numpy()[:, None] == labels) == same) & (anchors[:, None] != ids)
                    limits = [_windows(w) for w in own["windows"]]
                    for slot in range(max(len(low) for low, _ in limits)):
                        low = np.array([x[slot] if slot < len(x) else LARGEST for x, _ in limits])[:, None]
                        high = np.array([x[slot] if slot < len(x) else -LARGEST for _, x in limits])[:, None]
                        i, j = leading(scores, fits & (scores >= low) & (scores <= high), k)
                        out.append(pd.DataFrame({"anchor": anchors[i], "slot": np.full(len(i), slot, np.int32), "vec_id": ids[j], "score": scores[i, j]}))
            return pd.concat(out) if out else pd.DataFrame(columns=["anchor", "slot", "vec_id", "score"])

        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(kernel, "anchor long, slot int, vec_id long, score long")
        found = found if best is None else found.unionByName(best)
        old, best = best, scratch.keep(few(found, ["anchor", "slot"], k, F.desc("score"), "vec_id"), f"best{start}_")
        full = best.groupBy("anchor", "slot").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        full = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))
        state = queries.join(full, "anchor", "left").select(*queries.columns, "kth")
        scratch.drop(met, *([old] if old is not None else []))
        visited, batch = end, batch * FACTOR
    return best if best is not None else spark.createDataFrame([], "anchor long, slot int, vec_id long, score long")


def _windows(own) -> tuple[np.ndarray, np.ndarray]:
    return np.array([w["low"] for w in own], np.int64), np.array([w["high"] for w in own], np.int64)


def window(score: Column) -> tuple[Column, Column]:
    """Whole scores n with LOW * score <= 100 * n <= HIGH * score."""
    return F.ceil(score * LOW / 100).cast("long"), F.floor(score * HIGH / 100).cast("long")


def mined(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are the rows whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    with Scratch(spark, "negatives") as kept:
        scratch = Scratch(spark, "steps")
    rows = scratch.keep(relabelled(usable(embeddings)), "rows")
    lists, members = inverted(rows, scratch)
    members = scratch.keep(members, "members")
    anchors = few(rows.where(F.col("vec_id") % every == 0), ["vec_id"], 1, "label", F.xxhash64("vector")).select(F.col("vec_id").alias("anchor"), "label", "vector")
    everything = F.array(F.struct(F.lit(-LARGEST).cast("long").alias("low"), F.lit(LARGEST).cast("long").alias("high")))
    anchors = scratch.keep(anchors.withColumn("windows", everything), "anchors")
    positives = search(anchors, lists, members, True, POSITIVES, scratch).drop("slot")
    # a window for each positive score of an anchor, of which there are few; equal scores share theirs
    scores = positives.select("anchor", "score").distinct()
    low, high = window(F.col("score").cast("decimal(20,0)"))
    slot = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"))).cast("int") - 1
    scores = scratch.keep(scores.withColumns({"low": low, "high": high}).where("low <= high").withColumn("slot", slot), "windows")
    asked = scores.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "low", "high"))), lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    asked = scratch.keep(anchors.drop("windows").join(asked, "anchor"), "asked")
    negatives = search(asked, lists, members, False, NEGATIVES, scratch)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")).alias("rank")
    ranked = negatives.select("anchor", "slot", rank, F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = scores.select("anchor", "slot", F.col("score").alias("positive_score")).join(ranked, ["anchor", "slot"])
    pairs = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(named, ["anchor", "positive_score"])
    out = kept.keep(out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "result")
    scratch.clear()
    return out


SUMMARY_SQL = f"""
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({LEVELS} * x)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
