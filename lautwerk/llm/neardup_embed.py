"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label and length are scaled to unit length and rotated onto the
principal axes of a bounded sample, which keeps their cosines.  Cells of the
leading axes, as wide as two linked vectors can lie apart, say which tiles of
vectors can hold links at all.  A tile of vectors meets another in one matrix:
products of the leading dimensions come first, what is left is bounded by the
product of the suffix norms, and pairs whose bound is below the threshold stop
there; for the others further dimensions are added in steps.  What reaches the
end is decided by the cosine of the vectors as they were, in double precision.

Equal vectors of a label are one class, compared once and counted by the
class's size.  Tiles are bounded, so a hot label or cell becomes many tiles,
not a large task; a tile pair returns a row for each class with its count and
one edge to its smallest partner in the pair's own components.

Defined cases: a null label, and a vector that is null, zero, or holds null or
non-finite components, is linked with nothing; vectors of different lengths
aren't linked; a cosine of exactly the threshold links; a null id is linked
with nothing and kept; repeated ids are rows of their own (all kept if the
smallest); columns besides those named aren't looked at, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lautwerk.llm.common import Scratch, components

THRESHOLD = 0.98
#: Vectors that the axes are fitted on, at most; classes of a tile, about; axes whose cells choose tiles, at most; dimensions of a step; rows compared at once.
SAMPLE, TILE, AXES, STEP, ROWS = 4096, 2048, 5, 16, 512
SLACK = 1e-9


def axes(vectors: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors (columns), the one of the largest share first."""
    _, basis = np.linalg.eigh(vectors.T @ vectors / len(vectors))
    return np.ascontiguousarray(basis[:, ::-1])


def linked(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of cosine >= threshold; x, y: rotated unit vectors, u, v: the vectors as they were."""
    d = x.shape[1]
    rest_x = np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]))
    rest_y = np.sqrt(np.maximum(0, np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]))
    k = min(step, d)
    part = x[:, :k] @ y[:, :k].T
    bound = part + np.outer(rest_x[:, k], rest_y[:, k]) if k < d else part
    i, j = np.nonzero(bound >= threshold - SLACK)
    sums = part[i, j]
    while k < d and len(i):
        to = min(d, k + step)
        sums = sums + np.einsum("ij,ij->i", x[i, k:to], y[j, k:to])
        k = to
        ok = sums + (rest_x[i, k] * rest_y[j, k] if k < d else 0) >= threshold - SLACK
        i, j, sums = i[ok], j[ok], sums[ok]
    nu, nv = np.sqrt(np.einsum("ij,ij->i", u, u)), np.sqrt(np.einsum("ij,ij->i", v, v))
    exact = np.einsum("ij,ij->i", u[i], v[j]) / (nu[i] * nv[j])
    ok = exact >= threshold
    return i[ok], j[ok]


def compare(left: pd.DataFrame, right: pd.DataFrame | None, basis: np.ndarray | None, threshold: float) -> pd.DataFrame:
    """Links of a tile with another, or within it: class, links (by class sizes), up (smallest class of its component here).

    Rows of the left tile are taken ROWS at a time, which bounds what is held at once.
    """

    def matrices(side):
        own = np.array(side["vector"].tolist(), float)
        unit = own / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
        return own, unit @ basis if basis is not None and len(basis) == own.shape[1] else unit

    u, x = matrices(left)
    v, y = (u, x) if right is None else matrices(right)
    n, shift = len(left), 0 if right is None else len(left)
    names = left["class"].to_numpy() if right is None else np.concatenate([left["class"].to_numpy(), right["class"].to_numpy()])
    sizes = left["size"].to_numpy() if right is None else np.concatenate([left["size"].to_numpy(), right["size"].to_numpy()])
    links, parent = np.zeros(len(names)), np.arange(len(names))
    for k in range(0, n, ROWS):
        i, j = linked(x[k : k + ROWS], y, u[k : k + ROWS], v, threshold)
        i = i + k
        j = j + shift
        apart = i != j
        i, j = i[apart], j[apart]
        links += np.bincount(i, sizes[j], len(names))
        if right is not None:
            links += np.bincount(j, sizes[i], len(names))
        while (parent[i] != parent[j]).any():  # the larger root hooks onto the smaller one, then paths are halved to the end
            p, q = parent[i], parent[j]
            low = np.minimum(p, q)
            np.minimum.at(parent, p, low)
            np.minimum.at(parent, q, low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, names)
    some = links > 0
    return pd.DataFrame({"class": names[some], "links": links[some].astype(np.int64), "up": least[parent][some]})


def valid() -> Column:
    """A label, and a vector of finite components that aren't all zero."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = table.sparkSession
    scratch = Scratch(spark, "embed")
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    # 128 bits stand for a vector of a label, so vectors themselves are no keys
    keyed = rows.withColumns({"ok": valid() & F.col("vec_id").isNotNull(), "h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(17), "vector", "label")})
    usable = keyed.where("ok")
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "vector")).alias("m"), F.count(F.lit(1)).alias("size"))
    classes = classes.select("h1", "h2", F.col("m.label").alias("label"), F.col("m.vector").alias("vector"), F.col("m.vec_id").alias("class"), "size")
    sample = usable.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["vector"].tolist()
    bases = {}
    for d in {len(v) for v in sample}:
        own = np.array([v for v in sample if len(v) == d], float)
        bases[d] = axes(own / np.linalg.norm(own, axis=1)[:, None])
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    # the cell of each class on the leading axes: a row with an index for each
    def cells(frames):
        for f in frames:
            out = []
            for v in f["vector"]:
                v = np.asarray(v, float)
                basis = bases.get(len(v))
                head = (v / np.sqrt(v @ v)) @ (basis[:, :AXES] if basis is not None else np.eye(len(v))[:, :AXES])
                out.append(np.floor(head / width).astype(int).tolist())
            f["cell"] = out
            yield f

    kind = rows.schema["label"].dataType.simpleString()
    classes = classes.mapInPandas(cells, f"h1 long, h2 long, label {kind}, vector array<double>, class long, size long, cell array<int>")
    classes = scratch.keep(classes.withColumn("dim", F.size("vector")), "classes")
    # as many axes as it takes for a label's cells to be about a tile each
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("members"))
    used = F.ceil(F.log(F.greatest(F.lit(1.0), F.col("members") / TILE)) / F.log(F.lit(4.0))).cast("int")
    sizes = scratch.keep(sizes.select("label", "dim", F.least(used, F.lit(AXES), F.col("dim")).alias("used")), "sizes")
    celled = classes.join(sizes, ["label", "dim"]).withColumn("cell", F.slice("cell", F.lit(1), F.col("used")))
    counts = celled.groupBy("label", "dim", "used", "cell").agg(F.count(F.lit(1)).alias("members"))
    counts = scratch.keep(counts.withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int")), "cells")
    tile = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int").alias("tile")
    name = F.xxhash64("label", "dim", "cell", "tile").alias("name")
    dealt = celled.join(counts.select("label", "dim", "cell", "tiles"), ["label", "dim", "cell"]).select("*", tile).select(name, "class", "size", "vector")
    tiles = counts.select("label", "dim", "used", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    # a tile meets the tiles of its own and of the neighbouring cells: an equi-join on the cell
    steps = [(k, list(off)) for k in range(AXES + 1) for off in itertools.product((-1, 0, 1), repeat=k)]
    steps = F.broadcast(spark.createDataFrame(steps, "used int, step array<int>"))
    near = tiles.withColumn("left", name).join(steps, "used").select("label", "dim", F.zip_with("cell", "step", lambda c, o: c + o).alias("cell"), "left")
    other = tiles.select("label", "dim", "cell", name.alias("right"))
    pairs = scratch.keep(near.join(other, ["label", "dim", "cell"]).where("left <= right").select("left", "right"), "pairs")
    sides = pairs.select(F.col("left").alias("name"), "left", "right").unionByName(
        pairs.where("left <> right").select(F.col("right").alias("name"), "left", "right")
    )
    placed = dealt.join(sides, "name")

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = key
        pdf = pdf.sort_values("class")
        mine = pdf[pdf["name"] == left]
        basis = bases.get(len(mine["vector"].iloc[0])) if len(mine) else None
        return compare(mine, None if left == right else pdf[pdf["name"] == right], basis, threshold)

    met = placed.groupBy("left", "right").applyInPandas(kernel, "class long, links long, up long")
    met = scratch.keep(met, "met")
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    comp = components(met.select(F.col("class").alias("a"), F.col("up").alias("b")), scratch)
    known = classes.select("h1", "h2", "class", "size").join(links, "class", "left").join(comp.withColumnRenamed("node", "class"), "class", "left")
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "class").alias("component"))
    out = keyed.select("vec_id", "ok", "h1", "h2").join(known, F.col("ok") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", "vec_id")
    out = out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
    out = scratch.keep(out, "result")
    scratch.drop(classes, sizes, counts, pairs, met, comp)
    return out


SUMMARY_SQL = f"""
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN degree ON e.vec_id = degree.a
"""
