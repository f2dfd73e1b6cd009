"""Diagnosis of chunks: what kind of process a pair of spans shows, how transparent it is, and what it contains.

All are column expressions over a chunk's decomposition: symbols matched alike
and changed, deletions, insertions, links, lengths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a process adds to the transparency.
PROCESS_SHIFT = {"compact_fusion": 0.03, "residual_reduction": 0.01, "nasal_fusion": 0.05, "glide_or_vocalization_fusion": 0.04, "balanced_restructuring": 0.02, "bundled_reduction": -0.04}


def has(features: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(features, name), F.lit(False))


def process(identity: Column, changed: Column, deletions: Column, insertions: Column, source: Column, target: Column, gone: Column) -> Column:
    """Name of the process; source, target: features of the one changed pair, gone: those of the one lost or won segment."""
    gaps = deletions + insertions
    events = changed + identity + gaps
    single = (changed == 1) & (gaps == 1)
    gained = has(source, "nasalized") != has(target, "nasalized")
    fusion = single & has(source, "vowel") & has(target, "vowel") & has(gone, "nasal") & gained
    glide = single & (has(source, "approximant") | has(target, "approximant"))
    return (
        F.when(fusion, "nasal_fusion")
        .when(glide, "glide_or_vocalization_fusion")
        .when(single & (events <= 2), "compact_fusion")
        .when((identity == 1) & (gaps == 1) & (events <= 2), "residual_reduction")
        .when((deletions > 0) & (insertions > 0) & (changed + identity <= 1), "balanced_restructuring")
        .when((events >= 3) & (gaps > 0) & (changed + identity > 0), "bundled_reduction")
        .otherwise("mixed_or_unclear")
    )


def transparency(s_len: Column, t_len: Column, identity: Column, changed: Column, deletions: Column, insertions: Column, gap_links: Column, links: Column, overlaps: Column, name: Column) -> Column:
    """How plainly a chunk reads as its parts, 0 to 1."""
    total, apart, gaps, matched = s_len + t_len, F.abs(s_len - t_len), deletions + insertions, identity + changed
    ratio = gap_links / links
    small = (total <= 4) & (apart == 1) & (matched == 1) & (gaps == 1)
    either = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 1.0 - 0.18 * apart - 0.24 * ratio - 0.14 * F.greatest(total - 3, F.lit(0)) - 0.09 * F.least(overlaps, F.lit(3)) / 3.0
    score = score - either((total >= 5) & (apart > 0), 0.10) - either(deletions >= 2, 0.10) - either(insertions >= 2, 0.10)
    score = score - either((deletions > 0) & (insertions == 0) & (apart > 0), 0.10) - either((insertions > 0) & (deletions == 0) & (apart > 0), 0.10)
    score = score + either(small & (changed == 1), 0.08) + either(small & (identity == 1), 0.03)
    score = score + either((apart == 0) & (deletions > 0) & (insertions > 0), 0.12) + either((matched >= 2) & (apart <= 1), 0.05)
    score = score + F.when((apart == 0) & (ratio == 0) & (total <= 4), 0.08).when((total <= 4) & (apart <= 1), 0.05).otherwise(0.0)
    shift = F.coalesce(*[F.when(name == k, v) for k, v in PROCESS_SHIFT.items()], F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + shift))


def tier(s_len: Column, t_len: Column, s_vowels: Column, t_vowels: Column, s_manners: Column, t_manners: Column) -> Column:
    """Prior penalty of a chunk: 0 for plain processes, 2 within a major class, 4 across; *_vowels: vowels among the segments, *_manners: features of all."""
    s_all, t_all, none = s_vowels == s_len, t_vowels == t_len, (s_vowels == 0) & (t_vowels == 0)
    uneven = s_len != t_len
    plain = (s_all & t_all & uneven) | (none & uneven & ((has(s_manners, "affricate") != has(t_manners, "affricate")) | has(s_manners, "prenasalized") | has(t_manners, "prenasalized") | (has(s_manners, "nasal") & has(t_manners, "nasal"))))
    return F.when(plain, 0.0).when((s_all & t_all) | none, 2.0).otherwise(4.0)


def overlaps(chunks: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by.., source, target, overlaps``: how many other chunks (arrays of symbols) lie within each, on both sides, and are shorter on one.

    A chunk's runs are looked up by equality, so chunks aren't compared with each other.
    """

    def runs(c: str) -> Column:
        n = F.size(c)
        every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(c, i, k))))
        return F.array_distinct(every)

    rows = chunks.select(*by, "source", "target").distinct()
    inner = rows.select(*by, "source", "target", F.explode(runs("source")).alias("s")).select("*", F.explode(runs("target")).alias("t"))
    shorter = (F.size("s") < F.size("source")) | (F.size("t") < F.size("target"))
    known = rows.select(*by, F.col("source").alias("s"), F.col("target").alias("t"))
    met = inner.where(shorter).join(known, [*by, "s", "t"]).groupBy(*by, "source", "target").agg(F.count(F.lit(1)).alias("overlaps"))
    return rows.join(met, [*by, "source", "target"], "left").select(*by, "source", "target", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


PARTS = "source array<string>, target array<string>, identity int, changed int, deletions int, insertions int, gap_links int, links int, changed_source array<string>, changed_target array<string>, gone array<string>"


def taken_apart(models: DataFrame) -> DataFrame:
    """``lect_a, lect_b`` and PARTS of the promoted chunks of trained models: each is aligned again symbol by symbol, without its own row.

    changed_* and gone are the features of the first changed pair and of the first lost or won symbol.
    """
    from lautwerk.functions.features import features
    from lautwerk.operators.lattice import Coded, align_many
    from lautwerk.operators.pairwise import rebuilt

    names = ["lect_a", "lect_b", *[x.split(" ")[0] for x in PARTS.split(", ")]]

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = rebuilt(rows)
        every = sorted(m.chunks)
        if not every:
            return pd.DataFrame(columns=names)
        whole = m.coded()
        links, _ = align_many([s for s, _ in every], [t for _, t in every], Coded(whole.symbols, whole.one, max_chunk=1, reorder=False))
        out = []
        for k, (s, t) in enumerate(every):
            own = links[links[:, 0] == k][:, 1:].tolist()
            pairs = [(s[a], t[b]) for a, n, b, l in own if n == l]
            gone = [s[a] if n else t[b] for a, n, b, l in own if n != l]
            moved = [p for p in pairs if p[0] != p[1]]
            lost, won = sum(n > l for _, n, _, l in own), sum(n < l for _, n, _, l in own)
            look = lambda x: sorted(features(x)) if x else []
            first = moved[0] if moved else (None, None)
            out.append((*key, list(s), list(t), len(pairs) - len(moved), len(moved), lost, won, lost + won, len(own), look(first[0]), look(first[1]), look(gone[0] if gone else None)))
        return pd.DataFrame(out, columns=names)

    return models.groupBy("lect_a", "lect_b").applyInPandas(kernel, f"lect_a string, lect_b string, {PARTS}")


def diagnosed(models: DataFrame) -> DataFrame:
    """Promoted chunks of trained models with their parts, ``process``, ``transparency`` and ``overlaps``."""
    by = ["lect_a", "lect_b"]
    rows = taken_apart(models)
    rows = rows.join(overlaps(rows, by), [*by, "source", "target"])
    name = process(F.col("identity"), F.col("changed"), F.col("deletions"), F.col("insertions"), F.col("changed_source"), F.col("changed_target"), F.col("gone"))
    rows = rows.withColumn("process", name)
    score = transparency(F.size("source"), F.size("target"), F.col("identity"), F.col("changed"), F.col("deletions"), F.col("insertions"), F.col("gap_links"), F.col("links"), F.col("overlaps"), F.col("process"))
    return rows.withColumn("transparency", score).drop("changed_source", "changed_target", "gone", "gap_links")
