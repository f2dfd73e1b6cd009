"""Transcription drift: what one lect writes as a unit and another, in the same corpus, writes apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lautwerk.operators.graph import Scratch


def written_apart(sequences: DataFrame, lect: str, symbols: str) -> DataFrame:
    """``lect, other, grapheme, first, second``: the grapheme is used by lect and never by other, which writes its two pieces side by side.

    Sequences are read once: what is written and kept are the distinct (lect,
    symbol, next symbol), which grow with the vocabulary; all joins are on them.
    Null symbols neither stand nor neighbour anything.
    """
    scratch = Scratch(sequences.sparkSession, "drift")
    each = F.explode(F.arrays_zip(F.col(symbols).alias("first"), F.slice(symbols, 2, F.greatest(F.size(symbols) - 1, F.lit(0))).alias("second")))
    seen = scratch.keep(sequences.where(F.size(symbols) > 0).select(F.col(lect).alias("lect"), each.alias("x")).select("lect", "x.*").distinct(), "neighbours")
    words = scratch.keep(seen.where("first is not null").select("lect", F.col("first").alias("grapheme")).distinct(), "words")
    pieces = seen.where("first is not null and second is not null").select(F.col("lect").alias("other"), "first", "second", F.concat("first", "second").alias("grapheme"))
    met = pieces.join(words, "grapheme").where("lect <> other")
    own = words.select(F.col("lect").alias("other"), "grapheme")
    return met.join(own, ["other", "grapheme"], "left_anti").select("lect", "other", "grapheme", "first", "second")


# Modifier letters and what spells them, and the sign of length.
MODIFIERS = {"ʰ": "h", "ʷ": "w", "ʲ": "j", "ⁿ": "n"}
LENGTH = "ː"


def decompositions(grapheme: Column, parts: Column | None = None) -> Column:
    """Array of (kind, pieces) in which another source may write a grapheme: its segmentation, a modifier spelt out, length by doubling.

    parts: the pieces that segmentation gives, where it gives two to four.
    """
    none = F.lit(None).cast("struct<kind:string,pieces:array<string>>")
    kind = lambda name, *pieces: F.struct(F.lit(name).alias("kind"), F.array(*pieces).alias("pieces"))
    out = []
    if parts is not None:
        out.append(F.when(F.size(parts).between(2, 4), F.struct(F.lit("segmentation").alias("kind"), parts.alias("pieces"))).otherwise(none))
    base = F.substring(grapheme, F.lit(1), F.length(grapheme) - 1)
    for mark, spelt in MODIFIERS.items():
        out.append(F.when(F.endswith(grapheme, F.lit(mark)) & (F.length(grapheme) > 1), kind("modifier", base, F.lit(spelt))).otherwise(none))
    out.append(F.when(F.endswith(grapheme, F.lit(LENGTH)) & (F.length(grapheme) > 1), kind("length", base, base)).otherwise(none))
    return F.array_compact(F.array(*out))


def drifts(sequences: DataFrame, lect: str, symbols: str, segmentation: DataFrame | None = None) -> DataFrame:
    """``lect, other, grapheme, kind, pieces, forms, corroborated``: lect uses the grapheme and other never does, but uses all of its pieces and writes them side by side.

    forms: lect's sequences with the grapheme; corroborated: other's sequences with the run of pieces, at least one.
    Sorted by these two, then by names.  segmentation: ``grapheme, parts``.
    """
    used = sequences.select(F.col(lect).alias("lect"), F.explode(F.array_distinct(symbols)).alias("grapheme")).groupBy("lect", "grapheme").agg(F.count(F.lit(1)).alias("forms"))
    names = used.select("grapheme").distinct()
    if segmentation is not None:
        names = names.join(segmentation, "grapheme", "left")
    cut = names.select("grapheme", F.explode(decompositions(F.col("grapheme"), F.col("parts") if segmentation is not None else None)).alias("d")).select("grapheme", "d.*")
    # runs of the lengths that pieces have, distinct by sequence
    n = F.size(symbols)

    def of_length(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(symbols, i, k))).otherwise(F.array().cast("array<array<string>>"))

    runs = F.flatten(F.array(*[of_length(k) for k in (2, 3, 4)]))
    wanted = F.broadcast(cut.select("pieces").distinct()) if segmentation is None else cut.select("pieces").distinct()
    seen = sequences.select(F.col(lect).alias("other"), F.explode(F.array_distinct(runs)).alias("pieces")).join(wanted, "pieces")
    seen = seen.groupBy("other", "pieces").agg(F.count(F.lit(1)).alias("corroborated"))
    met = used.join(cut, "grapheme").join(seen, "pieces").where("lect <> other")
    own = used.select(F.col("lect").alias("other"), "grapheme")
    out = met.join(own, ["other", "grapheme"], "left_anti")
    rows = out.select("lect", "other", "grapheme", "kind", "pieces", "forms", "corroborated")
    return rows.orderBy(F.desc("corroborated"), F.desc("forms"), "lect", "other", "grapheme", "kind")


def written_out(rows: DataFrame) -> DataFrame:
    """A line of text for each drift."""
    line = F.concat("lect", F.lit(" writes "), "grapheme", F.lit(" where "), "other", F.lit(" writes "), F.array_join("pieces", " "), F.lit(" ("), "kind", F.lit("; "), F.col("forms").cast("string"), F.lit(" against "), F.col("corroborated").cast("string"), F.lit(")"))
    return rows.select(line.alias("value"))
