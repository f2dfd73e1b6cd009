"""Environments of the positions of words: one row for each token that holds there.

Words are distinct ones, so everything here is as large as a vocabulary.  A
token is ``slot:feature=value``.  Slots: the neighbours (preceding, following),
those two and three away (preceding@2 ...), anything before or after
(somewhere_preceding ...), the rest of the syllable and its neighbours
(same_syllable, previous_syllable, next_syllable, with their shape, nucleus and
weight), the place in word, syllable and morpheme, and stress here and beside.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.functions.features import UNKNOWN

SLOTS = (
    "position", "role", "syllable", "morpheme", "morpheme_index", "stress", "preceding_stress", "following_stress", "preceding", "following",
    "preceding@2", "preceding@3", "following@2", "following@3", "somewhere_preceding", "somewhere_following", "same_syllable", "previous_syllable", "next_syllable",
)
IMMEDIATE = ("position", "role", "syllable", "morpheme", "morpheme_index", "stress", "preceding_stress", "following_stress", "preceding", "following")


def described(graphemes: DataFrame, column: str = "grapheme") -> DataFrame:
    """``grapheme, features, sonority, syllabic`` of the distinct graphemes of a column, each looked up once."""
    from lautwerk.functions.features import features, is_syllabic, sonority

    @F.pandas_udf("features array<string>, sonority int, syllabic boolean")
    def look(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(sorted(features(g)), sonority(g), is_syllabic(g)) for g in names], columns=["features", "sonority", "syllabic"])

    return graphemes.select(F.col(column).alias("grapheme")).distinct().withColumn("f", look("grapheme")).select("grapheme", "f.*")


def own_nuclei(scores: Column, syllabic: Column) -> Column:
    """Places of syllabic segments, vowels, and strict peaks from liquids up."""
    n = F.size(scores)
    at = lambda k: F.element_at(scores, k + 1)

    def holds(k: Column) -> Column:
        s = at(k)
        left, right = F.when(k == 0, True).otherwise(F.try_element_at(scores, F.greatest(k, F.lit(1))) < s), F.coalesce(F.try_element_at(scores, k + 2) < s, F.lit(True))
        return (s >= 6) | F.element_at(syllabic, k + 1) | ((s >= 4) & left & right)

    return F.filter(F.sequence(F.lit(0), n - 1), holds)


def nuclei(scores: Column, syllabic: Column) -> Column:
    """Nuclei of a word; without any of its own, the first of the loudest segments."""
    own = own_nuclei(scores, syllabic)
    return F.when(F.size(own) > 0, own).otherwise(F.array((F.array_position(scores, F.array_max(scores)) - 1).cast("int")))


def breaks(scores: Column, tops: Column) -> Column:
    """Places where a syllable starts after the first: the onset grows leftwards as long as sonority doesn't rise away from the nucleus."""

    def between(a: Column, b: Column) -> Column:
        falls = F.when(b - a > 2, F.array_max(F.filter(F.sequence(a + 1, b - 2), lambda j: F.element_at(scores, j + 1) > F.element_at(scores, j + 2))))
        return F.when(b - a < 2, b).otherwise(F.coalesce(falls, a) + 1)

    n = F.size(tops)
    return F.when(n > 1, F.transform(F.slice(tops, 2, F.greatest(n - 1, F.lit(1))), lambda b, i: between(F.element_at(tops, i + 1), b))).otherwise(F.array().cast("array<int>"))


def syllabified(words: DataFrame) -> DataFrame:
    """``words(word, graphemes, given)`` with scores, tops (nuclei) and starts (of syllables after the first; those given, if any)."""
    each = words.select("word", F.posexplode("graphemes").alias("pos", "grapheme"))
    dims = described(each)
    met = each.join(dims, "grapheme", "left").select("word", F.struct("pos", F.coalesce("sonority", F.lit(UNKNOWN)).alias("s"), F.coalesce("syllabic", F.lit(False)).alias("y")).alias("x"))
    ordered = met.groupBy("word").agg(F.array_sort(F.collect_list("x")).alias("x")).select("word", F.col("x.s").alias("scores"), F.col("x.y").alias("syllabic"))
    out = words.join(ordered, "word").withColumn("tops", nuclei(F.col("scores"), F.col("syllabic")))
    inner = F.array_sort(F.array_distinct(F.filter("given", lambda b: (b > 0) & (b < F.size("graphemes")))))
    return out.withColumn("starts", F.when(F.size(F.coalesce(inner, F.array().cast("array<int>"))) > 0, inner).otherwise(breaks(F.col("scores"), F.col("tops"))))


def syllable_counts(sets: DataFrame) -> DataFrame:
    """One row: ``syllabified, inferred``: forms that have syllables (any but the empty), and those whose nucleus is only their loudest segment.

    A form that comes with its syllables infers nothing.  Distinct words are looked at once.
    """
    rows = sets.where(F.size("segments") > 0).groupBy(F.xxhash64("segments", "syllables").alias("word")).agg(
        F.first("segments").alias("s"), F.first("syllables").alias("given"), F.count(F.lit(1)).alias("forms")
    )
    rows = syllabified(rows.select("word", F.col("s.grapheme").alias("graphemes"), "given", "forms"))
    bare = (F.size(own_nuclei(F.col("scores"), F.col("syllabic"))) == 0) & (F.size(F.coalesce("given", F.array().cast("array<int>"))) == 0)
    zero = F.lit(0).cast("long")
    return rows.agg(F.coalesce(F.sum("forms"), zero).alias("syllabified"), F.coalesce(F.sum(F.when(bare, F.col("forms"))), zero).alias("inferred"))


def placed(words: DataFrame) -> DataFrame:
    """``word, pos, grapheme, n, syllable, syllables, top, first, last`` and names of place: position, role, in_word (the syllable's).

    top is the syllable's nucleus (null without one), first and last its segments' places.
    """
    rows = syllabified(words).select("word", "tops", "starts", F.size("graphemes").alias("n"), F.posexplode("graphemes").alias("pos", "grapheme"))
    upto = F.filter("starts", lambda b: b <= F.col("pos"))
    after = F.filter("starts", lambda b: b > F.col("pos"))
    rows = rows.withColumns({
        "syllable": F.size(upto), "syllables": F.size("starts") + 1,
        "first": F.coalesce(F.array_max(upto), F.lit(0)), "last": F.coalesce(F.array_min(after), F.col("n")) - 1,
    })
    top = F.array_min(F.filter("tops", lambda t: (t >= F.col("first")) & (t <= F.col("last"))))
    # an open syllable ends in its nucleus
    rows = rows.withColumns({"top": top, "open_before": F.array_contains("tops", F.col("first") - 1) & (F.col("first") > 0)})
    alone = (F.col("pos") == F.col("first")) & (F.col("top") == F.col("pos") + 1) & F.col("open_before")
    role = F.when(F.col("top").isNull() | (F.col("pos") > F.col("top")), "coda").when(F.col("pos") == F.col("top"), "nucleus").when(alone, "ambisyllabic").otherwise("onset")
    end = F.col("syllables") - 1 - F.col("syllable")
    in_word = F.when(F.col("syllable") == 0, "initial").when(end == 0, "final").when(end == 1, "penultimate").when(end == 2, "antepenultimate").otherwise("other")
    position = F.when(F.col("pos") == 0, "initial").when(F.col("pos") == F.col("n") - 1, "final").otherwise("medial")
    return rows.withColumns({"role": role, "in_word": in_word, "position": position}).drop("tops", "starts", "open_before")


def shapes(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """``word, syllable, shape, nucleus, weight`` of placed rows; nucleus and weight are null without a nucleus."""
    tops = rows.where("pos = top").join(dims, "grapheme").select("word", "syllable", "top", "last", F.array_contains("features", "long").alias("long"))
    bare = rows.where("top is null").select("word", "syllable").distinct()
    closed = F.col("last") > F.col("top")
    out = tops.select("word", "syllable", F.when(closed, "closed").otherwise("open").alias("shape"), F.when(F.col("long"), "long").otherwise("short").alias("nucleus"), F.when(closed | F.col("long"), "heavy").otherwise("light").alias("weight"))
    none = F.lit(None).cast("string")
    return out.unionByName(bare.select("word", "syllable", F.lit("closed").alias("shape"), none.alias("nucleus"), none.alias("weight")))


def morpheme_placement(pos: Column, n: Column, starts: Column) -> tuple[Column, Column]:
    """Whether a place begins, ends, lies in or makes up its morpheme, and the morpheme's number (7 at most); starts: where morphemes after the first begin."""
    index = F.size(F.filter(starts, lambda b: b <= pos))
    begins = (pos == 0) | F.array_contains(starts, pos)
    ends = (pos == n - 1) | F.array_contains(starts, pos + 1)
    return F.when(begins & ends, "only").when(begins, "initial").when(ends, "final").otherwise("internal"), F.least(index, F.lit(7))


def tokens(words: DataFrame) -> DataFrame:
    """``word, pos, slot, feature`` (feature: name=value) of ``words(word, graphemes, given, morphemes, stress)``; arrays of places, stress by segment."""
    rows = placed(words.select("word", "graphemes", "given"))
    dims = described(rows)
    value = dims.select("grapheme", F.explode("features").alias("f")).select("grapheme", F.concat("f", F.lit("=+")).alias("feature"))
    spots = rows.select("word", "pos", "n", "syllable", "grapheme")
    other = spots.select("word", F.col("pos").alias("at"), F.col("syllable").alias("there"), "grapheme")
    met = spots.drop("grapheme").join(other, "word").where("pos <> at")
    off = F.col("at") - F.col("pos")
    side = F.when(off < 0, "preceding").otherwise("following")
    near = F.when(F.abs(off) == 1, side).when(F.abs(off) <= 3, F.concat_ws("@", side, F.abs(off).cast("string")))
    step = F.col("there") - F.col("syllable")
    around = F.when(step == 0, "same_syllable").when(step == -1, "previous_syllable").when(step == 1, "next_syllable")
    slots = F.explode(F.array_compact(F.array(near, F.concat(F.lit("somewhere_"), side), around)))
    out = met.select("word", "pos", "grapheme", slots.alias("slot")).distinct().join(value, "grapheme").select("word", "pos", "slot", "feature").distinct()
    shape = shapes(rows, dims)
    kinds = F.explode(F.array_compact(F.array(F.concat(F.lit("shape="), "shape"), F.concat(F.lit("nucleus="), "nucleus"), F.concat(F.lit("weight="), "weight"))))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.lit("previous_syllable").alias("slot")), F.struct(F.lit(-1).alias("d"), F.lit("next_syllable").alias("slot"))))
    shape = shape.select("word", "syllable", kinds.alias("feature")).select("word", "syllable", "feature", sides.alias("s"))
    shape = shape.select("word", (F.col("syllable") + F.col("s.d")).alias("syllable"), F.col("s.slot").alias("slot"), "feature")
    out = out.unionByName(spots.select("word", "pos", "syllable").join(shape, ["word", "syllable"]).select("word", "pos", "slot", "feature"))
    marks = words.select("word", "morphemes", "stress")
    own = rows.join(marks, "word")
    has = F.size(F.coalesce("morphemes", F.array().cast("array<int>"))) > 0
    place, index = morpheme_placement(F.col("pos"), F.col("n"), F.col("morphemes"))
    stress = lambda k: F.nullif(F.try_element_at("stress", k), F.lit(""))
    before = F.when(F.col("pos") > 0, stress(F.greatest(F.col("pos"), F.lit(1))))
    named = {
        "position": F.col("position"), "role": F.col("role"), "syllable": F.col("in_word"), "morpheme": F.when(has, place), "morpheme_index": F.when(has, index.cast("string")),
        "stress": stress(F.col("pos") + 1), "preceding_stress": before, "following_stress": stress(F.col("pos") + 2),
    }
    single = F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("slot"), c.alias("feature"))) for k, c in named.items()])))
    return out.unionByName(own.select("word", "pos", single.alias("x")).select("word", "pos", "x.*"))


def environments(words: DataFrame) -> DataFrame:
    """``word, pos, tokens``: the environment of each place, sorted: the tokens of ``tokens``, made of arrays within a word, so that no token is shuffled."""
    rows = placed(words.select("word", "graphemes", "given"))
    dims = described(rows)
    none = F.array().cast("array<string>")
    held = rows.join(dims.select("grapheme", F.transform("features", lambda f: F.concat(f, F.lit("=+"))).alias("features")), "grapheme", "left")
    cell = F.struct("pos", "syllable", F.coalesce("features", none).alias("features"), "role", "in_word", "position")
    cells = held.groupBy("word").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    shape = shapes(rows, dims)
    kinds = F.array_compact(F.array(F.concat(F.lit("shape="), "shape"), F.concat(F.lit("nucleus="), "nucleus"), F.concat(F.lit("weight="), "weight")))
    shape = shape.groupBy("word").agg(F.collect_list(F.struct("syllable", kinds.alias("kinds"))).alias("shapes"))
    met = cells.join(shape, "word", "left").join(words.select("word", "morphemes", "stress"), "word")
    each = met.select("*", F.posexplode("cells").alias("pos", "c"))
    n = F.size("cells")

    def named(slot, features):
        return F.transform(features, lambda f: F.concat(slot, F.lit(":"), f))

    def of_other(x):
        off, step = x["pos"] - F.col("pos"), x["syllable"] - F.col("c.syllable")
        side = F.when(off < 0, "preceding").otherwise("following")
        near = F.when(F.abs(off) == 1, side).when(F.abs(off) <= 3, F.concat_ws("@", side, F.abs(off).cast("string")))
        around = F.when(step == 0, "same_syllable").when(step == -1, "previous_syllable").when(step == 1, "next_syllable")
        slots = F.array_compact(F.array(near, F.concat(F.lit("somewhere_"), side), around))
        return F.when(off == 0, none).otherwise(F.flatten(F.transform(slots, lambda s: named(s, x["features"]))))

    def of_shape(x):
        step = x["syllable"] - F.col("c.syllable")
        return F.when(step == -1, named(F.lit("previous_syllable"), x["kinds"])).when(step == 1, named(F.lit("next_syllable"), x["kinds"])).otherwise(none)

    place, index = morpheme_placement(F.col("pos"), n, F.coalesce("morphemes", F.array().cast("array<int>")))
    broken = F.size(F.coalesce("morphemes", F.array().cast("array<int>"))) > 0
    stress = lambda k: F.nullif(F.try_element_at("stress", k), F.lit(""))
    single = {
        "position": F.col("c.position"), "role": F.col("c.role"), "syllable": F.col("c.in_word"), "morpheme": F.when(broken, place), "morpheme_index": F.when(broken, index.cast("string")),
        "stress": stress(F.col("pos") + 1), "preceding_stress": F.when(F.col("pos") > 0, stress(F.greatest(F.col("pos"), F.lit(1)))), "following_stress": stress(F.col("pos") + 2),
    }
    own = F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), c) for k, c in single.items()]))
    shaped = F.coalesce(F.flatten(F.transform("shapes", of_shape)), none)
    every = F.concat(F.flatten(F.transform("cells", of_other)), shaped, own)
    return each.select("word", "pos", F.array_sort(F.array_distinct(every)).alias("tokens"))


def coded(held: DataFrame) -> tuple[DataFrame, list[str]]:
    """``held`` (word, pos, tokens) with each token's place in the sorted list of those that occur, and that list.

    A place has a hundred tokens or so, of some kilobytes; their numbers are what joins and groups carry, or broadcast.
    The list is an inventory: slots times features.  It is made once for a frame.
    """
    if "_coded" not in held.__dict__:
        names = sorted(r.token for r in held.select(F.explode("tokens").alias("token")).distinct().collect())
        kind = "smallint" if len(names) < 1 << 15 else "int"

        def kernel(batches):
            known = pa.array(names, pa.string())
            for batch in batches:
                own = batch.column("tokens")
                codes = pc.index_in(own.flatten().cast(pa.string()), value_set=known).cast(pa.int16() if kind == "smallint" else pa.int32())
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
                yield pa.record_batch([batch.column("word"), batch.column("pos"), pa.ListArray.from_arrays(pa.array(ends), codes)], names=["word", "pos", "tokens"])

        held.__dict__["_coded"] = held.select("word", "pos", "tokens").mapInArrow(kernel, f"word long, pos int, tokens array<{kind}>"), names
    return held.__dict__["_coded"]


def codes_of(tokens: Column | str, names: list[str]) -> Column:
    """Places of tokens in the list of ``coded``; -1 for one that never occurs."""
    kind = "smallint" if len(names) < 1 << 15 else "int"

    @F.pandas_udf(f"array<{kind}>")
    def look(every: pd.Series) -> pd.Series:
        at = {t: k for k, t in enumerate(names)}
        return pd.Series([[at.get(t, -1) for t in own] for own in every], dtype=object)

    return look(tokens)


def candidates(vocabulary: DataFrame, slots: tuple[str, ...] = ("preceding", "following")) -> DataFrame:
    """``place, token``: the predicates that a search offers, slots in their order, features in that of the vocabulary(rank, feature)."""
    spark = vocabulary.sparkSession
    at = spark.createDataFrame([(k, s) for k, s in enumerate(slots)], "slot_place int, slot string")
    both = vocabulary.crossJoin(F.broadcast(at))
    place = F.row_number().over(Window.orderBy("slot_place", "rank", "feature")) - 1
    return both.select(place.cast("long").alias("place"), F.concat(F.col("slot"), F.lit(":"), F.col("feature"), F.lit("=+")).alias("token"))


def vocabulary(dims: DataFrame, preference: list[str] = ()) -> DataFrame:
    """``rank, feature, carriers`` of the contrastive features of an inventory (described rows): some but not all graphemes have it.

    Of features with the same carriers one stays: the first in ``preference``, then by name.
    """
    n = dims.agg(F.count(F.lit(1)).alias("n"))
    carried = dims.select("grapheme", F.explode("features").alias("feature")).groupBy("feature").agg(F.array_sort(F.collect_set("grapheme")).alias("carriers"))
    some = carried.crossJoin(F.broadcast(n)).where(F.size("carriers") < F.col("n"))
    rank = F.coalesce(*[F.when(F.col("feature") == f, k) for k, f in enumerate(preference)], F.lit(len(preference)))
    one = some.withColumn("carriers", F.array_join("carriers", " ")).groupBy("carriers").agg(F.min(F.struct(rank.alias("rank"), "feature")).alias("x"))
    return one.select("x.rank", "x.feature", "carriers")
