"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs (at line ends, long ones also at sentence ends);
the distinct 64-bit digests of these are its set.  A sketch has cells in three
parts; every digest goes to one cell of each part, and a cell keeps a count,
the exclusive or of its digests, and that of their checks.  Two sketches are
subtracted cell by cell; cells that then hold one digest only are peeled, and
what they give is taken from the digest's other cells, until nothing is left:
the digests in which two versions differ.

A fingerprint is a sketch with its set's size and a parity estimator: 256 bits,
of which each digest flips one.  Parts have a power of two of cells, and a
larger sketch folds to a smaller one of the same set, so fingerprints of
different sizes can be subtracted.  A fingerprint is made so large that it
peels by itself; those that don't are made anew, larger.  Hence it can also be
unfolded: its digests are recovered and put into a larger sketch.

The likeness of two fingerprints is that of their sets, intersection over
union, from the sizes and the number of digests that peeling their difference
recovers.  The estimators' bits that differ say how large the sketches to be
subtracted should be; where peeling gets stuck, the comparison is tried again
with larger ones, as often as it takes.  A likeness so depends on the two
fingerprints only; as sketches are sums, the cells of a difference are summed
up from both sets' digests at once.

Everything is DataFrame functions.  Cells are rows: a sketch is a grouped
count and exclusive or, so subtracting is the same aggregation with a sign, and
a step of peeling is one pass that lets every pure cell of one part give its
digest back to the cells of all three (within a part no digest is pure twice).
A long document is many rows, not a large one.

Each document meets the next one in a block of neighbouring ids; a block's last
document meets the first of the next block by a join on blocks.  Blocks are
cut by quantiles of the ids, so sparse or hashed ids fill them evenly.  Texts
are shuffled once, to their blocks; what is made of them is written bucketed by
block, and all that follows is grouped and joined by block first, so neither
digests nor fingerprints are shuffled.

Defined cases: a null text is an empty one, which has one empty paragraph;
null ids come first, and rows of one id are in the order of their texts'
digests; the only row of a table is its own successor; repeated rows have
equal fingerprints; texts of any length are used whole; columns besides doc_id
and text aren't looked at, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.llm.common import Scratch

#: Cells of a part: the power of two from LOAD x digests + SPARE up; 64-bit words of the estimator.
LOAD, SPARE, WORDS = 0.55, 8, 4
#: A sketch that got stuck is followed by one of so many times the cells.
GROW = 4
#: Passes of peeling, a part's cells in each, in turn; passes of one plan, a multiple of the three parts.
PASSES, STEP = 18, 6
#: Rows of a block, about; pieces of the ids' range that are as populous as each other; blocks of a group of blocks.
BLOCK, PIECES, GROUP = 512, 64, 4096
#: The row of a comparison that counts peeled digests.
TALLY = -1


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, r"\n|(?<=[.!?]) "), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    """32 bits."""
    return F.xxhash64(digest, F.lit(101)).bitwiseAND(F.lit(0xFFFFFFFF))


def third_for(n: Column) -> Column:
    """Cells of a part for n digests."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n.cast("double") * LOAD + SPARE)).cast("int"))


def place(digest: Column, part: int, third: Column) -> Column:
    """The cell of a digest in one of the three parts; with a smaller power of two it is the folded cell."""
    return F.xxhash64(digest, F.lit(part)).bitwiseAND(third - 1) + third * part


def parity(sets: Column) -> Column:
    """The estimator of an array of digests: WORDS longs whose bits tell an odd number of digests from an even one."""

    def word(k: int) -> Column:
        def flip(acc: Column, d: Column) -> Column:
            at = F.xxhash64(d, F.lit(7)).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int")
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)))
            return acc.bitwiseXOR(F.when(F.shiftright(at, 6) == k, bit).otherwise(F.lit(0).cast("long")))

        return F.aggregate(sets, F.lit(0).cast("long"), flip)

    return F.array(*[word(k) for k in range(WORDS)])


def estimated(a: Column, b: Column, sizes: Column) -> Column:
    """How many digests two sets differ in, about, by their estimators; where these are full, all of both."""
    odd = reduce(lambda x, y: x + y, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WORDS)])
    bits = 64 * WORDS
    share = 1 - 2 * odd / F.lit(float(bits))
    return F.least(F.when(share > 0.1, -F.ln(share) * (bits / 2) * 1.15).otherwise(sizes.cast("double")), sizes.cast("double"))


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of rows: counts with their signs, exclusive ors of digests and of checks; cells that are empty go."""
    out = rows.groupBy(*keys, "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return out.where((F.col("c") != 0) | (F.col("k") != 0) | (F.col("h") != 0))


def sketched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of ``rows(keys.., third, d, sign)``, a row for each digest."""
    cells = F.explode(F.array(*[place(F.col("d"), p, F.col("third")) for p in range(3)]))
    each = rows.select(*keys, F.col("sign").alias("c"), F.col("d").alias("k"), check(F.col("d")).alias("h"), cells.alias("cell"))
    return _summed(each, keys)


def passed(cells: DataFrame, keys: list[str], passes: int) -> DataFrame:
    """Cells after so many passes, from the first part on.

    A pass looks at one part: a pure cell gives its digest, with the opposite
    sign, to its three cells (itself among them), and one to the tally.
    """
    zero = F.lit(0).cast("long")
    for n in range(passes):
        part, third = n % 3, F.col("third")
        own = F.struct("cell", "c", "k", "h")
        # one digest: its check and its place must be this cell's
        pure = (F.col("cell") >= third * part) & (F.col("cell") < third * (part + 1)) & (F.abs("c") == 1) & (check(F.col("k")) == F.col("h"))
        pure = pure & (place(F.col("k"), part, third) == F.col("cell"))
        gives = [F.struct(place(F.col("k"), p, third).alias("cell"), (-F.col("c")).alias("c"), F.col("k"), F.col("h")) for p in range(3)]
        tally = F.struct(F.lit(TALLY).cast("long").alias("cell"), F.lit(1).cast("long").alias("c"), zero.alias("k"), zero.alias("h"))
        rows = cells.select(*keys, F.explode(F.when(pure, F.array(own, *gives, tally)).otherwise(F.array(own))).alias("x"))
        cells = _summed(rows.select(*keys, "x.*"), keys)
    return cells


def peeled(cells: DataFrame, keys: list[str], passes: int = PASSES, scratch: Scratch | None = None) -> DataFrame:
    """``keys.., found, stuck`` of subtracted sketches: digests that were recovered, and cells that are left; keys hold third.

    With a scratch, what is left after STEP passes is written, still dealt out
    by the first key, so no plan (nor the code made of it) has all passes, and
    none are made once nothing is left; the result is written too.
    """
    def counted(cells: DataFrame) -> DataFrame:
        return cells.groupBy(*keys).agg(
            F.sum(F.when(F.col("cell") == TALLY, F.col("c")).otherwise(0)).alias("found"), F.count_if(F.col("cell") != TALLY).alias("stuck")
        )

    if scratch is None:
        return counted(passed(cells, keys, passes))
    for done in range(0, passes, STEP):
        before, cells = cells, scratch.keep(passed(cells, keys, min(STEP, passes - done)), "cells", bucket=keys[0])
        scratch.drop(before)
        if cells.where(F.col("cell") != TALLY).isEmpty():
            break
    found = scratch.keep(counted(cells), "peeled")
    scratch.drop(cells)
    return found


def differences(pairs: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """``keys.., differ, third`` of ``pairs(keys.., a, b, third)``: how many digests a and b differ in, and the cells that took; and the tries.

    Sketches of a and b with ``third`` cells a part are subtracted and peeled;
    what gets stuck is tried again with GROW times the cells until nothing is
    left.  Pairs whose sketches are equal differ in nothing and have no row.
    """
    left, out, tries = pairs, None, 0
    while True:
        signed = F.concat(*[F.transform(c, lambda d: F.struct(d.alias("d"), F.lit(s).cast("long").alias("sign"))) for c, s in (("a", 1), ("b", -1))])
        rows = left.select(*keys, "third", F.explode(signed).alias("x")).select(*keys, "third", "x.*")
        inner = [*keys, "third"]
        found = peeled(sketched(rows, inner), inner, scratch=scratch)
        tries += 1
        ok = found.where("stuck = 0").select(*keys, F.col("found").alias("differ"), "third")
        out = ok if out is None else out.unionByName(ok)
        stuck = scratch.keep(found.where("stuck > 0").select(*keys), "stuck")
        if stuck.isEmpty():
            return out, tries
        left = pairs.join(stuck, keys, "left_semi").withColumn("third", F.col("third") * GROW**tries)


def written(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys.., cells``: array of the sketches of (keys.., which, third, d) as text, a cell as place.count.digest.check; which: 0, 1, ..."""
    cell = F.concat_ws(".", F.lower(F.hex("cell")), F.col("c").cast("string"), F.lower(F.hex("k")), F.lower(F.hex("h")))
    cells = sketched(rows.withColumn("sign", F.lit(1).cast("long")), [*keys, "which", "third"]).select(*keys, F.struct("which", "cell", cell.alias("text")).alias("x"))
    each = cells.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = [F.array_join(F.transform(F.filter("x", lambda c: c["which"] == w), lambda c: c["text"]), ",") for w in (0, 1)]  # noqa: B023
    return each.select(*keys, F.array(*text).alias("cells"))


def heading(n: Column, third: Column, bits: Column) -> Column:
    """What stands before the cells of a fingerprint: size of the set, cells of a part, estimator."""
    return F.concat_ws(":", n.cast("string"), third.cast("string"), *[F.lower(F.hex(bits[k])) for k in range(WORDS)])


def blocks(docs: DataFrame) -> Column:
    """The block of each row by its doc_id (a long), in the order of ids; null ids by their texts' digests, before all others.

    The pieces of the range between quantiles hold about as many rows each and
    are cut evenly, so as many blocks come out as rows ask for.
    """
    steps = [k / PIECES for k in range(1, PIECES)]
    ids = docs.where("doc_id is not null").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.approx_percentile("doc_id", steps, 10000).alias("q")).first()
    id_ = F.col("doc_id")
    bare = F.shiftrightunsigned(F.col("digest").bitwiseXOR(F.lit(-(1 << 63))), 44) - (1 << 22)  # 2 ** 20 blocks below all others
    if not ids.n:
        return bare
    cuts = sorted({ids.low, *ids.q, ids.high + 1})
    per = max(1, -(-ids.n // (PIECES * BLOCK)))
    out, first = F.lit(None).cast("long"), 0
    for a, b in zip(cuts, cuts[1:]):
        width = max(1, -(-(b - a) // per))
        out = F.when((id_ >= F.lit(a)) & (id_ < F.lit(b)), F.expr(f"cast((doc_id - {a}L) div {width}L as long)") + first).otherwise(out)
        first += -(-(b - a) // width)
    return F.when(id_.isNull(), bare).otherwise(out)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc_id, text, ...)`` with next_<column> of the row that follows in the order of doc_id and text's digest; the first follows the last."""
    docs = docs.withColumn("digest", F.xxhash64("text"))
    block = blocks(docs)
    order = [F.col("doc_id").asc_nulls_first(), "digest", "text"]
    rows = docs.select("doc_id", "digest", *columns, block.alias("block"))
    ahead = F.lead(F.struct(*columns)).over(Window.partitionBy("block").orderBy(*order))
    met = rows.withColumn("ahead", ahead)
    names = docs.select(block.alias("block")).distinct().withColumn("many", F.floor(F.col("block") / GROUP))
    few = names.groupBy("many").agg(F.min("block").alias("first"))
    few = few.withColumn("then", F.lead("first").over(Window.orderBy("many")))
    least = names.agg(F.min("block").alias("least"))
    follow = F.lead("block").over(Window.partitionBy("many").orderBy("block"))
    names = names.withColumn("follow", follow).join(few, "many").crossJoin(F.broadcast(least))
    names = names.select("block", F.coalesce("follow", "then", "least").alias("follow"))
    heads = rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("o"), "doc_id", "digest", *columns)).alias("head"))
    heads = heads.select(F.col("block").alias("follow"), F.struct(*[F.col(f"head.{c}").alias(c) for c in columns]).alias("head"))
    heads = names.join(heads, "follow").select("block", "head")
    joined = met.join(heads, "block", "left").withColumn("ahead", F.coalesce("ahead", "head"))
    return joined.select("block", "doc_id", *columns, *[F.col(f"ahead.{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likenesses."""
    scratch = Scratch(docs.sparkSession, "fingerprint")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "block", "doc_id",
        n.cast("long").alias("n_chars"),
        digests(F.col("text")).alias("own"),
        digests(F.col("next_text")).alias("after"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "block", "doc_id", "n_chars", "own", "after",
        digests(F.col("edited")).alias("changed"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    rows = rows.withColumns({f"bits_{c}": parity(F.col(c)) for c in ("own", "after", "changed")} | {f"n_{c}": F.size(c) for c in ("own", "after", "changed")})
    rows = scratch.keep(rows, "rows", bucket="block")
    keys = ["block", "row"]

    def meeting(which: int, a: str, b: str | None) -> Column:
        """One subtraction: of two sets, or of a set from nothing, which tells whether its own sketch peels."""
        other = F.array().cast("array<bigint>") if b is None else F.col(b)
        size = F.size(a) if b is None else estimated(F.col(f"bits_{a}"), F.col(f"bits_{b}"), F.size(a) + F.size(b))
        return F.struct(F.lit(which).alias("which"), F.col(a).alias("a"), other.alias("b"), third_for(size).alias("third"))

    meetings = [meeting(0, "own", "changed"), meeting(1, "own", "after"), meeting(2, "own", None), meeting(3, "changed", None)]
    pairs = rows.select(*keys, F.explode(F.array(*meetings)).alias("x")).select(*keys, "x.*")
    differ, _ = differences(pairs, [*keys, "which"], scratch)
    wide = [F.max(F.when(F.col("which") == w, F.col(c))).alias(name) for w, c, name in ((0, "differ", "edited"), (1, "differ", "next"), (2, "third", "third"), (3, "third", "edited_third"))]
    # what is known of each row, by block: a map of its rows
    by_row = differ.groupBy(*keys).agg(*wide)
    known = by_row.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", F.struct("edited", "next", "third", "edited_third")))).alias("known"))
    found = F.try_element_at("known", "row")
    rows = rows.join(known.hint("shuffle_hash"), "block", "left").withColumn("found", found).drop("known")
    third = F.coalesce("found.third", third_for(F.col("n_own")))
    edited_third = F.coalesce("found.edited_third", third_for(F.col("n_changed")))
    sketches = F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(c).alias("a"), t.alias("third")) for w, (c, t) in enumerate((("own", third), ("changed", edited_third)))]))
    sketches = rows.select(*keys, sketches.alias("x")).select(*keys, "x.which", "x.third", F.explode("x.a").alias("d"))
    shown = written(sketches, keys)

    def likeness(other: str, number: str) -> Column:
        total, apart = (F.col("n_own") + F.col(other)).cast("double"), F.coalesce(f"found.{number}", F.lit(0))
        return (total - apart) / (total + apart)

    about = F.struct(
        "doc_id", "n_chars", "edited_sha256", heading(F.col("n_own"), third, F.col("bits_own")).alias("head"), heading(F.col("n_changed"), edited_third, F.col("bits_changed")).alias("edited_head"),
        likeness("n_changed", "edited").alias("near_edited"), likeness("n_after", "next").alias("near_next"),
    )
    packed = rows.select(*keys, about.alias("about")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", "about"))).alias("all"))
    out = shown.join(packed.hint("shuffle_hash"), "block").select("cells", F.element_at("all", F.col("row")).alias("a"))
    return out.select(
        "a.doc_id", "a.n_chars", "a.edited_sha256",
        F.concat_ws(";", "a.head", F.col("cells")[0]).alias("fingerprint"), F.concat_ws(";", "a.edited_head", F.col("cells")[1]).alias("edited_fingerprint"),
        "a.near_edited", "a.near_next",
    )
