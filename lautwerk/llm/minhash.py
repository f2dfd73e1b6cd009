"""MinHash near-dedup by a Chosen-Path set similarity join.

A document is the set of its distinct word shingles.  Documents of equal sets
fall into one class, and classes are compared.  Each of several independent
trees branches the classes: at a node, a few coordinates of the MinHash
signature are selected (1 / threshold of them on average, by a hash of the
node), and the classes go on to the child of their minwise token there.  Nodes
of few members compare them exhaustively; larger ones branch again.  A pair of
similarity s stays together with probability s per selected coordinate, so
pairs above the threshold keep meeting down to small nodes, while a passage
that many documents share loses its hold from level to level.  Trees are
repeated until the recall of pairs at the threshold is near one.

A node whose members are close to the whole node gains nothing by branching:
as soon as the mean similarity of its members, estimated from the signatures,
reaches DENSE, it is met exactly; so are nodes that are still large after the
last step.  Such nodes of all trees that share members make up one group, so
each pair of a group is compared once, however many nodes it shares.  A group
is compared on the full sets, by tiles of its members: whoever isn't in the
component of most members meets all of them, and a tile gives no more links
than it joins components.  So no cap drops a pair; the work of a group grows
with the members outside its largest component times all of them.

A few trees come first.  Of their candidates each class's likeliest partner and
the smallest of its likely ones are confirmed on the full sets, so a large
group of copies becomes a component.  The other trees go only through nodes
that hold several components, and only for pairs across.

Candidates of small nodes must pass a necessary bound on set sizes and a wide
bound on the signatures' agreement, four deviations below what is expected at
the threshold; all whose ends are in different components by then are confirmed
on the full sets.  What a pair at the threshold of 0.75 is missed with is the
chance that it never meets (below 0.001 over all trees, even if its nodes stay
large without being dense for all DEEP steps) and that of the bound (below
0.0001).

Full sets are made again from the texts of those classes that are candidates.

Defined cases: a null text has no words; documents without words have an empty
set and are linked with nothing; texts of fewer words than a shingle are one
shingle, texts of any length are read whole; a similarity of exactly the
threshold links; a null id is linked with nothing, has no component and is
kept; repeated rows of an id are one document of the group each, with the same
answer (``one_of_each`` keeps one of them); columns besides doc_id and text
aren't looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.llm.common import Scratch, components, slices, texts_of

SHINGLE = 5
#: A link needs 100 x intersection >= PERCENT x union.
PERCENT = 75
#: Trees, coordinates of the signature that nodes below the root select from, members of a small node.
TREES, LANES, SMALL = 12, 64, 12
#: Trees whose links are confirmed first, steps below the root in these and in the other trees.
FIRST, SHALLOW, DEEP = 4, 4, 4
#: Mean similarity of members from which a large node is met exactly instead of branching again.
DENSE = 0.55
#: Members and shingles of a block of a group, about; two blocks are a tile.
TILE, MASS = 512, 250_000
#: Parts that the members of a node are dealt to where its size meets them.
SALTS = 16
#: Classes whose texts are fetched by a broadcast of their ids, at most; more of them are joined by a shuffle.
FETCH = 500_000
#: Lanes of two signatures that agree at least, of 64: over four deviations below what is expected at the threshold.
AGREE = 34
#: Agreement of pairs that are most likely links.
LIKELY = 54
#: Root coordinates: one for each tree, and a second one for every third tree, so 1 / threshold on average.
ROOTS = TREES + TREES // 3

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 2**32, ROOTS + LANES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, ROOTS + LANES, dtype=np.uint32)[:, None]
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z folded, words parted by ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    size = min(size, len(words))
    n = len(h) - size + 1
    s = h[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
    for k in range(1, size):
        s ^= s >> np.uint64(29)
        s *= _MIX
        s += h[k : n + k]
    s ^= s >> np.uint64(32)
    s *= _MIX
    s ^= s >> np.uint64(29)
    return np.unique(s)


def key_of(own: np.ndarray) -> int | None:
    """A hash of the whole set; none for an empty one."""
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).astype(np.int64)) if len(own) else None


def signature(own: np.ndarray) -> np.ndarray:
    """Minima of all coordinates' permutations, 32 bits each."""
    x = (own >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(len(_MULTIPLY), 0xFFFFFFFF, np.uint32)
    for k in range(0, x.shape[1], 1024):
        part = x[:, k : k + 1024] * _MULTIPLY
        part += _ADD
        np.minimum(out, part.min(axis=1), out=out)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), n, key (of the set), roots (array), lanes (array of 8 longs, a byte for each lane)."""

    @F.arrow_udf("n long, key long, roots array<int>, lanes array<long>")
    def sign(texts: pa.Array) -> pa.Array:
        n, key, roots, lanes = [], [], [], []
        for t in texts_of(texts):
            own = shingles(t)
            n.append(len(own))
            key.append(key_of(own))
            if not len(own):
                roots.append(None)
                lanes.append(None)
                continue
            sig = signature(own)
            roots.append(sig[:ROOTS].astype(np.int32))
            lanes.append(((sig[ROOTS:] >> np.uint32(7)) & np.uint32(255)).astype(np.uint8).view(np.int64))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(roots, pa.list_(pa.int32())), pa.array(lanes, pa.list_(pa.int64()))],
            names=["n", "key", "roots", "lanes"],
        )

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), sign(F.col("text")).alias("s")).select("doc_id", "mark", "s.*")


def agreement(a: str, b: str) -> Column:
    """Lanes in which two signatures agree."""
    low = F.lit(0x0101010101010101)
    differ = F.lit(0)
    for k in range(LANES // 8):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(low))
    return F.lit(LANES) - differ


def _lanes(prefix: str) -> list[Column]:
    return [F.col(f"l{k}").alias(f"{prefix}{k}") for k in range(LANES // 8)]


def alike(percent: int) -> Column:
    """What every linked pair fulfils: sizes that allow it, and signatures that agree widely."""
    small, large = F.least("an", "bn"), F.greatest("an", "bn")
    return (small * 100 >= large * percent) & (agreement("a", "b") >= AGREE)


def _child(step: int) -> Column:
    """The children of a node that a class goes to, by two selected lanes at once: one child always, a second one for 78 % of the nodes."""
    packed = F.array(*[F.col(f"l{k}") for k in range(LANES // 8)])

    def lane(salt: int) -> list[Column]:
        at = F.pmod(F.xxhash64("node", F.lit(salt), F.lit(step)), F.lit(LANES)).cast("int")
        word = F.element_at(packed, (F.shiftright(at, 3) + 1).cast("int"))
        return [at, F.call_function("shiftrightunsigned", word, (at.bitwiseAND(F.lit(7)) * 8).cast("int")).bitwiseAND(F.lit(255))]

    def child(salt: int) -> Column:
        return F.xxhash64("node", *lane(salt), *lane(salt + 1), F.lit(salt), F.lit(step))

    second = F.pmod(F.xxhash64("node", F.lit(77), F.lit(step)), F.lit(100)) < 78
    return F.explode(F.array_compact(F.array(child(1), F.when(second, child(3)))))


def _met(left: DataFrame, right: DataFrame, percent: int, less: bool, apart: bool) -> DataFrame:
    """Candidates among rows that share a node; apart: only of different components."""
    named = []
    for side, rows in (("a", left), ("b", right)):
        more = [F.col("comp").alias(f"{side}comp")] if apart else []
        named.append(rows.select(F.col("node").alias(f"{side}node"), F.col("key").alias(side), F.col("n").alias(f"{side}n"), *_lanes(side), *more))
    on = (F.col("anode") == F.col("bnode")) & (F.col("a") < F.col("b") if less else F.col("a") != F.col("b")) & alike(percent)
    if apart:
        on = on & (F.col("acomp") != F.col("bcomp"))
    met = named[0].join(named[1], on)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), agreement("a", "b").alias("agree"))


def roots(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each class, tree and selected root coordinate, where another class goes to the same node."""
    picks = [(t, t) for t in range(TREES)] + [(TREES + t // 3, t) for t in range(0, TREES, 3)]
    start = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(c), F.lit(t), F.element_at("roots", c + 1)).alias("node")) for c, t in picks]))
    rows = classes.select("key", start.alias("r")).select("key", "r.*")
    shared = scratch.keep(_with_totals(rows, {}, lambda whole: whole.where("size > 1").select("node")), "shared")
    out = scratch.keep(shared.join(classes.select("key", "n", *[F.col("lanes")[k].alias(f"l{k}") for k in range(LANES // 8)]), "key"), "roots")
    scratch.drop(shared)
    return out


def _with_totals(rows: DataFrame, sums: dict[str, Column], of) -> DataFrame:
    """``rows`` joined by node with what ``of`` makes of the nodes' sizes and sums.

    Members are summed up in SALTS parts of a node and meet its totals part by part, so a hot node is no hot task.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", "node"), F.lit(SALTS)))
    parts = rows.groupBy("node", "salt").agg(F.count(F.lit(1)).alias("size"), *[c.alias(k) for k, c in sums.items()])
    fold = {"low": F.min, "high": F.max}
    whole = parts.groupBy("node").agg(F.sum("size").alias("size"), *[fold.get(k, F.sum)(k).alias(k) for k in sums])
    return rows.join(parts.select("node", "salt").join(of(whole), "node"), ["node", "salt"]).drop("salt")


#: Lanes whose lowest bits tell the mean similarity of a node's members.
BITS = 16


def with_size(rows: DataFrame, apart: bool) -> DataFrame:
    """``rows`` of nodes of more than one member (apart: of more than one component), with the node's size and whether it is dense.

    Two members have the same bit in a lane if their tokens there are the
    same, else in half of all cases.  So the squared surplus of ones over
    zeros, over the size squared, is on average the share of pairs of members
    that agree.
    """
    ones = {f"b{j}": F.sum(F.shiftrightunsigned(F.col(f"l{j // 8}"), j % 8 * 8).bitwiseAND(F.lit(1))) for j in range(BITS)}
    ends = {"low": F.min("comp"), "high": F.max("comp")} if apart else {}

    def judged(whole: DataFrame) -> DataFrame:
        surplus = sum((F.pow((F.col("size") - 2 * F.col(f"b{j}")) / F.col("size"), 2) for j in range(BITS)), F.lit(0.0)) / BITS
        whole = whole.where("size > 1 and low <> high" if apart else "size > 1")
        return whole.select("node", "size", ((F.col("size") > SMALL) & (surplus >= DENSE)).alias("dense"))

    return _with_totals(rows, ones | ends, judged)


def explore(rows: DataFrame, steps: int, scratch: Scratch, percent: int, apart: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b, agree) that meet in small nodes, and the members (node, key, n) of dense nodes and of those still large after the last step.

    apart: components of classes are known; nodes within one component end, and only pairs across count; else
    the pairs with the heads of the latter nodes count, too.  A level is dropped once its children are written;
    they are written since their sizes, sums and members are read apart, and would be made for each of these again.
    """
    columns = ["key", "n", *[f"l{k}" for k in range(LANES // 8)], *(["comp"] if apart else [])]
    found, large = [], []
    for step in range(steps + 1):
        sized = scratch.keep(with_size(rows, apart), f"step{step}_")
        if step:
            scratch.drop(rows)
        small, rest = sized.where(F.col("size") <= SMALL), sized.where(F.col("size") > SMALL)
        found.append(scratch.keep(_met(small, small, percent, True, apart), "met"))
        if rest.isEmpty():
            break
        ends = rest if step == steps else rest.where("dense")
        large.append(scratch.keep(ends.select("node", "key", "n"), "large"))
        if not apart:
            found.append(scratch.keep(_met_heads(ends, columns, percent), "met"))
        rest = rest.where("not dense")
        if step == steps or rest.isEmpty():
            break
        rows = scratch.keep(rest.select(*columns, _child(step).alias("node")), "children")
        scratch.drop(sized)
    pairs = scratch.keep(_all(found).distinct(), "candidates")
    scratch.drop(sized, *found)
    return pairs, large


def _met_heads(members: DataFrame, columns: list[str], percent: int) -> DataFrame:
    """Candidates of nodes' members with the first one of their node; heads are copied to as many keys as members of a hot node are dealt to."""
    head = members.groupBy("node").agg(F.min(F.struct(*columns)).alias("h")).select("node", "h.*")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    head = head.withColumn("salt", salts).withColumn("node", F.xxhash64("node", "salt"))
    dealt = members.withColumn("node", F.xxhash64("node", F.pmod(F.xxhash64("key", "node"), F.lit(SALTS))))
    return _met(head, dealt, percent, False, False)


def grouped(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, key, n``: members (node, key, n) of nodes that share members, under one node; each key once."""
    least = members.groupBy("node").agg(F.min("key").alias("least"))
    star = members.join(least, "node").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    comp = components(star, scratch)
    rows = members.select("key", "n").distinct().join(comp.withColumnRenamed("node", "key").withColumnRenamed("comp", "node"), "key")
    out = scratch.keep(rows.select("node", "key", "n"), "groups")
    scratch.drop(comp)
    return out


def tile_links(left: list[np.ndarray], right: list[np.ndarray], cl: np.ndarray, cr: np.ndarray, percent: int, width: int = 4096) -> list[tuple[int, int]]:
    """Places (in left, in right) of links between sets of different components cl, cr: as few as join what is linked."""
    own = [*left, *right]
    member = np.repeat(np.arange(len(own)), [len(x) for x in own])
    values, code, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    stays = times[code] > 1
    member, code = member[stays], shared[code[stays]]
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        low, high = np.searchsorted(code, [start, start + width])
        held = np.zeros((len(own), width), np.float32)
        held[member[low:high], code[low:high] - start] = 1
        both += np.rint(held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    n = np.array([len(x) for x in own], np.int64)
    union = n[: len(left), None] + n[None, len(left) :] - both
    i, j = np.nonzero((both * 100 >= union * percent) & (cl[:, None] != cr[None, :]))
    if not len(i):
        return []
    _, first = np.unique(np.stack([cl[i], cr[j]], 1), axis=0, return_index=True)
    up, out = {}, []

    def top(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = c = up.get(up[c], up[c])
        return c

    for k in first.tolist():
        a, b = top(int(cl[i[k]])), top(int(cr[j[k]]))
        if a != b:
            up[a] = b
            out.append((int(i[k]), int(j[k])))
    return out


def met_exactly(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components within groups (node, key, n, comp), by comparing full sets.

    Members fall into blocks by a hash; those of a group's commonest component have blocks of their own, which
    don't meet each other.  Each two blocks are a tile, so a group of any size is dealt out.
    """
    counts = groups.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mass"))
    nodes = counts.groupBy("node").agg(F.max(F.struct("m", "comp", "mass")).alias("most"), F.sum("m").alias("size"), F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("comps"))
    blocks = lambda m, mass: F.greatest(F.ceil(m / TILE), F.ceil(mass / MASS), F.lit(1)).cast("int")
    nodes = nodes.where("comps > 1").select(
        "node", F.col("most.comp").alias("most"), blocks(F.col("size") - F.col("most.m"), F.col("mass") - F.col("most.mass")).alias("others"), blocks(F.col("most.m"), F.col("most.mass")).alias("same")
    )
    deal = F.xxhash64("key", "node")
    rows = groups.join(nodes, "node")
    block = F.when(F.col("comp") == F.col("most"), F.col("others") + F.pmod(deal, F.col("same"))).otherwise(F.pmod(deal, F.col("others"))).cast("int")
    rows = rows.withColumn("block", block)
    ends = F.when(F.col("block") < F.col("others"), F.col("others") + F.col("same")).otherwise(F.col("others")) - 1
    rows = rows.select("node", "key", "comp", "block", F.explode(F.sequence(F.lit(0), ends)).alias("other"))
    rows = rows.select("node", "key", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        block, key, comp = (t[c].to_numpy() for c in ("block", "key", "comp"))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        l, r = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = []
        if len(l) and len(r) and (comp != comp[0]).any():
            own = t["own"].combine_chunks()
            flat, at = own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            of = lambda rows: [flat[at[x] : at[x + 1]] for x in rows]
            links = tile_links(of(l), of(r), comp[l], comp[r], percent)
        a, b = key[l[[x for x, _ in links]]], key[r[[y for _, y in links]]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return rows.join(sets, "key").groupBy("node", "i", "j").applyInArrow(compare, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, own``: the full sets of the classes wanted (a written table: key, doc_id of a member)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = [(key, shingles(t)) for key, t in zip(some.column("key").to_pylist(), some.column("text").to_pylist())]
            sets = [(key, own) for key, own in sets if key_of(own) == key]  # an id may stand for several texts
            columns = [pa.array([key for key, _ in sets], pa.int64()), pa.array([own.view(np.int64) for _, own in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "own"])

    few = wanted.count() <= FETCH
    met = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id").select("key", "text")
    return met.mapInArrow(full, "key long, own array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("key").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * percent).select("a", "b")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _across(these: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    ca = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    cb = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    joined = these.join(ca, "a", "left").join(cb, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def labelled(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """A row for each document: doc_id, mark, n, key, and first_id, first_key of the group's first document (by id, then key)."""
    sigs = scratch.keep(signed(docs), "signed")
    usable = sigs.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("key").agg(F.min(F.struct("doc_id", "n", "roots", "lanes")).alias("m"))
    classes = scratch.keep(classes.select("key", "m.*"), "classes")
    ids = classes.select("key", "doc_id")
    rows = roots(classes, scratch)
    # a few trees; the likeliest partner of each class, and the smallest of its likely ones, so that a large group soon hangs together
    pairs, early = explore(rows.where(F.col("tree") < FIRST).drop("tree"), SHALLOW, scratch, percent, False)
    ends = lambda these: these.select(F.col("a").alias("key")).unionByName(these.select(F.col("b").alias("key")))

    def fetched(keys: DataFrame) -> DataFrame:
        wanted = scratch.keep(ids.join(keys.distinct(), "key"), "wanted")
        out = scratch.keep(sets_of(docs, wanted), "sets")
        scratch.drop(wanted)
        return out

    sets = [fetched(ends(pairs))]
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = both.groupBy("a").agg(F.min(F.struct(-F.col("agree"), "b"))["b"].alias("b"), F.min(F.when(F.col("agree") >= LIKELY, F.col("b"))).alias("c"))
    best = best.select("a", F.explode(F.array_compact(F.array("b", "c"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = [scratch.keep(confirmed(best.distinct(), sets[0], percent), "links")]
    comp = components(links[0], scratch)
    # what is left of these trees' candidates, and all other trees, for pairs across components; groups of dense nodes of all trees exactly
    known = comp.select(F.col("node").alias("key"), "comp")
    named = lambda these: these.join(known, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    more, late = explore(named(rows.where(F.col("tree") >= FIRST).drop("tree")), DEEP, scratch, percent, True)
    scratch.drop(rows)
    left = scratch.keep(_across(pairs.select("a", "b"), comp).unionByName(more.select("a", "b")).distinct(), "left")
    scratch.drop(pairs, more)
    large, wanted = [*early, *late], ends(left)
    if large:
        plain = grouped(_all(large), scratch)
        groups = scratch.keep(named(plain), "groups")
        scratch.drop(plain, *large)
        several = groups.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node")
        wanted = wanted.unionByName(groups.join(several, "node", "left_semi").select("key"))
    sets.append(fetched(wanted.join(sets[0].select("key"), "key", "left_anti")))
    links.append(scratch.keep(confirmed(left, _all(sets), percent), "links"))
    scratch.drop(comp, left)
    if large:
        links.append(scratch.keep(met_exactly(groups, _all(sets), percent), "links"))
        scratch.drop(groups)
    scratch.drop(*sets)
    comp = components(_all(links), scratch)
    named = ids.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    first = named.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    named = named.join(first, "comp").select(F.col("key").alias("ckey"), F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
    out = sigs.join(named, (F.col("key") == F.col("ckey")) & F.col("doc_id").isNotNull(), "left")
    out = scratch.keep(out.select("doc_id", "mark", "n", "key", "first_id", "first_key"), "result")
    scratch.drop(sigs, classes, comp, *links)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    out = labelled(docs, percent, Scratch(docs.sparkSession, "minhash"))
    component = F.coalesce("first_id", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, and of the smallest key where an id stands for several texts.

    Rows are told apart by id and text; of several rows with the same id and
    words one stays, too.  Rows without an id or without words all stay.
    """
    out = labelled(docs, percent, Scratch(docs.sparkSession, "minhash"))
    mark = "_".join(["mark", *sorted(docs.columns)])[:64]
    with_words = out.where("first_id is not null")
    gone = with_words.where("doc_id <> first_id or key <> first_key").select("doc_id", F.col("mark").alias(mark)).distinct()
    again = with_words.where("doc_id = first_id and key = first_key").groupBy("doc_id", F.col("mark").alias(mark)).agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    rest = marked.join(gone, ["doc_id", mark], "left_anti")
    if again.isEmpty():
        return rest.select(*docs.columns)
    order = Window.partitionBy("doc_id", mark).orderBy(F.lit(0))
    once = rest.join(again, ["doc_id", mark], "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return rest.join(again, ["doc_id", mark], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


SUMMARY_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) AS i FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_n >= {PERCENT} * (x.n + y.n - both_n)
),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = least.a LEFT JOIN sizes USING (doc_id)
"""
