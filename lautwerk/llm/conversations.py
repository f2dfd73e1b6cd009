"""Conversations whose structure is broken: audited and repaired by signature.

Each row of a conversation becomes one character: its role's initial, and
whether it is sound, cut off, or has to go.  A conversation's signature is the
string of them.  Signatures repeat far more often than conversations, so each
distinct one is solved once, by a memoised recursion over its rows and the
state of the dialogue; the audits are joined back and the edits replayed on
the texts.

Signatures are cut into segments of a bounded length.  A segment needs nothing
of the rest but what each state costs at its end, up to a constant, and there
are few such vectors; so long conversations go through a few rounds: costs of
distinct (segment, vector) from the end to the front, then the edits of
distinct (segment, vector, state) from the front to the end.  Nothing holds a
whole conversation but the running hash of its repaired text.

Defined cases: null ids are one conversation; null turns come first, and rows
of one turn are ordered by role, then text; null roles and texts are read as
one space, as in the key that damage is drawn by; a repeated row is a
duplicate of the first; a role counts by its first character, an empty one as
none; columns besides those named aren't looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.llm.common import Scratch

#: Rows of a segment.
SEGMENT = 256
# Prices of the edits; blanks; marks that end a text; states of the dialogue that may end it.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
BLANK, MARKS = r"[\x20\x09-\x0D]", "[.!?]"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What each state may be followed by: role's initial to state.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WHO = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
FAR = 10**6
END = (0, FAR, FAR, 0)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage drawn by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, marks removed, repeated, made the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)).cast("int")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), drawn.alias("drawn"))
    rows = rows.where("drawn <> 0").withColumns({
        "text": F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.regexp_replace("text", MARKS, "")).otherwise(F.col("text")),
        "role": F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")),
    })
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("drawn") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def codes(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` in their order: place (from 0), fault (blank, duplicate, truncated or null) and code.

    The code is the role's initial (x: neither s, u nor a), a capital where the text is cut off, ``-`` where the row has to go.
    """
    bare = F.regexp_replace("text", BLANK, "")
    blank = bare == ""
    cut_off = ~F.substring(bare, -1, 1).rlike(MARKS)
    own = Window.partitionBy("conv_id", "role", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "again")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(cut_off, "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    # one shuffle: both windows lie within what is dealt out by conversation
    dealt = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(17), "text")}).repartition("conv_id")
    return (
        dealt.withColumn("again", F.row_number().over(own) > 1)
        .withColumns({"fault": fault, "place": F.row_number().over(order).cast("long") - 1, "before": F.lag(F.struct(initial.alias("i"))).over(order)["i"]})
        .withColumns({"code": code, "clash": F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")})
        .select("conv_id", "place", "turn", "role", "text", "fault", "code", "clash")
    )


def moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of the row itself in this state, in the order of their letters: (letter, next state, price)."""
    out = [("D", state, DELETE)]
    if code == "-":
        return out
    price, to = CUT_OFF if code.isupper() else 0, NEXT[state]
    if code.lower() in to:
        out.append(("K", to[code.lower()], KEEP + price))
    return out + [("R", to[who], REROLE + price) for who in to if who != "s"]


def inserted(state: int) -> int:
    """The state after an inserted row of the role that comes next."""
    return next(to for who, to in NEXT[state].items() if who != "s")


@lru_cache(maxsize=1 << 10)
def costs(segment: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """What each state costs before each row of the segment and after the last, given the costs behind it.

    Two rows inserted in a row lead anywhere; more would come back to a state at a price.
    """

    def best(k: int, state: int, spare: int) -> int:
        if (k, state, spare) not in known:
            if k == len(segment):
                here = after[state]
            else:
                here = min(price + best(k + 1, to, 2) for _, to, price in moves(segment[k], state))
            if spare:
                here = min(here, INSERT + best(k, inserted(state), spare - 1))
            known[k, state, spare] = min(here, FAR)
        return known[k, state, spare]

    known: dict = {}
    for k in range(len(segment), -1, -1):  # from the end, so that the recursion stays flat
        for state in NEXT:
            best(k, state, 2)
    return tuple(tuple(known[k, state, 2] for state in NEXT) for k in range(len(segment) + 1))


def based(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """A vector of costs less its least, and the least."""
    low = min(vector)
    return tuple(c - low if c < FAR else FAR for c in vector), low


def replay(segment: str, after: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """The cheapest edits from a state, the ASCII-least of equal ones: the letters of each row and those behind the last; and the state at the end.

    A letter is followed by the role it gives: ``Ku``, ``Ra``, ``Iu``, ``D``.
    Inserts between segments come before the first row of the later one.
    """
    table, out = costs(segment, after), []
    for k in range(len(segment) + 1):
        own, letter = "", "I"
        while letter == "I" and (k < len(segment) or after[state] > table[k][state]):
            choice = [(x, to, price + table[k + 1][to]) for x, to, price in moves(segment[k], state)] if k < len(segment) else []
            choice.append(("I", inserted(state), INSERT + table[k][inserted(state)]))
            letter, state, _ = min(c for c in choice if c[2] == table[k][state])
            own += letter + (WHO[state] if letter != "D" else "")
        out.append(own)
    return out, state


def solve(segments: list[str]) -> tuple[list[list[str]], int]:
    """Edits of each segment of one conversation, and their cost."""
    ends, after, total = [], END, 0
    for s in reversed(segments):
        ends.append(after)
        after, low = based(costs(s, after)[0])
        total += low
    ends.reverse()
    # what the first segment costs from the start, beyond the least
    total += after[START]
    out, state = [], START
    for s, a in zip(segments, ends):
        edits, state = replay(s, a, state)
        out.append(edits)
    return out, total


def repaired(coded: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(segments with their edits: ``conv_id, seg, edits``; conversations: ``conv_id, cost, audit``) of coded rows.

    A conversation of one segment is solved with its signature; longer ones segment by segment.
    """
    seg = F.floor(F.col("place") / SEGMENT).cast("long").alias("seg")
    signs = coded.select("conv_id", "place", "code", seg).groupBy("conv_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "").alias("sign"))
    signs = scratch.keep(signs, "signs")
    # only first segments need to be told whether there are others
    more = signs.where("seg = 1").select(F.col("conv_id").alias("own"))
    same = F.equal_null("conv_id", "own")
    first, later = signs.where("seg = 0"), signs.where("seg > 0")
    single = first.join(more, same, "left_anti")
    several = later.unionByName(first.join(more, same, "left_semi"))
    kind = "sign string, edits array<string>, cost long"

    def one(batches):
        for batch in batches:
            done = [solve([s]) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0][0] for d in done], pa.list_(pa.string())), pa.array([d[1] for d in done], pa.int64())], ["sign", "edits", "cost"])

    solved = single.select("sign").distinct().mapInArrow(one, kind)
    short = single.join(solved, "sign").select("conv_id", "seg", "edits", "cost")

    def many(batches):
        # rows of a conversation lie together, by segment: only its segments are held, never its texts
        held, key = [], None

        def done():
            edits, cost = solve(held)
            for k in range(0, len(edits), 1024):
                part = edits[k : k + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.array(range(k, k + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string())), pa.array([cost] * len(part), pa.int64())], ["conv_id", "seg", "edits", "cost"])

        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and i != key:
                    yield from done()
                    held = []
                key = i
                held.append(s)
        if held:
            yield from done()

    long = several.repartition("conv_id").sortWithinPartitions("conv_id", "seg").select("conv_id", "sign")
    edits = scratch.keep(short.unionByName(long.mapInArrow(many, "conv_id long, seg long, edits array<string>, cost long")), "edits")
    # a segment's audit, then the conversation's
    letters = F.regexp_replace(F.array_join("edits", ""), "[sua]", "")
    audits = edits.select("conv_id", "seg", letters.alias("part"), "cost").groupBy("conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part"))), lambda x: x["part"]), "").alias("audit"))
    return edits.select("conv_id", "seg", "edits"), audits


ROLE = {"u": "user", "a": "assistant"}


def replayed(coded: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of the repaired conversations, in order: ``conv_id, place, step, edit, role, text``.

    Rows and the edits of their segments are dealt out and sorted together, so
    a task holds the edits of one segment and one row at a time.
    """
    rows = coded.select("conv_id", F.floor(F.col("place") / SEGMENT).cast("long").alias("seg"), "place", "role", "text", F.lit(None).cast("array<string>").alias("edits"))
    heads = edits.select("conv_id", "seg", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits")
    dealt = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "place")
    names = ("conv_id", "place", "step", "edit", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def kernel(batches):
        own: list = []

        def steps(i, place, letters, role, text):
            for n, k in enumerate(_split(letters)):
                if k[0] == "I":
                    yield (i, place, n, "I", ROLE[k[1]], "")
                elif k[0] != "D":
                    yield (i, place, n, k[0], role if k[0] == "K" else ROLE[k[1]], text)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(k, 256).to_pylist():
                    if r["edits"] is not None:
                        own = r["edits"]
                        start = r["seg"] * SEGMENT
                        continue
                    at = r["place"] - start
                    out += steps(r["conv_id"], r["place"], own[at], r["role"], r["text"])
                    if at + 2 == len(own):
                        out += steps(r["conv_id"], r["place"] + 1, own[at + 1], None, None)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)

    return dealt.mapInArrow(kernel, "conv_id long, place long, step int, edit string, role string, text string")


def _split(letters: str) -> list[str]:
    """``KuIaD`` as Ku, Ia, D."""
    out = []
    for c in letters:
        if c.isupper():
            out.append(c)
        else:
            out[-1] += c
    return out


def hashed(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of replayed rows as they come: a running hash of ``role:text``, joined by newlines."""

    def kernel(batches):
        key, sha, some = None, None, False
        for batch in batches:
            ids, digests = [], []
            for i, role, text in zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2))):
                if some and i != key:
                    ids.append(key)
                    digests.append(sha.hexdigest())
                    some = False
                if not some:
                    key, sha, some = i, hashlib.sha256(), True
                    sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                else:
                    sha.update(f"\n{role}:{text}".encode("utf-8", "surrogatepass"))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests)], ["conv_id", "repaired_sha256"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    # rows of a conversation come from one task, in order
    return rows.select("conv_id", "role", "text").mapInArrow(kernel, "conv_id long, repaired_sha256 string")


def summary(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table: its faults after damage, the cheapest repair, and the hash of what it gives."""
    spark = conversations.sparkSession
    with Scratch(spark, "conversations") as kept:
        scratch = Scratch(spark, "steps")
    coded = scratch.keep(codes(damaged(conversations)), "coded")
    edits, audits = repaired(coded, scratch)
    shas = hashed(replayed(coded, edits))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    number = lambda c: F.count_if(c).cast("long")
    faults = coded.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], number(F.col("clash")).alias("illegal")
    )
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (faults, audits, shas):
        part = part.withColumnRenamed("conv_id", "own")
        ids = ids.join(part, F.equal_null("conv_id", "own"), "left").drop("own")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    out = kept.keep(out, "result")
    scratch.clear()
    return out


def summary_sql() -> str:
    """The same in SQL: a value is its cost in six digits, then the audit, so the least string is the cheapest and then the ASCII-least."""

    def then(value: str, price: str, letter: str) -> str:
        return f"lpad(CAST(CAST({value}[1:6] AS INT) + {price} AS VARCHAR), 6, '0') || '{letter}' || {value}[7:]"

    def closed(m: list[str]) -> str:
        once, twice = [2, 2, 3, 2], [3, 3, 2, 3]
        return ", ".join(f"list_min([{m[s]}, {then(m[once[s]], '2', 'I')}, {then(m[twice[s]], '4', 'II')}]) AS v{s}" for s in range(4))

    def moved(s: int) -> str:
        kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[s]
        keep = [f"CASE WHEN lower(c) = '{who}' THEN {then(f'v{to}', 't', 'K')} END" for who, to in kept]
        rerole = f"CASE WHEN c <> '-' THEN {then(f'v{kept[-1][1]}', '2 + t', 'R')} END"
        return f"list_min([{then(f'v{s}', '3', 'D')}, {', '.join(keep)}, {rerole}]) AS m{s}"

    return f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM conversations),
d AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS z FROM k, tab),
e AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role,
  CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE z WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM e),
g AS (SELECT *, row_number() OVER o AS i, lag(role[1:1]) OVER o AS before,
  CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'truncated' END AS fault FROM f
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
h AS (SELECT *, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'x' END AS letter FROM g),
r AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(letter) ELSE letter END AS code FROM h),
s AS (SELECT conv_id, string_agg(code, '' ORDER BY i) AS sign, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v AS (
  SELECT DISTINCT sign, length(sign) AS k, '000000' AS v0, '000004II' AS v1, '000002I' AS v2, '000000' AS v3 FROM s
  UNION ALL
  SELECT sign, k - 1, {closed([f"m{n}" for n in range(4)])}
  FROM (SELECT sign, k, {", ".join(moved(n) for n in range(4))}
    FROM (SELECT v.*, sign[k:k] AS c, CASE WHEN regexp_matches(sign[k:k], '[A-Z]') THEN 1 ELSE 0 END AS t FROM v WHERE k > 0))),
a AS (SELECT sign, CAST(v0[1:6] AS BIGINT) AS cost, v0[7:] AS audit FROM v WHERE k = 0),
p AS (SELECT sign, audit, unnest(range(1, length(audit) + 1)) AS p FROM a),
q AS (SELECT sign, p, audit[p:p] AS edit, length(regexp_replace(audit[1:p], 'I', '', 'g')) AS i, length(regexp_replace(audit[1:p], 'D', '', 'g')) AS n FROM p),
w AS (SELECT *, max(CASE WHEN n = 1 AND edit = 'K' AND lower(sign[i:i]) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY sign) AS led FROM q),
x AS (SELECT s.conv_id, p, edit, CASE WHEN edit = 'K' THEN role WHEN (n - led) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text
  FROM s JOIN w USING (sign) LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = w.i WHERE edit <> 'D'),
y AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY p)) AS sha FROM x GROUP BY conv_id)
SELECT c.conv_id, {", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN a ON s.sign = a.sign LEFT JOIN y ON c.conv_id IS NOT DISTINCT FROM y.conv_id
"""
