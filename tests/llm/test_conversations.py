"""Conversation repair: against exhaustive search, against SQL on odd tables, in segments of any length."""

import hashlib
import itertools
import random

import duckdb
import pytest

from lautwerk.llm import conversations as c

TALK = "conv_id long, turn long, role string, text string, place string, code string, seg string"


def exhaustive(sign):
    """(cost, audit) least of all edits, at most two rows inserted at each place."""
    best = None

    def legal(roles):
        body = roles[1:] if roles[:1] == "s" else roles
        return not roles or (len(body) > 0 and body == "ua" * (len(body) // 2))

    options = []
    for code in sign:
        own = [("D", "", 3)]
        if code != "-":
            t = code.isupper()
            own += [("K", code.lower(), t)] * (code.lower() in "sua") + [("R", "u", 2 + t), ("R", "a", 2 + t)]
        options.append(own)
    gaps = ["", "u", "a", "ua", "au"]
    for rows in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(sign) + 1):
            roles = "".join(g + r[1] for g, r in zip(ins, rows)) + ins[-1]
            if legal(roles):
                found = (sum(r[2] for r in rows) + 2 * sum(map(len, ins)), "".join("I" * len(g) + r[0] for g, r in zip(ins, rows)) + "I" * len(ins[-1]))
                best = min(best, found) if best else found
    return best


def audit_of(edits):
    return "".join(x for seg in edits for own in seg for x in own if x.isupper())


def test_least_repairs_of_all_short_signatures():
    for n in range(4):
        for sign in map("".join, itertools.product("suaxUA-", repeat=n)):
            edits, cost = c.solve([sign])
            assert (cost, audit_of(edits)) == exhaustive(sign), sign


@pytest.mark.parametrize("length", [1, 2, 5, 7])
def test_segments_change_nothing(length):
    rng = random.Random(2)
    for _ in range(300):
        sign = "".join(rng.choice("ssuuuaaaxXSUA-") for _ in range(rng.randint(1, 40)))
        whole, cost = c.solve([sign])
        parts, same = c.solve([sign[k : k + length] for k in range(0, len(sign), length)])
        assert same == cost and audit_of(parts) == audit_of(whole), sign


def odd_rows():
    rng, rows = random.Random(8), []
    texts = ["Yes.", "No", "why?", "Well!  \n", " \t ", "", None, "a b.", "ä.", "x" * 30_000 + ".", "e.t.c", "\xa0"]
    for i in [None, *range(-2, 150)]:
        for t in range(rng.randint(1, 9)):
            turn = rng.choice([t, t, t, t + 3, None, 0])
            rows.append((i, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]), rng.choice(texts), "x", "x", "x"))
    return rows + rows[:20]


def same_as_sql(spark, rows):
    df = spark.createDataFrame(rows, TALK)
    con = duckdb.connect()
    conversations = df.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841 (read by SQL)
    con.register("conversations", conversations)
    want = con.sql(c.summary_sql())
    names = want.columns
    got = [tuple(r) for r in c.summary(df).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
    return got


def test_odd_conversations_against_sql(spark):
    got = same_as_sql(spark, odd_rows())
    assert len(got) == 153


def test_long_conversations_in_segments(spark, monkeypatch):
    monkeypatch.setattr(c, "SEGMENT", 5)
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", f"{t}!"]), "x", "x", "x") for i in (7, None) for t in range(120)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"{t}.", "x", "x", "x") for t in range(10)] + [(9, 0, "user", "hi.", "x", "x", "x")]
    same_as_sql(spark, rows)


def test_replayed_rows_are_the_repaired_conversation(spark):
    df = spark.createDataFrame([(1, k, r, t, "x", "x", "x") for k, (r, t) in enumerate([("assistant", "a."), ("user", "b."), ("user", "b."), ("tool", "c")])], TALK)
    scratch = c.Scratch(spark, "test")
    coded = scratch.keep(c.codes(df))
    edits, audits = c.repaired(coded, scratch)
    row = audits.first()
    got = [(r.edit, r.role, r.text) for r in c.replayed(coded, edits).orderBy("place", "step").collect()]
    assert (row.cost, row.audit) == exhaustive("au-X") == (8, "IKKDR")
    assert got == [("I", "user", ""), ("K", "assistant", "a."), ("K", "user", "b."), ("R", "assistant", "c")]


def test_all_dropped_and_none(spark):
    import zlib

    i = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = same_as_sql(spark, [(i, 0, "user", "x", "x", "x", "x")])
    assert got == [(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.summary(spark.createDataFrame([], TALK)).collect() == []
