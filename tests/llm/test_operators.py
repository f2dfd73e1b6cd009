"""Operators of the subpackage: brute force, round trips, held-out accuracy, and the defined odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lautwerk.llm import bpe, common, fingerprint, licenses, linededup, minhash, neardup_embed, packing, pii, quality, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=()):
    """(id, text, source) rows; extra: names of further columns that clash with names used inside."""
    schema = DOC + "".join(f", `{c}` string" for c in extra)
    full = [(i, t, "en", s, len(t or ""), *["x"] * len(extra)) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


ODD = [(0, None, "a"), (1, "", "a"), (None, "some words without an id here", "a"), (2, "one two three", None), (2, "one two three", None), (3, "z" * 50_000, "b"), (4, "a b " * 9_000, "b"), (5, "\n\n \n", "b")]
CLASH = ("key", "n", "node", "host", "line", "h", "k", "l", "comp", "score", "y", "block", "head", "ids")


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def codec(leaf=6, window=2):
    P = pytest.importorskip("public_tokenizers")
    return bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf, window)


# --- base patterns and the random field


PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]
            if fits:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = [*"ab1.@+- ()23@..", "4111111111111111", "10.0.0.1", "a.b@c.de", "+1 (555) 123-4567", "300"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 30_000) == [] and pii.base_spans("a" * 60_000) == []


def test_field_labels_distant_repeats():
    text = "call +1 (555) 123-4567 now, or 555.123.4567; card 4111 1111 1111 1111, again 4111/1111/1111/1111; mail a.b@c.de or a.b (at) c (dot) de; order 998877665"
    base = pii.base_spans(text)
    added = {(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, base, pii.Field())}
    assert ("phone", "555.123.4567") in added and ("card", "4111/1111/1111/1111") in added and ("email", "a.b (at) c (dot) de") in added
    assert all("998877665" not in t for _, t in added)


def test_a_number_is_tied_to_all_that_end_in_it():
    keys = ["5551234567", "0015551234567", "495551234567", "a@b.c", "95551234567", "5551234567", "1234567"]
    numbers = [k for k in keys if k.isdigit()]
    want = {(keys.index(a), keys.index(b)) for a in numbers for b in numbers if a != b and b.endswith(a)}
    assert sorted(pii.skip_edges(keys)) == sorted(want | {(0, 5)})
    text = "call 5551234567 or 0015551234567, from abroad +495551234567"
    base = pii.base_spans(text)
    assert [(k, text[s:e]) for s, k, e in base] == [(3, "+495551234567")]
    assert ("phone", "5551234567") in {(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, base, pii.Field())}


def test_addresses_that_are_spelt_out_are_looked_at(spark):
    rows = [(1, "write to jo.doe (at) example (dot) org, or to jo.doe(at)example(dot)org", "s"), (2, "we met at home. then we left", "s")]
    assert pii._QUICK.search(rows[0][1]) and len(pii.other_mentions(rows[0][1], [])) == 2
    found = {r.doc_id: r.spans for r in pii.found(docs_of(spark, rows, CLASH), pii.Field()).collect()}
    assert found[2] == ""


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(1)
    unary = rng.normal(size=(3, pii.N_LABELS))
    field = pii.Field()
    edges, pair = [(0, 1), (1, 2)], [field.skip, field.chain]
    want = np.zeros_like(unary)
    for a in range(5):
        for b in range(5):
            for c in range(5):
                p = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + pair[0][a, b] + pair[1][b, c])
                want[0, a] += p
                want[1, b] += p
                want[2, c] += p
    assert np.allclose(pii.beliefs(unary, edges, pair, 60), want / want.sum(1, keepdims=True), atol=1e-3)


def test_pii_query_on_odd_rows(odd, none, docs):
    rows = {r.doc_id: r for r in pii.found(odd, pii.Field()).collect()}
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.found(none, pii.train(none)).count() == 0
    got = {r.doc_id: r for r in pii.found(docs, pii.train(docs)).collect()}
    for r in docs.collect():
        base = plain_spans(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(got[r.doc_id].spans.split(",")) or not base
        assert got[r.doc_id].n_email == sum(k == 0 for _, k, _ in base)
    masked = pii.redacted(odd, pii.Field())
    assert masked.columns == odd.columns and masked.count() == odd.count()


# --- embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(scale=0.09, size=8) * (i % 7 > 0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 11 else None))
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [1.0, None] + [0.0] * 6, 1), (504, [1.0], 1), (505, [], 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in neardup_embed.near_duplicates(table).collect()}
    good = [(i, np.array(v), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v, l in good:
        for j, w, m in good:
            if i != j and l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
    assert sum(map(len, links.values())) > 100
    for i in links:
        if i is None:
            continue
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(reach), min(reach) == i), i
    assert got[None].kept and got[None].component_id is None
    assert neardup_embed.near_duplicates(table.limit(0)).count() == 0


def test_tiles_are_compared_like_one_matrix(monkeypatch, spark):
    monkeypatch.setattr(neardup_embed, "TILE", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 0.1 + [1, 0, 0]).tolist(), 0) for i in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in neardup_embed.near_duplicates(table).collect()}
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert [got[i] for i in range(150)] == want.tolist()


# --- fingerprints


def test_fingerprints_against_sets(docs):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    rows = docs.orderBy("doc_id").collect()
    cut = lambda t: set(re.split(r"\n|(?<=[.!?]) ", t))
    like = lambda a, b: len(a & b) / len(a | b)
    for k, r in enumerate(rows):
        after = rows[(k + 1) % len(rows)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_edited == pytest.approx(like(cut(r.text), cut(edited))) and g.near_next == pytest.approx(like(cut(r.text), cut(after)))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, got[r.doc_id].fingerprint) == got[r.doc_id].fingerprint


def cells_of(text):
    """Size, cells of a part and cells {place: [count, digest, check]} of a fingerprint, from its text alone."""
    head, cells = text.split(";")
    n, third = map(int, head.split(":")[:2])
    out = {}
    for x in filter(None, cells.split(",")):
        at, c, k, h = x.split(".")
        out[int(at, 16)] = [int(c), int(k, 16), int(h, 16)]
    return n, third, out


def peel(third, cells, places):
    """Digests {digest: sign} that a sketch gives, or None if it gets stuck."""
    out, cells = {}, {at: list(x) for at, x in cells.items()}
    while True:
        pure = [(at, x) for at, x in cells.items() if abs(x[0]) == 1 and x[1] in places and places[x[1]][3] == x[2]]
        if not pure:
            return None if any(any(x) for x in cells.values()) else out
        sign, k, h = pure[0][1]
        out[k] = sign
        for p in range(3):
            at = (places[k][p] & (third - 1)) + third * p
            x = cells.setdefault(at, [0, 0, 0])
            cells[at] = [x[0] - sign, x[1] ^ k, x[2] ^ h]


def folded(third, cells, to):
    out = {}
    for at, (c, k, h) in cells.items():
        part, inner = divmod(at, third)
        x = out.setdefault((inner & (to - 1)) + to * part, [0, 0, 0])
        x[0], x[1], x[2] = x[0] + c, x[1] ^ k, x[2] ^ h
    return out


def likeness_of(a, b, places):
    """From two returned fingerprints alone: both folded to the smaller one's cells and subtracted, unfolded and larger where that gets stuck."""
    (na, ta, ca), (nb, tb, cb) = cells_of(a), cells_of(b)
    to, tries = min(ta, tb), 0
    while True:
        sides = []
        for third, cells in ((ta, ca), (tb, cb)):
            if to <= third:
                sides.append(folded(third, cells, to))
                continue
            wider = {}
            for d in peel(third, cells, places):
                for p in range(3):
                    x = wider.setdefault((places[d][p] & (to - 1)) + to * p, [0, 0, 0])
                    x[0], x[1], x[2] = x[0] + 1, x[1] ^ d, x[2] ^ places[d][3]
            sides.append(wider)
        less = {at: [sides[0].get(at, [0, 0, 0])[0] - sides[1].get(at, [0, 0, 0])[0]] + [sides[0].get(at, [0, 0, 0])[i] ^ sides[1].get(at, [0, 0, 0])[i] for i in (1, 2)] for at in {**sides[0], **sides[1]}}
        found = peel(to, less, places)
        if found is not None:
            return (na + nb - len(found)) / (na + nb + len(found)), tries
        to, tries = to * 4, tries + 1


def test_likeness_comes_from_the_returned_fingerprints(docs, spark):
    got = fingerprint.fingerprints(docs).orderBy("doc_id").collect()
    own = docs.select(F.explode(fingerprint.digests(F.coalesce("text", F.lit("")))).alias("d"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[ids[(k + 1) % len(ids)]][: len(texts[i]) // 2] for k, i in enumerate(ids)]
    more = spark.createDataFrame([(t,) for t in edited], "text string").select(F.explode(fingerprint.digests(F.col("text"))).alias("d"))
    wide = F.lit(1 << 40)
    hashes = own.union(more).distinct().select("d", *[fingerprint.place(F.col("d"), p, wide).alias(f"p{p}") for p in range(3)], fingerprint.check(F.col("d")).alias("h"))
    u = lambda x: x & (2**64 - 1)
    places = {u(r.d): (r.p0, r.p1 - (1 << 40), r.p2 - (2 << 40), u(r.h)) for r in hashes.collect()}
    retried = 0
    for k, r in enumerate(got):
        near, tries = likeness_of(r.fingerprint, r.edited_fingerprint, places)
        assert near == pytest.approx(r.near_edited), r.doc_id
        near, more_tries = likeness_of(r.fingerprint, got[(k + 1) % len(got)].fingerprint, places)
        assert near == pytest.approx(r.near_next), r.doc_id
        retried += (tries > 0) + (more_tries > 0)
    assert retried > 0


def test_fingerprints_of_odd_rows(odd, none, spark):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.fingerprints(none).count() == 0
    alone = fingerprint.fingerprints(docs_of(spark, [(7, "a. b", "s")])).collect()[0]
    assert alone.near_next == 1.0


def test_order_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK", 1)
    ids = [-5000, -1, 0, 3, 511, 512, 9_000_000, 9_000_001, 2**40, -(2**62)]
    for some in (ids, ids[:1], [7, 7, 7]):
        df = docs_of(spark, [(i, str(i), "s") for i in some])
        got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, ["text"]).collect()}
        order = sorted(some)
        assert got == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}
    bare = docs_of(spark, [(None, f"t{i}", "s") for i in range(20)] + [(5, "x", "s")])
    rows = fingerprint.with_next(bare, ["text"]).collect()
    follow = {r.text: r.next_text for r in rows}
    seen, at = [], "x"
    for _ in rows:
        at = follow[at]
        seen.append(at)
    assert len(set(seen)) == 21 and at == "x"
    assert max(r.n for r in fingerprint_blocks(spark).collect()) < 8 * 4


def fingerprint_blocks(spark):
    sparse = spark.range(2000).select(F.xxhash64("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(0).cast("long").alias("digest"))
    return sparse.select(fingerprint.blocks(sparse).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))


def test_larger_sketches_after_failure(spark):
    a, b = list(range(0, 400)), list(range(200, 700))
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, a, a + [9999])], "row long, a array<long>, b array<long>")
    df = df.select("row", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    for third, least in ((8, 2), (512, 1)):
        out, tries = fingerprint.differences(df.withColumn("third", F.lit(third).cast("long")), ["row"], common.Scratch(spark, "d"))
        got = {r.row: r for r in out.collect()}
        assert {k: r.differ for k, r in got.items()} == {1: 500, 3: 1} and tries >= least
        assert got[1].third > 8 and got[3].third == third


def test_no_plan_has_all_passes(spark, monkeypatch):
    made, keep = [], common.Scratch.keep

    def kept(self, df, *how, **more):
        made.append(df._jdf.queryExecution().analyzed().toString().count("Aggregate ["))
        return keep(self, df, *how, **more)

    monkeypatch.setattr(common.Scratch, "keep", kept)
    df = spark.createDataFrame([(1, list(range(400)), list(range(200, 700)), 512)], "row long, a array<long>, b array<long>, third long")
    df = df.select("row", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"], "third")
    out, tries = fingerprint.differences(df, ["row"], common.Scratch(spark, "d"))
    assert [r.differ for r in out.collect()] == [500] and tries == 1
    assert 0 < max(made) < 10


def test_peeling_recovers_the_difference(spark):
    rows = [(1, 64, d, 1) for d in range(20)] + [(1, 64, d, -1) for d in range(15, 40)] + [(2, 4, d, 1) for d in range(200)]
    df = spark.createDataFrame(rows, "row long, third long, d long, sign long")
    keys = ["row", "third"]
    got = {r.row: r for r in fingerprint.peeled(fingerprint.sketched(df, keys), keys).collect()}
    assert (got[1].found, got[1].stuck) == (35, 0) and got[2].stuck == 12


# --- packing


def test_pieces_are_powers_of_two():
    for n in [1, 2, 3, 4095, 4096, 4097, 3 * 4096 + 77]:
        got = packing.pieces(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 4096 for x in got) and sorted(got, reverse=True) == got


def test_packing_round_trip(odd, none, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    path = P.path("word_bpe_49k.json")
    some = docs.where("doc_id >= 100").limit(40).unionByName(odd.select(*docs.columns))
    rows = packing.packed(some, path).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    by = {}
    for r in rows:
        assert r.length == len(r.tokens) and r.length & (r.length - 1) == 0 and r.bucket == r.length.bit_length() - 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
        by.setdefault(r.doc_id, []).append(r)
    for d in some.dropDuplicates(["doc_id"]).collect():
        own = sorted(by[d.doc_id], key=lambda r: (r.start, r.sequence_id))
        want = plain.encode(d.text or "", add_special_tokens=False).ids + [2]
        copies = len([r for r in own if r.start == 0])
        ids = [t for r in own for t in r.tokens] if copies == 1 else None
        assert own[0].doc_tokens == len(want) and (ids is None or ids == want)
    assert packing.packed(none, path).count() == 0


def test_pieces_leave_before_a_batch_is_read(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "PART", 3)
    texts = [None, "", "one two", "three", "four five six", "seven", "eight"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = list(packing.cut([batch], P.path("word_bpe_49k.json"), 2, 4096, True, 100))
    assert [sorted(set(b.column("doc_id").to_pylist())) for b in got] == [[0, 1, 2], [3, 4, 5], [6]]


def test_words_of_letters_are_encoded_many_at_once():
    P = pytest.importorskip("public_tokenizers")
    words = packing.Words(P.path("word_bpe_49k.json"))
    plain, sent = words.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sent.append(len(texts))
            return plain.encode_batch_fast(texts, **how)

    words.tokenizer = Counted()
    # U+0958 and U+FB1D normalise to a letter and a mark, which then joins the marks behind it
    texts = [" ".join(f"word{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(500)), "Straße, İstanbul! K ﬁn it's 12a", "\u0958> \ufb1d... \u0958"]
    got = [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(sent) < 20


# --- near-duplicates of documents


def brute_components(texts):
    sets = {i: frozenset(minhash.shingles(t).tolist()) for i, t in texts.items()}
    links = {i: {j for j in sets if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        out[i] = min(reach)
    return sets, out


def test_near_duplicates_against_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets, want = brute_components(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in texts} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(own), "s"))
    rows += [(200 + i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(80)]), "s") for i in range(40)]
    rows += [(300 + i, rows[0][1], "s") for i in range(50)]
    _, want = brute_components({i: t for i, t, _ in rows})
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == want


def test_links_in_a_dense_group(spark):
    rng = random.Random(8)
    fresh = iter(range(10**6))

    def edited(words, n):
        own = list(words)
        for k in rng.sample(range(len(own)), n):
            own[k] = f"x{next(fresh)}"
        return own

    base, rows = [f"w{k}" for k in range(404)], []
    for pair in range(800):
        own = edited(base, 3)
        rows += [(2 * pair + k, " ".join(edited(own, 6)), "s") for k in range(2)]
    sets = [minhash.shingles(t) for _, t, _ in rows]
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = np.zeros((len(sets), len(values)), np.float32)
    held[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), code] = 1
    both = held[:, times > 1] @ held[:, times > 1].T
    n = held.sum(1)
    links = both * 100 >= minhash.PERCENT * (n[:, None] + n[None] - both)
    assert 0.6 < np.mean(both / (n[:, None] + n[None] - both)) < 0.7
    want = np.arange(len(sets))
    for _ in range(len(sets)):
        least = np.where(links, want[None], len(sets)).min(1)
        if (least == want).all():
            break
        want = least
    assert 800 < len(set(want.tolist())) < 1500
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert sum(got[i] != c for i, c in enumerate(want.tolist())) == 0


def test_tiles_join_what_is_linked(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = np.random.default_rng(3)
    own = {k: np.unique(np.concatenate([np.arange(100), rng.integers(200, 230, 12) + 1000 * (k % 9)])) for k in range(90)}
    comp = {k: 0 if k < 40 else k for k in own}
    sets = spark.createDataFrame([(k, x.tolist()) for k, x in own.items()], "key long, own array<long>")
    last = spark.createDataFrame([(7, k, len(own[k]), c) for k, c in comp.items()] + [(8, 1, 100, 0), (8, 2, 100, 0)], "node long, key long, n int, comp long")
    links = minhash.met_exactly(last, sets, 85).collect()
    true = lambda a, b: 100 * len(np.intersect1d(own[a], own[b])) >= 85 * len(np.union1d(own[a], own[b]))
    assert all(true(r.a, r.b) and comp[r.a] != comp[r.b] for r in links)

    def parts(pairs):
        up = dict(comp)
        for a, b in pairs:
            x, y = up[a], up[b]
            up = {k: x if v == y else v for k, v in up.items()}
        return {frozenset(k for k in up if up[k] == v) for v in up.values()}

    assert parts([(r.a, r.b) for r in links]) == parts([(a, b) for a in own for b in own if a < b and true(a, b)])


def test_one_row_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near, other = text + " more", " ".join(f"v{k}" for k in range(30))
    rows = [(1, text, "s"), (1, text, "s"), (2, near, "s"), (3, near, "s"), (3, other, "s"), (None, text, "s"), (4, "", "s"), (4, "", "s"), (1, near, "s")]
    kept = sorted(((r.doc_id, r.text) for r in minhash.one_of_each(docs_of(spark, rows, CLASH)).collect()), key=str)
    groups = {near: 0, text: 0}
    for i, t in kept:
        if i is not None and t in groups:
            groups[t] += 1
    assert sum(groups.values()) == 1 and (3, other) in kept and (None, text) in kept and kept.count((4, "")) == 2 and len(kept) == 5


def test_recall_in_groups_near_the_threshold(spark, monkeypatch):
    # pairs at 0.75 to 0.80 among nodes that stay large without being dense: only the trees can find them
    monkeypatch.setattr(minhash, "DENSE", 2.0)
    monkeypatch.setattr(minhash, "SMALL", 6)
    rng = random.Random(5)
    rows, n, pairs = [], 0, 0
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(250)]
        for _ in range(60):
            own = list(base)
            for k in rng.sample(range(250), 25):
                own[k] = f"x{(n := n + 1)}"
            two = []
            for _ in range(2):
                twin = list(own)
                for k in rng.sample(range(250), 3):
                    twin[k] = f"x{(n := n + 1)}"
                two.append(" ".join(twin))
            rows += [(2 * pairs, two[0], "s"), (2 * pairs + 1, two[1], "s")]
            pairs += 1
    sets, want = brute_components({i: t for i, t, _ in rows})
    linked = [i for i in range(pairs) if want[2 * i] == want[2 * i + 1]]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] for i in linked)
    alike = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in linked]
    assert len(linked) > 200 and sum(x < 0.85 for x in alike) > 100 and found >= 0.99 * len(linked), (found, len(linked))


def test_children_of_nodes_are_made_once(spark, monkeypatch):
    # a family at similarity 0.3 to 0.5, whose nodes branch at every step: its children are in proportion to its members
    monkeypatch.setattr(minhash, "DENSE", 2.0)
    monkeypatch.setattr(minhash, "SMALL", 4)
    with_size, seen = minhash.with_size, []

    def watched(rows, apart):
        seen.append((rows.count(), "Generate" in rows._jdf.queryExecution().optimizedPlan().toString()))
        return with_size(rows, apart)

    monkeypatch.setattr(minhash, "with_size", watched)
    made = []
    for members in (60, 120):
        texts = [" ".join([f"w{k}" for k in range(150)] + [f"x{i}_{k}" for k in range(80)]) for i in range(members)]
        seen.clear()
        scratch = minhash.Scratch(spark, "once")
        classes = minhash.signed(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).drop("mark")
        rows = minhash.roots(scratch.keep(classes, "classes"), scratch)
        minhash.explore(rows.where("tree < 4").drop("tree"), 2, scratch, minhash.PERCENT, False)
        assert len(seen) == 3 and not any(again for _, again in seen[1:])
        assert all(n <= 2 * before for (before, _), (n, _) in zip(seen, seen[1:]))
        made.append(sum(n for n, _ in seen[1:]))
        scratch.clear()
    assert made[1] < 3 * made[0], made


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == 0 and by[0].component_id == 0 and by[0].kept and by[2].component_id == 2 and by[None].kept and by[None].component_id is None
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert minhash.near_duplicates(none).count() == 0


def test_short_texts_are_one_shingle():
    assert len(minhash.shingles("A b")) == 1 and (minhash.shingles("A b") == minhash.shingles("a\tB")).all()
    assert len(minhash.shingles("É x")) == 1 and (minhash.shingles("É x") != minhash.shingles("é x")).all()
    assert len(minhash.shingles(" \n")) == 0


# --- classifiers


def test_toxic_words_and_unseen_endings():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ne", "ru", "ta"]) for _ in range(rng.randint(1, 4)))
    texts, y = [], []
    for i in range(600):
        own = [word() for _ in range(40)]
        if i % 4 == 0:
            own[rng.randrange(40)] = "grumf" + rng.choice(["ig", "et", "on", "al"])
        texts.append(" ".join(own))
        y.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(y))
    s = model.score(["balo grumfisch mine", "balo mine " * 2000, "", None, "ta " * 300 + "Grumfet."])
    assert s[0] > 0.5 and s[1] < 0.5 and s[2] < 0.5 and s[3] < 0.5 and s[4] > 0.5
    assert toxicity.fit(["a"], np.array([0])) is None


def test_block_scoring_equals_single_texts(monkeypatch):
    table = np.random.default_rng(0).normal(size=toxicity.BUCKETS)
    model = toxicity.Subwords(table, 0.0, 1.0)
    texts = ["one two", "", None, "three.four five", " x ", "\n", "last"]
    whole = model.values(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 1)
    assert np.array_equal(whole, model.values(texts)) and np.isneginf(whole[1]) and np.isneginf(whole[2])
    assert np.array_equal(whole, np.concatenate([model.values([t]) for t in texts]))


def test_toxicity_of_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    known = l.where("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    some = d.join(F.broadcast(known.select("doc_id")), "doc_id").select(*d.columns)
    rows = toxicity.scored(some, l).join(known, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 50 and np.mean([r.predicted for r in toxic]) > 0.7 and np.mean([r.predicted for r in clean]) < 0.05


def test_quality_ranks_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.scored(d, l).join(l.where("quality is not null"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert right > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_classifiers_on_odd_rows(odd, none, labels, spark):
    for scored in (quality.scored(odd, labels), toxicity.scored(odd, labels)):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    no_labels = labels.limit(0)
    assert quality.keep_good(odd, no_labels).count() == len(ODD) and toxicity.scored(none, labels).count() == 0
    assert quality.scored(none, no_labels).count() == 0


def test_fold_is_crc32_of_the_id(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), common.fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


# --- licences


def test_licence_sentences_and_rules(spark):
    texts = [
        "Some words. Released under the MIT License.\nMore.",
        "Licensed under the Apache License, Version 2.0.",
        "Permission is hereby granted, free of charge, to nobody.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: \n1. nothing",
        None,
        "",
    ]
    rows = licenses.scanned(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == [["MIT"], ["Apache-2.0"], [], [], [], []]
    assert rows[3].sentence_ids == [] or rows[3].sentence_ids == ["bsd-grant"]


def test_wrapped_licences(spark):
    import textwrap

    mit = [
        "The MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ]
    bsd = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]
    apache = [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ]
    gpl = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]
    want = {
        "MIT": (mit, ["mit-title", "mit-grant", "mit-notice"]), "BSD-3-Clause": (bsd, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
        "Apache-2.0": (apache, ["apache-2-long", "apache-comply", "apache-copy", "apache-unless"]), "GPL-2.0-or-later": (gpl, ["gpl-2-free"]),
    }
    texts, answers = [], []
    for name, (parts, ids) in want.items():
        for mark in ("", "# ", " * ", "// ", "REM "):
            lines = "\n\n".join(textwrap.fill(x, 72) for x in parts).split("\n")
            texts.append("x = 1\n\n" + "\r\n".join((mark + x).rstrip() for x in lines) + "\n\ny = 2")
            answers.append((ids, [name]))
    parted = "Released under\n\nthe MIT License"
    texts += [parted, "Released under the MIT\nLicense", "not Released under the MIT\nLicense", "." + "- " * 500 + "\nthe MIT license\nmore", "\n" * 50_000 + "copyright"]
    answers += [(["mit-title"], []), (["mit-released"], ["MIT"]), ([], []), (["mit-title"], []), ([], [])]
    rows = licenses.scanned(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [(r.sentence_ids, r.licences) for r in rows] == answers


def test_licences_of_odd_rows(odd, none):
    assert licenses.summary(odd).count() == len(ODD) and licenses.summary(none).count() == 0


# --- byte-level BPE


def test_tree_equals_the_library():
    small = codec()
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", "  ", "\n", "'s", "'re", "1", "23", "!", "###", "the", " of", "x" * 9, "字", "　", "\t", "' s", "\x1c", "\x85", "👍", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = small.encode(text)
        assert ids == small.encode_leaf(text), text
        assert small.decode(ids) == text.encode()
    long = "x" * 3000 + " " + "ab1" * 900
    assert small.encode(long) == small.encode_leaf(long)


def test_bpe_digests_of_odd_rows(odd, none, docs):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.digests(odd, path, P.PATTERN).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[0].n_tokens == 0 and by[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(none, path, P.PATTERN).count() == 0
    again = bpe.decode(bpe.encode(docs.limit(20), path, P.PATTERN), path, P.PATTERN)
    assert again.where("cast(decoded as string) <> text").count() == 0


# --- lines


def test_lines_by_site(spark):
    rows = [(i, f"menu\nown {i}\n\nown {i}", "a") for i in range(10)] + [(10 + i, f"menu {i}\nshared" if i < 2 else f"other {i}", "b") for i in range(10)]
    out = {r.doc_id: r for r in linededup.deduplicated(docs_of(spark, rows, CLASH), "source", ratio=0.5, dropped="gone").collect()}
    assert out[3].text == "own 3\n\nown 3" and out[3].gone == 1 and out[10].text == "menu 0\nshared" and out[10].gone == 0


def test_lines_of_odd_rows(odd, none):
    out = linededup.deduplicated(odd, "source")
    assert out.columns == odd.columns and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert linededup.deduplicated(none, "source").count() == 0


# --- shared


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100, 200 + i) for i in range(50)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in common.components(df, common.Scratch(spark, "t")).collect()}
    assert got[9] == got[1] == 1 and got[21] == 20 and got[249] == got[100] == 100 and got[1060] == 1000 and 30 not in got
    assert common.components(df.limit(0), common.Scratch(spark, "t")).count() == 0
