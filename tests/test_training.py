"""Training: lattices against the plain aligner, distributed rounds against a plain loop, chunks, rules, tones and divisions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lautwerk.functions.features import distance, features
from lautwerk.operators import alignment, classes, contexts, crossdim, lattice, outliers, pairwise, resampling, splits, tables
from lautwerk.operators.resampling import dealt
from lautwerk.plans import render
from lautwerk.plans.train import Cancelled, Model, Options, margin_at, null_models, null_runs, train, train_sets
from lautwerk.sources import corpus


def mutated(n, seed=1, letters="ptkbdmnaiuelrs"):
    rng, out = random.Random(seed), []
    for _ in range(n):
        s = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        t = list(s)
        for _ in range(rng.randint(0, 3)):
            k, op = rng.randrange(len(t)), rng.random()
            if op < 0.3 and len(t) > 1:
                t.pop(k)
            elif op < 0.6:
                t.insert(k, rng.choice(letters))
            elif op < 0.8 and len(t) > k + 1:
                t[k], t[k + 1] = t[k + 1], t[k]
            else:
                t[k] = rng.choice(letters)
        out.append((s, t))
    return out


def model_of(pairs, chunks=()):
    alpha, log_z = pairwise.prior(sorted({x for s, t in pairs for x in (*s, *t)}))
    counts = {}
    for s, t in pairs:
        for a, b in zip(s, t):
            counts[a, b] = counts.get((a, b), 0.0) + 1
    return pairwise.Pairwise(counts, alpha, log_z, {}, dict(chunks))


def rows_of(links):
    out = {}
    for k, *x in links.tolist():
        out.setdefault(k, []).append(tuple(x))
    return out


@pytest.mark.parametrize("max_chunk", [1, 3])
def test_lattices_equal_the_plain_aligner(max_chunk):
    pairs = mutated(400)
    m = model_of(pairs, [((("t", "a"), ("t", "r", "a")), -2.0), ((("k",), ("k", "s")), -1.5), ((("a", "b"), ("a",)), -1.0)])
    costs = alignment.Costs(one=m.one, chunks=m.chunks, tier=pairwise.chunk_tier, max_chunk=max_chunk)
    links, cost = lattice.align_many([s for s, _ in pairs], [t for _, t in pairs], m.coded(max_chunk))
    got = rows_of(links)
    for k, (s, t) in enumerate(pairs):
        want, c = alignment.align(s, t, costs)
        assert got[k] == want and abs(cost[k] - c) < 1e-9


def test_costs_by_place_are_followed_in_spans_too():
    """Brute force over all monotone links of small words whose pairs cost by place."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, m = rng.integers(1, 4, 2)
        s, t = rng.integers(0, 3, (1, n)), rng.integers(0, 3, (1, m))
        c = lattice.Coded(list("ptk"), np.zeros((3, 3)), max_chunk=1, reorder=False)
        ones, extra = rng.normal(size=(1, n, m)), rng.normal(size=(1, n, m))
        _, cost = lattice.fill(c, s, t, (ones, ones + extra))

        def best(i, j):
            if i == n and j == m:
                return 0.0
            ways = [best(i + 1, j) + 0.5] if i < n else []
            ways += [best(i, j + 1) + 0.5] if j < m else []
            ways += [best(i + 1, j + 1) + ones[0, i, j] + extra[0, i, j]] if i < n and j < m else []
            return min(ways)

        assert abs(cost[0] - best(0, 0)) < 1e-9
    c = lattice.Coded(list("ptk"), np.zeros((3, 3)))
    ones = np.array([[[9.0, -1.0], [-3.0, 9.0]]])
    _, cost = lattice.fill(c, np.array([[0, 1]]), np.array([[1, 0]]), (ones, ones + 50))
    assert cost[0] == -4.0  # p t ~ t p: each symbol with its own, at its own place


def test_pairs_of_about_one_shape_are_filled_together(monkeypatch):
    pairs = mutated(300, 7)
    m = model_of(pairs, [((("t", "a"), ("t", "r", "a")), -2.0), ((("k",), ("k", "s")), -1.5)])
    c = m.coded()
    sources, targets = [s for s, _ in pairs], [t for _, t in pairs]
    place = np.random.default_rng(3).normal(0, 0.2, (len(pairs), 16, 16))
    overlay = lambda at, x, y, ones: (ones + place[at][:, : x.shape[1], : y.shape[1]], ones + 2 * place[at][:, : x.shape[1], : y.shape[1]])
    fills, fill = [], lattice.fill
    monkeypatch.setattr(lattice, "fill", lambda *a: fills.append(a[1].shape) or fill(*a))
    got = [lattice.align_many(sources, targets, c, o) for o in (None, overlay)]
    shapes = {(len(s), len(t)) for s, t in pairs}
    assert len(fills) < len(shapes)  # two runs take fewer fills than there are shapes
    monkeypatch.setattr(lattice, "STEP", 1)
    for (links, cost), o in zip(got, (None, overlay)):
        want_links, want_cost = lattice.align_many(sources, targets, c, o)
        assert (links == want_links).all() and (cost == want_cost).all()


def plain_loop(pairs, rounds=30, tolerance=1e-4):
    """Counts of the last round by the scalar aligner."""
    alpha, log_z = pairwise.prior(sorted({x for s, t, _ in pairs for x in (*s, *t)}))
    costs, last = alignment.Costs(one=distance, tier=pairwise.chunk_tier), None
    for _ in range(rounds):
        counts, total = {}, 0.0
        for s, t, w in pairs:
            links, cost = alignment.align(s, t, costs)
            total += w * cost
            for i, j in pairwise.bound_positions(links, s, t)[0]:
                counts[s[i], t[j]] = counts.get((s[i], t[j]), 0.0) + w
        moves = {}
        for (s, t), n in sorted(counts.items()):
            moves[pairwise.move(s, t)] = moves.get(pairwise.move(s, t), 0.0) + n
        m = pairwise.Pairwise(counts, alpha, log_z, moves, {})
        costs = alignment.Costs(one=m.one, tier=pairwise.chunk_tier)
        if last is not None and abs(total - last) <= tolerance * max(1e-12, abs(last)):
            break
        last = total
    return counts


def test_distributed_rounds_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "DEAL", 16)
    groups = {("a", "b"): mutated(60, 2), ("a", "c"): mutated(40, 3), ("b", "c"): [(list("pat"), list("pat"))] * 3}
    rows = [(a, b, s, t, float(1 + k % 2)) for (a, b), own in groups.items() for k, (s, t) in enumerate(own)]
    df = spark.createDataFrame(rows, "lect_a string, lect_b string, source array<string>, target array<string>, weight double")
    got = pairwise.trained(df).where("kind = 'segment'").collect()
    for (a, b), own in groups.items():
        want = plain_loop([(s, t, float(1 + k % 2)) for k, (s, t) in enumerate(own)])
        mine = {(r.source, r.target): r["count"] for r in got if (r.lect_a, r.lect_b) == (a, b)}
        assert mine.keys() == want.keys() and all(abs(mine[k] - v) < 1e-6 for k, v in want.items())


@pytest.fixture(scope="module")
def tonal(spark):
    """Final e lost after t, tone by the voice of a lost contrast, r for l between vowels."""
    rng, rows = random.Random(3), ["cognate_id\tlect_id\tsegments"]
    for k in range(120):
        c, v, l, e = rng.choice("bp"), rng.choice("aiu"), rng.choice("lmn"), rng.choice("ees")
        tone = "²" if c == "b" else "⁵"
        rows += [f"{k}\told\t{c} {v} {l} {v} t {e}", f"{k}\tnew\tp {v}{tone} {'r' if l == 'l' else l} {v} t" + (" s" if e == "s" else "")]
    return train(corpus.load_long(spark, text="\n".join(rows)), Options(null_draws=20))


def test_losses_become_gaps_through_chunks(tonal):
    chunks = {(tuple(r.source), tuple(r.target)): r for r in tonal.chunk_report.collect()}
    own = chunks[("t",), ("t", "e")]
    assert (own.identity, own.changed, own.insertions, own.deletions, own.process) == (1, 0, 1, 0, "residual_reduction") and own.overlaps == 0
    assert chunks[("a", "t"), ("a", "t", "e")].overlaps == 1
    held = {r.tuple: r["count"] for r in tonal.classes.collect()}
    assert held["new=∅ ~ old=e"] == 80 and held["new=r ~ old=l"] == 30 and held["new=t ~ old=t"] == 120 and len(held) == 11


def test_tones_and_their_conditions(tonal):
    rows = {(r.environment, r.value): (r["count"], r.total, r.contrast_count) for r in tonal.cross.where("not lect_internal").collect()}
    assert rows == {("preceding:voiced=+", "²"): (60, 60, 0), ("preceding:voiced=-", "⁵"): (60, 60, 0)}
    assert sorted(r.value for r in render.cross_notation(tonal.cross.where("not lect_internal")).collect()) == ["new [tone=²]  /  old: [+voiced] _", "new [tone=⁵]  /  old: [-voiced] _"]
    assert sum(r.value.startswith("XDIM\told>new\tpreceding=voiced=") for r in render.summary(tonal).collect()) == 2
    # what the rules explain costs less in the second alignment
    assert tonal.links.agg(F.avg("cost")).first()[0] < tonal.first_links.agg(F.avg("cost")).first()[0] - 1


def test_searches_carry_numbers_of_tokens(tonal, monkeypatch):
    tonal.run()
    kinds, search = [], classes.searched
    monkeypatch.setattr(classes, "searched", lambda rows, *a, **k: kinds.append(dict(rows.dtypes)["tokens"]) or search(rows, *a, **k))
    pairwise.conditions(tonal.singles, tonal.environments)
    found = classes.conditioned(tonal.observations, tonal.sets, 5, held=tonal.environments)
    assert kinds == ["array<smallint>"] * 2
    text = lambda rows: sorted(map(str, rows.collect()))
    rows = classes.pivot_rows(tonal.observations, tonal.sets, tonal.environments)
    assert text(found) == text(search(rows.drop("set_id"), 5))
    codes, names = contexts.coded(tonal.environments)
    decided = classes.decided(classes.pivot_rows(tonal.observations, tonal.sets, codes), tonal.conditioned, ["set_id"], names)
    assert text(decided) == text(classes.decided(rows, tonal.conditioned, ["set_id"]))
    plain = {(r.word, r.pos): r.tokens for r in tonal.environments.collect()}
    assert {(r.word, r.pos): [names[t] for t in r.tokens] for r in codes.collect()} == plain
    some = tonal.environments.limit(1).select(contexts.codes_of(F.array(F.lit(names[2]), F.lit("no:such=+")), names).alias("c"))
    assert some.first().c == [2, -1]


def test_contexts_are_shuffled_once(spark):
    schema = "pivot_lect string, pivot string, tokens array<smallint>, sisters array<struct<lect:string,grapheme:string>>, weight double"
    rows = spark.createDataFrame([("x", "p", [k % 2], [("o", "ab"[k % 2])], 1.0) for k in range(20)], schema)
    found = classes.searched(rows, 0, names=["following:s=+", "preceding:t=+"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    text = spark.createDataFrame([("x", "p", [["following:s=+"], ["preceding:t=+"]][k % 2], [("o", "ab"[k % 2])], 1.0) for k in range(20)], schema.replace("smallint", "string"))
    assert len(found.collect()) > 0 and sorted(map(str, found.collect())) == sorted(map(str, classes.searched(text, 0).collect()))


def test_rules_of_both_sides(spark):
    rng, rows = random.Random(5), ["cognate_id\tlect_id\tsegments"]
    for k in range(80):
        c, v = rng.choice("ptk"), rng.choice("aiueo")
        rows += [f"{k}\ta\tm {c} {v} n", f"{k}\tb\tm {'tʃ' if c == 't' and v in 'ie' else c} {v} n"]
    model = train(corpus.load_long(spark, text="\n".join(rows)), Options(null_draws=5))
    # of two outcomes the better statable one is committed: what follows t decides
    own = [r for r in model.pair_rules.collect() if r.side == "source" and r.pivot == "t"]
    assert own and all(r.partner == "t" and r.rate == 1.0 and r.contrast_rate < 1 and r.tokens[0].startswith("following:") for r in own)
    held = [len(r.rules) for r in pairwise.holding(model.pair_rules, model.environments, model.words.select("lect_id", "word", F.posexplode("form.grapheme").alias("pos", "grapheme"))).collect()]
    assert held and all(n >= 1 for n in held)
    lines = [r.value for r in render.pair_tables(model.segments, rules=model.pair_rules).collect()]
    assert any("\tsource:following=" in x for x in lines)


def test_the_most_specific_rule_counts():
    m = model_of([(list("lal"), list("ral"))])
    rule = lambda pos, n, size, place: {"pos": pos, "partner": "r", "count": n, "size": size, "place": place}
    import pandas as pd

    words = pd.DataFrame({"a_rules": [[rule(0, 3.0, 1, 0), rule(2, 5.0, 1, 0)]], "b_rules": [[{"pos": 0, "partner": "l", "count": 2.0, "size": 2, "place": 7}]], "a_form": [None], "b_form": [None]})
    c = m.coded()
    over = pairwise.Overlay(m, c, words, [], [])
    x, y = np.array([c.coded([list("lal")])[0]]), np.array([c.coded([list("ral")])[0]])
    ones = c.one[x[:, :, None], y[:, None, :]]
    pairs, single = over(np.array([0]), x, y, ones)
    assert pairs[0, 0, 0] == single[0, 0, 0] == m.under_rule("l", "r", 2.0)  # the target's rule says more
    assert pairs[0, 2, 0] == m.under_rule("l", "r", 2.0) and pairs[0, 1, 1] == ones[0, 1, 1]
    words["b_rules"] = [None]
    assert pairwise.Overlay(m, c, words, [], [])(np.array([0]), x, y, ones)[0][0, 0, 0] == m.under_rule("l", "r", 3.0)


def test_a_rare_rule_without_exceptions_takes_no_link_apart(spark):
    """l is ɾ before vowels, before o a few times only: a rule of its own for those makes the pair cheaper, as one for the others does."""
    rng, rows = random.Random(8), ["cognate_id\tlect_id\tsegments"]
    words = sorted({"".join(rng.choice("ptklll") + rng.choice("aei") for _ in range(3)) + rng.choice(["", "l"]) for _ in range(300)}) + ["lot", "plot", "klos", "palo"]
    made = ["".join("ɾ" if c == "l" and w[i + 1 : i + 2] in ("a", "e", "i", "o") else c for i, c in enumerate(w)) for w in words]
    for k, (w, new) in enumerate(zip(words, made)):
        rows += [f"{k}\told\t{' '.join(w)}", f"{k}\txnew\t{' '.join(new)}"]
    model = train(corpus.load_long(spark, text="\n".join(rows)), Options(null_draws=0))
    total = float(sum(w.count("ɾ") for w in made))
    told = [("old", "xnew", "source", "l", "ɾ", [f"following:{f}=+"], n, 1.0, 0.5, 9.0, k) for k, (f, n) in enumerate([("rounded", 4.0), ("unrounded", total - 4)])]
    kinds = {f.name: f.dataType.simpleString() for f in model.pair_rules.schema.fields}
    model.__dict__["pair_rules"] = spark.createDataFrame(told, ", ".join(f"{c} {kinds[c]}" for c in pairwise.RULES))
    priced = [r["count"] for r in pairwise.shared(model.pair_rules, model.models).collect()]
    assert len(priced) == 2 and min(priced) > total
    held = {(r.source, r.target): r["count"] for r in model.segments.collect()}
    assert held["l", "ɾ"] == total and model.gaps.isEmpty()


def test_environments_of_cross_dimensional_rules():
    seg = lambda g, tone="": {"grapheme": g, "tone": tone, "length": "", "stress": ""}
    form = [seg("b"), seg("a", "²"), seg("t")]
    held = {
        ("preceding:voiced=+",): 1, ("preceding:voiced=-",): None, ("self:tone=²",): 1, ("self:tone=≠²",): 0, ("self:tone=-",): 0,
        ("preceding:voiced=+", "following:voiceless=+"): 1, ("preceding:voiceless=-",): 1,
    }
    for env, at in held.items():
        assert pairwise.cross_holds(list(env), form, 1) == (at == 1)
    assert not pairwise.cross_holds(["preceding:voiced=-"], form, 0) and not pairwise.cross_holds([], form, 1) and pairwise.cross_holds(["self:tone=-"], form, 2)


def test_adjustments_are_gains_over_the_values_own_rate():
    over = pairwise.Overlay.__new__(pairwise.Overlay)
    over.tones = {("", "²"): 30.0, ("", "⁵"): 10.0}
    rule = {"context_is_target": False, "value": "²", "count": 18.0, "total": 18.0}
    inside, base = 19 / 20, 31 / 42
    assert math.isclose(over.adjustment(rule, "²"), -(math.log(inside) - math.log(base))) and over.adjustment(rule, "") == 0
    assert math.isclose(over.adjustment(rule, "⁵"), -(math.log(1 - inside) - math.log(1 - base)))


def test_divisions_of_equal_masses_are_two_findings():
    names = ["a=+", "a=-", "b=+", "b=-"]
    a = np.array([1, 1, 0, 0] * 10, bool)
    b = np.array([1, 0, 1, 0] * 10, bool)
    value = ["1" if x and y else "2" if x else "3" if y else "4" for x, y in zip(a, b)]
    m = crossdim.Matrix(names, np.array([a, ~a, b, ~b]), np.ones((4, 40), bool), value, np.ones(40))
    inside, _ = m.sides()
    assert sorted(inside[0]) == sorted(inside[2]) and len({min(k, k[::-1]) for k in m.marks()}) == 2
    found = m.decisions(base=0)
    assert {r["environment"] for r in found} == {"a=+", "a=-", "b=+", "b=-"} and {r["decision"] for r in found} == {0, 1}


def scored_plainly(holds, defined, values, weight, least=3.0):
    """(delta, index) of the best single candidate, by counting."""
    out, marks = [], set()
    for h, d in zip(holds, defined):
        inner = tuple(k for k in range(len(values)) if d[k] and h[k])
        outer = tuple(k for k in range(len(values)) if d[k] and not h[k])
        marks.add(min((inner, outer), (outer, inner)))
    for c, (h, d) in enumerate(zip(holds, defined)):
        mass = [{}, {}]
        for k, v in enumerate(values):
            if d[k]:
                mass[0 if h[k] else 1][v] = mass[0 if h[k] else 1].get(v, 0) + weight[k]
        n = [sum(x.values()) for x in mass]
        kinds = set(mass[0]) | set(mass[1])
        if min(n) < least or len(kinds) < 2:
            continue
        nll = lambda x: sum(x.values()) * math.log(sum(x.values())) - sum(w * math.log(w) for w in x.values())
        pooled = {v: mass[0].get(v, 0) + mass[1].get(v, 0) for v in kinds}
        out.append((2 * (nll(mass[0]) + nll(mass[1]) - nll(pooled)) + (len(kinds) - 1) * math.log(sum(n)) + 2 * math.log(len(marks)), c))
    return min(out) if out else None


def test_first_decisions_by_counting():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = 60
        holds, defined = rng.random((6, n)) < 0.5, rng.random((6, n)) < 0.9
        value = ["x" if h or rng.random() < 0.2 else "y" for h in holds[2]]
        names = [f"f{k}=+" for k in range(6)]
        m = crossdim.Matrix(names, holds, defined, value, np.ones(n))
        want = scored_plainly(holds & defined, defined, value, np.ones(n))
        found = m.decisions(rounds=1, base=0)
        if found:
            assert math.isclose(found[0]["delta"], want[0]) and found[0]["environment"].split("=")[0] == names[want[1]].split("=")[0]
        else:
            assert want is None or want[0] >= 0 or m._published(want[1], 3) == []


@pytest.mark.parametrize("scorer", ["bic", "nml", "dirichlet"])
def test_scorers_agree_row_by_row_and_serve_training(spark, scorer):
    rng = np.random.default_rng(2)
    mass = rng.integers(0, 9, (20, 3)).astype(float)
    assert np.allclose(classes.row_codes(mass, scorer), [classes.CODES[scorer](m) for m in mass])
    rows = [("x", "p", [f"following:{'vowel' if k % 2 else 'nasal'}=+", "position:medial"], [{"lect": "o", "grapheme": "f" if k % 2 else "p"}], 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, "pivot_lect string, pivot string, tokens array<string>, sisters array<struct<lect:string,grapheme:string>>, weight double")
    got = {(r.environment, r.outcome) for r in classes.searched(df, 5, scorer=scorer).collect()}
    assert ("following:nasal=+", "o=p") in got


def test_options_are_checked():
    assert Options.of({"scorer": "nml"}).scorer == "nml"
    for wrong in ({"scorer": "guess"}, {"colour": 1}):
        with pytest.raises(ValueError):
            Options.of(wrong)


def test_aligned_pairs_from_the_command_line(tmp_path, capsys, spark, monkeypatch):
    import json

    from lautwerk import cli

    rows = ["cognate_id\tlect_id\tsegments"] + [f"{k}\t{lect}\t{w}" for k, pair in enumerate(itertools.product("ptk", "aiu")) for lect, w in (("a", f"{pair[0]} {pair[1]}"), ("b", f"{pair[0]} {pair[1]} s"))]
    (tmp_path / "c.tsv").write_text("\n".join(rows))
    assert cli.main(["align", str(tmp_path / "c.tsv"), "--lect-a", "a", "--options", '{"null_draws": 5}']) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(out) == 9 and {r["lect_b"] for r in out} == {"b"} and sum(x["source_length"] for x in out[0]["links"]) == 2


def test_models_without_a_fold_predict_it(spark):
    """A rule that holds everywhere is found without each fold, helps on it, and is confirmed; unconditioned counts are checked by hand."""
    from lautwerk.plans.evaluate import FoldModels

    rng, rows = random.Random(5), ["cognate_id\tlect_id\tsegments"]
    for k in range(150):
        c, v = rng.choice("ptk"), rng.choice("aiueo")
        rows += [f"{k}\ta\tm {c} {v} n", f"{k}\tb\tm {'tʃ' if c == 't' and v in 'ie' else c} {v} n"]
    sets = corpus.publish(corpus.load_long(spark, text="\n".join(rows)))
    e = FoldModels(sets, 3)
    got = {r.kind: r for r in e.scores().collect()}
    assert set(got) == {"conditioned", "unconditioned", "identity", "inventory", "feature"} and all(r.n == 1200 for r in got.values())
    assert got["conditioned"].log_loss < got["unconditioned"].log_loss < got["inventory"].log_loss and got["conditioned"].top1 >= got["unconditioned"].top1
    held = [r for r in e.predictions().where("kind = 'unconditioned' and side = 'source' and source = 't'").collect()]
    fold_of = {r.set_id: r.fold for r in e.left_out.select("set_id", "fold").collect()}
    for r in held:
        without = int(r.lect_a.split("/")[0])
        train_t = [rows[1 + 2 * k + 1].split("\t")[2].split()[1] for k in range(150) if fold_of[str(k)] != without and rows[1 + 2 * k].split("\t")[2].split()[1] == "t"]
        kinds = {x for k in range(150) if fold_of[str(k)] != without for x in rows[2 + 2 * k].split("\t")[2].split()}
        assert math.isclose(r.p, (1 + train_t.count(r.target)) / (len(train_t) + len(kinds) + 1))
    full = pairwise.conditions(pairwise.single_links(pairwise.aligned(pairwise.form_pairs(sets), 1)), e.environments)
    told = {(r.side, r.pivot, r.partner): r.verdict for r in e.confirmed(full).collect()}
    assert told["source", "t", "t"] == "confirmed"


def words_by_rule(spark, groups=False):
    """Old and new: new has f for p before i, and z for s everywhere."""
    rows = ["cognate_id\tlect_id\tsegments" + "\tetymon_group" * groups]
    for k, word in enumerate(a + v + b + w for a in "pstk" for v in "iae" for b in "nsp" for w in "ia"):
        new = [{"p": "f" if k + 1 < len(word) and word[k + 1] == "i" else "p", "s": "z"}.get(x, x) for k, x in enumerate(word)]
        for lect, form in (("old", word), ("new", new)):
            rows.append(f"w{k}\t{lect}\t{' '.join(form)}" + f"\t{'' if k % 4 == 3 else 'g' + str(k // 4)}" * groups)
    return corpus.load_long(spark, text="\n".join(rows))


def copies(seed, draw, unit):
    """A group's multiplicity, counted plainly."""
    import hashlib

    piece = hashlib.md5(f"{seed}-{draw // 4}-{unit}".encode()).hexdigest()[8 * (draw % 4) :][:8]
    return sum(int(piece, 16) >= t for t in resampling.STEPS)


def test_hashed_draws_are_poisson_and_equal_plain_counting(spark):
    rows = [(f"g{k % 300}", "x" if k % 3 else "y", float(k % 5)) for k in range(900)] + [(None, "x", 1.0)]
    df = spark.createDataFrame(rows, "g string, label string, n double")
    got = {(r.draw, r.label): r.mass for r in resampling.hashed_masses(df, "g", ["label"], "n", 10, 3).collect()}
    assert len(got) == 20
    for (draw, label), mass in got.items():
        assert mass == sum(n * copies(3, draw, g or "") for g, x, n in rows if x == label)
    many = [copies(0, d, k) for d in range(40) for k in range(500)]
    assert abs(np.mean(many) - 1) < 0.03 and abs(np.var(many) - 1) < 0.05
    assert resampling.hashed_rates(df.limit(0), "g", "label", "n", 10).count() == 0


def test_units_of_drawing(spark):
    sets = spark.createDataFrame([("a", "e", ""), ("b", "e", None), ("c", "", "q"), ("e", None, "q")], "set_id string, etymon_group string, source_group string")
    unit = lambda u, s=sets: {r.set_id: r.unit for r in tables.units(s, u).collect()}
    assert unit("auto") == unit("etymon_group") == {"a": "of:e", "b": "of:e", "c": "own:c", "e": "own:e"}
    assert unit("source_group") == {"a": "own:a", "b": "own:b", "c": "of:q", "e": "of:q"}
    assert unit("auto", sets.drop("etymon_group")) == unit("set") == {x: f"own:{x}" for x in "abce"}
    with pytest.raises(ValueError):
        tables.units(sets, "word")


def test_intervals_of_both_kinds_of_classes(spark):
    model = train(words_by_rule(spark, groups=True), Options(null_draws=9, bootstrap=40))
    seen = [r.asDict(True) for r in model.observations.collect()]
    rules = model.conditioned.collect()
    assert any(r.outcome == "new=f" or r.outcome == "old=p" for r in rules)
    held = {r.tuple: r.n for r in classes.conditioned_masses(classes.pivot_rows(model.observations, model.sets), model.conditioned, []).collect()}
    for r in rules:
        name = f"{r.pivot_lect}={r.pivot} ~ {r.outcome} / {r.environment}"
        assert held[name] == pytest.approx(r["count"])
    unit = {r.set_id: r.unit for r in tables.units(model.sets).collect()}
    assert len(set(unit.values())) < len(unit)
    got = {r.tuple: (r.low, r.high) for r in model.intervals.collect()}
    assert set(held) <= set(got)
    for name in sorted(set(got) - set(held)):
        rates = []
        for d in range(40):
            mass = [(o["weight"] * copies(20260815, d, unit[o["set_id"]]), " ~ ".join(f"{m['lect']}={m['grapheme']}" for m in o["members"]) == name) for o in seen]
            rates.append(sum(m for m, own in mass if own) / sum(m for m, _ in mass))
        assert got[name] == pytest.approx(tuple(np.quantile(rates, (0.025, 0.975))))


def test_baseline_of_shuffled_forms(spark):
    options = Options(permutations=3, null_draws=9)
    model = train(words_by_rule(spark), options)
    mixed = null_models(model.sets, 3, options)
    assert mixed.sets.count() == 3 * model.sets.count()
    forms = lambda rows: sorted((r.lect_id.split("/")[-1], "".join(r.s)) for r in rows.select("lect_id", F.col("segments.grapheme").alias("s")).collect())
    own = forms(model.sets)
    for k in range(3):
        assert forms(mixed.sets.where(F.startswith("set_id", F.lit(f"{k}/")))) == own
    runs = null_runs(mixed).collect()
    row = model.baseline.first()
    assert row.runs == len(runs) == 3 and row.cost_mean == pytest.approx(np.mean([r.cost for r in runs])) and row.cost_sd == pytest.approx(np.std([r.cost for r in runs], ddof=1))
    assert row.conditioned_mean == pytest.approx(np.mean([r.conditioned for r in runs])) and row.unconditioned_mean == pytest.approx(np.mean([r.unconditioned for r in runs]))
    margins = sorted(r.margin for r in mixed.conditioned.collect())
    assert row.search_margin == (margins[min(int(0.95 * len(margins)), len(margins) - 1)] if margins else None)
    assert row.cost_mean > model.fit().first().cost_per_segment
    assert Model(model.sets, Options()).baseline is None


def test_places_of_dealing(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), (F.xxhash64("id") % 500).alias("x"))
    order = F.abs("x") * 8000000
    got = dealt(df, ["g"], order, "id", "place", 6).toPandas()
    for _, own in got.groupby("g"):
        own = own.assign(k=own.x.abs()).sort_values(["k", "id"])
        assert list(own.place) == list(range(len(own)))


def test_margin_at_a_share(spark):
    df = spark.createDataFrame([(float(k // 2),) for k in range(41)], "margin double")
    assert margin_at(df, 0.95).first()[0] == sorted(k // 2 for k in range(41))[int(0.95 * 41)]
    assert margin_at(df.limit(0), 0.95).first()[0] is None


def test_rivals_of_a_rule():
    """Where two slots state one division, each is the other's double; a weaker division elsewhere is a rival."""
    tokens, outcomes = [], []
    for k in range(120):
        front = k % 2 == 0
        own = {"following:front" if front else "following:back", "following:vowel"}
        own |= {"stress:yes"} if front else set()
        own |= {"preceding:nasal"} if k % 2 == 0 and k % 10 or k % 30 == 1 else set()
        tokens.append(frozenset(own))
        outcomes.append({"new": "x" if front else "y"})
    bucket = classes.Bucket(tokens, outcomes, np.ones(120))
    (first, *_) = bucket.rules()
    tokens, inside, margin, alike, rivals = first
    assert inside.sum() == 60 and margin > 0
    slot = tokens[0].split(":")[0]
    assert {t.split(":")[0] for t in alike} == {"following", "stress"} - {slot}
    assert rivals == ["preceding:nasal"]


def test_events_keep_what_all_members_share(spark):
    model = train(words_by_rule(spark), Options(null_draws=9))
    rules = spark.createDataFrame(
        [("old", "p", 0, "following:i", "new=f", ["stress:a", "word:b"], ["preceding:n"]), ("old", "t", 0, "following:i", "new=s", ["word:b"], ["preceding:n", "preceding:m"]), ("old", "k", 0, "following:i", "new=x", ["word:b"], [])],
        "pivot_lect string, pivot string, decision int, environment string, outcome string, alike array<string>, rivals array<string>",
    ).withColumns({"count": F.lit(9.0), "margin": F.lit(5.0)})
    row = classes.events(rules, model.sets).where("axis = 'environment'").first()
    assert row.inputs == "k,p,t" and row.environment == "following:i" and row.alike == "word:b" and row.rivals == "" and row["count"] == 27.0
    # of old's inventory p t k s n i a e, what p t k have alone
    inventory = {g: features(g) for g in "ptksniae"}
    common = set.intersection(*[set(inventory[g]) for g in "ptk"])
    alone = sorted(f for f in common if not any(f in inventory[g] for g in "sniae"))
    pairs = sorted(f"{a}+{b}" for a, b in itertools.combinations(sorted(common), 2) if not any({a, b} <= set(inventory[g]) for g in "sniae"))
    assert row.name == (alone or pairs or [None])[0]
    assert {"alike", "rivals", "name"} <= set(model.events.columns) and model.events.count() >= 0


def test_progress_and_cancelling(spark):
    import threading
    import time

    seen = []
    model = train(words_by_rule(spark), Options(null_draws=9, feedback=False))
    assert model.run(lambda *x: seen.append(x)) is model
    assert [s for s, _, _ in seen] == model.stages and [d for _, d, _ in seen] == list(range(1, len(seen) + 1)) and {n for _, _, n in seen} == {len(seen)}
    again = train(words_by_rule(spark), Options(null_draws=9))
    with pytest.raises(Cancelled, match="pairs"):
        again.run(lambda stage, done, total: True)
    assert "models" not in again.__dict__
    ended = []

    def work():
        try:
            again.run()
        except Cancelled as error:
            ended.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(1.5)
    again.cancel()
    thread.join(120)
    assert ended and not thread.is_alive()
    assert spark.range(5).count() == 5


def test_counts_of_syllables(spark):
    forms = [("a", "p a"), ("b", "p s t"), ("c", "p s t"), ("d", "k a t a")]
    rows = corpus.load_long(spark, text="cognate_id\tlect_id\tsegments\n" + "\n".join(f"{c}\t{lect}\t{f}" for c, f in forms for lect in ("x", "y")))
    sets = corpus.publish(rows, 2)
    assert tuple(contexts.syllable_counts(sets).first()) == (8, 4)
    assert tuple(contexts.syllable_counts(sets.limit(0)).first()) == (0, 0)


def test_cut_of_costs_against_all_cuts(spark):
    rng = random.Random(3)
    groups = {"ties": [1.0, 1.0, 1.0, 5.0, 5.0, 9.0], "same": [2.0] * 5, "two": [1.0, 4.0], "twice": [3.0, 3.0], "one": [7.0], "long": [round(rng.gauss(0, 1) + 6 * (rng.random() < 0.3), 1) for _ in range(400)]}
    df = spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs] + [("ties", None)], "g string, c double")
    got = {r.g: (r.n, r.separation, r.above) for r in outliers.cost_split(df, "g", "c").collect()}
    assert set(got) == set(groups) - {"one"}
    for g, cs in groups.items():
        cs, n = sorted(cs), len(cs)
        if n < 2:
            continue
        square = lambda x: float(((np.array(x) - np.mean(x)) ** 2).sum())
        k = min(range(1, n), key=lambda k: (round(square(cs[:k]) + square(cs[k:]), 9), k))
        within = square(cs[:k]) + square(cs[k:])
        want = (np.mean(cs[k:]) - np.mean(cs[:k])) / math.sqrt(within / (n - 2)) if n >= 4 and within > 1e-12 else 0.0
        assert got[g] == pytest.approx((n, want, (n - k) / n if n >= 4 else 0.0))
    assert outliers.cost_split(df.limit(0), "g", "c").count() == 0


def test_splits_of_several_pivots_are_one_class(spark):
    rows = words_by_rule(spark)
    third = rows.where("lect_id = 'old'").withColumn("lect_id", F.lit("mid"))
    model = train_sets(corpus.publish(rows.unionByName(third), 2), Options(null_draws=9))
    found = {r.tuple: r for r in model.merged.where(F.contains("tuple", F.lit("new=f"))).collect()}
    row = found["mid=p ~ new=f ~ old=p"]
    assert [e.split("/")[0] for e in row.environments] == ["mid", "old"] and row.splits == 2
    here = model.observations.where(F.exists("members", lambda m: m["grapheme"] == "f")).count()
    assert row["count"] == here
    assert model.merged.agg(F.sum("splits")).first()[0] == model.conditioned.count()
    # one observation more in the later split, and it stays a class of its own
    more = spark.createDataFrame([("k", d, o) for d, own in ((0, "abc"), (1, "ab"), (2, "abd")) for o in own], "key string, decision int, obs string")
    assert {r.decision: r.into for r in splits.merged(more).collect()} == {0: 0, 1: 0, 2: 2}
