"""The engine outside of the document operators: kernels, statistics, sources, training, and all queries against SQL."""

import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lautwerk.functions import features, stats
from lautwerk.functions.environments import is_subset, key, most_specific
from lautwerk.operators import alignment, classes, contexts, crossdim, events, grouping, pairwise, splits
from lautwerk.plans import queries as plans
from lautwerk.plans import render
from lautwerk.plans.train import Options, null_costs, train
from lautwerk.sources import corpus

SF = "/root/testdata/sf0.001"


def toy(spark):
    """Two lects by rule: k becomes tʃ before front vowels, p becomes f everywhere."""
    rows = ["cognate_id\tlect_id\tsegments"]
    k = 0
    for c in "ptkbdmns":
        for v in "ieou":
            for w in "tnsl":
                word = [c, v, w, "a"]
                after = ["tʃ" if x == "k" and word[i + 1] in "ie" else "f" if x == "p" else x for i, x in enumerate(word)]
                rows += [f"w{k}\told\t{' '.join(word)}", f"w{k}\tnew\t{' '.join(after)}"]
                k += 1
    return corpus.load_long(spark, text="\n".join(rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(pdf, columns):
    pdf = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(name, spark, duck):
    a, b = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a, sorted(a.columns)) == rows_of(b, sorted(a.columns))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson(spark):
    low, high = stats.wilson(F.lit(5), F.lit(10))
    r = one(spark, low.alias("l"), high.alias("h"), *[c.alias(n) for c, n in zip(stats.wilson(F.lit(0), F.lit(0)), "ab")])
    assert r.l < 0.5 < r.h and r.a == 0 and r.b == 1
    with pytest.raises(ValueError):
        stats.wilson(F.lit(1), F.lit(2), 0.5)


def test_log_gamma_and_codes(spark):
    r = one(spark, *[stats.lgamma(F.lit(float(x))).alias(f"g{i}") for i, x in enumerate((0.5, 1, 2.5, 30))], stats.nml_normalizer(F.lit(2), 2).alias("two"), stats.nml_normalizer(F.lit(2), 3).alias("three"))
    assert [r[f"g{i}"] for i in range(4)] == pytest.approx([math.lgamma(x) for x in (0.5, 1, 2.5, 30)], abs=1e-9)
    assert r.two == pytest.approx(math.log(2.5)) and r.three == pytest.approx(math.log(4.5))


def test_split_score(spark):
    df = spark.createDataFrame([("a", True)] * 4 + [("b", False)] * 4, "o string, p boolean")
    r = splits.scores(splits.masses(df, "o", {"p": F.col("p")})).first()
    assert r.delta == pytest.approx(-16 * math.log(2) + math.log(8)) and r.dominant == 1


def test_syllables():
    want = {"pater": [2], "kasa": [2], "jam": [], "ngata": [3], "amiko": [1, 3], "strata": [4], "kartli": [3], "mbundu": [4], "filius": [2, 4]}
    got = {w: features.syllable_breaks(list(w)) for w in want}
    assert got == want
    assert features.syllable_breaks(list("apta")) == [1] and features.syllable_breaks(list("apta"), [2]) == [2]
    assert features.sonority("ɬ") == 2 and features.sonority("l") == 4


def test_distances_and_displacement():
    d = features.distance
    assert d("p", "p") == 0 and d("p", "b") < d("p", "a") and d("p", "b") == d("b", "p")
    assert features.displacement("p", "b") == [("voiceless", "present", "absent"), ("voiced", "absent", "present")]
    assert features.segment("tʃaːnˠ") == ["tʃ", "aː", "nˠ"] and features.diagnose("p7") == ("partial", "p", "7")


def test_alignment():
    prior = alignment.prior_costs(features.distance)
    links, cost = alignment.align(list("pater"), list("pater"), prior)
    assert len(links) == 5 and cost == 0
    links, _ = alignment.align(list("pater"), list("fadar"), prior)
    assert [x[1::2] for x in links] == [(1, 1)] * 5
    costs = [alignment.align(list("pasko"), list("pakso"), alignment.prior_costs(features.distance, max_chunk=k))[1] for k in (1, 2, 3)]
    assert costs == sorted(costs, reverse=True)
    assert alignment.reordering(tuple("sk"), tuple("ks")) == [1, 0] and alignment.reordering(tuple("sk"), tuple("sk")) is None
    assert alignment.align([], list("ab"), prior)[1] == 1.0


def test_unit_alignment_is_edit_distance():
    rng = random.Random(2)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert alignment.align(list(a), list(b), alignment.unit_costs())[1] == edit(a, b)


def test_environments(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    r = one(spark, is_subset(b, a).alias("s"), is_subset(a, b).alias("t"), key(a).alias("k"), key(F.array()).alias("e"), most_specific(a, [("one", ["x"]), ("two", ["x", "y"]), ("three", ["z"])]).alias("m"))
    assert (r.s, r.t, r.k, r.e, r.m) == (True, False, "x;y", "-", "two")


def test_long_source(spark):
    text = 'cognate_id\tlect_id\tsegments\ttone\tconfidence\n1\ta\tp a⁵⁵ + t a ²¹\t\t1\n1\tb\tp ˈa t -\t1 - 3\t0.5\n\n2\t\tp\t\t\n3\ta\t-\t\t\n'
    rows = {r.lect_id: r for r in corpus.load_long(spark, text=text).collect()}
    assert set(rows) == {"a", "b"}
    assert [(s.grapheme, s.tone) for s in rows["a"].segments] == [("p", ""), ("a", "⁵⁵"), ("t", ""), ("a", "²¹")] and rows["a"].breaks == [2]
    assert [(s.grapheme, s.tone, s.stress) for s in rows["b"].segments] == [("p", "1", ""), ("a", "", "primary"), ("t", "3", "")]
    with pytest.raises(ValueError):
        corpus.load_long(spark, text="a\tb\n1\t2\n")


def test_other_sources(spark):
    wide = corpus.load_wide(spark, text="gloss\tA\tB\tB_tone\nfoot\tpat+a\tfat\t1 - -\nfoot\tpa\tfa\t\n").collect()
    assert {r.cognate_id for r in wide} == {"foot", "foot.2"} and any(r.breaks == [3] for r in wide)
    gled = corpus.load_gled(spark, text="DOCULECT\tFAMILY\tIPA\tCOGSET\nx\tF\tp a\t1\ny\tG\tp a\t1\n", family="F").collect()
    assert [r.lect_id for r in gled] == ["x"]
    arca = corpus.load_arcaverborum(spark, text="Language_ID,Segments,Cognacy\nx,p a,7;8\ny,<NA>,7\nz,p o,NA\n").collect()
    assert [(r.lect_id, r.cognate_id) for r in arca] == [("x", "7")]
    assert corpus.from_pairs(spark, [(["p"], ["f"])], "a", "b").count() == 2


def test_doublets_become_combinations(spark):
    text = "cognate_id\tlect_id\tsegments\n" + "".join(f"1\ta\tp {v}\n" for v in "aeiou") + "".join(f"1\tb\tf {v}\n" for v in "ae") + "2\ta\tp\n"
    sets = corpus.publish(corpus.load_long(spark, text=text))
    assert sets.select("set_id").distinct().count() == 8 and {r.confidence for r in sets.collect()} == {1 / 8}
    pairs = {tuple(sorted((r.lect_id, r.segments[1].grapheme) for r in own)) for own in [[r for r in sets.collect() if r.set_id == f"1#{k}"] for k in range(8)]}
    assert len(pairs) == 8




def test_training_finds_the_rule(spark):
    model = train(toy(spark))
    tuples = {r.tuple: r for r in model.classes.collect()}
    assert tuples["new=f ~ old=p"].sets == 16 and "new=tʃ ~ old=k" in tuples and tuples["new=tʃ ~ old=k"]["count"] == 8
    rules = model.conditioned.where("standing = 'above_noise'").collect()
    assert rules and {r.pivot for r in rules if r.pivot_lect == "old"} == {"k"}
    assert all(r.rate > r.contrast_rate for r in rules)
    assert model.events.count() >= 0 and model.fit().first().sets == 128
    assert render.summary(model).first().value == "LECTS\tnew old" and render.model_report(model).count() > 5 and render.rule_lines(model.conditioned).count() > 0
    lines = [r.value for r in render.document(model).collect()]
    assert any('"format_version":1' in x for x in lines) and sum('"part":"classes"' in x for x in lines) == model.classes.count()
    with pytest.raises(ValueError, match="colour"):
        Options.of({"colour": 1})


def test_names_of_lects_do_not_matter(spark):
    forms = toy(spark)
    other = forms.withColumn("lect_id", F.when(F.col("lect_id") == "old", "aaa").otherwise("zzz"))
    a, b = train(forms), train(other)
    assert sorted(r["count"] for r in a.classes.collect()) == sorted(r["count"] for r in b.classes.collect())
    assert sorted((r.pivot, r["count"]) for r in a.conditioned.collect()) == sorted((r.pivot, r["count"]) for r in b.conditioned.collect())


def test_chance_is_declined(spark):
    rng = random.Random(9)
    rows = ["cognate_id\tlect_id\tsegments"]
    for k in range(40):
        rows += [f"{k}\t{lect}\t" + " ".join(rng.choice("ptkaiumns") for _ in range(4)) for lect in "ab"]
    assert train(corpus.load_long(spark, text="\n".join(rows))).conditioned.where("standing = 'above_noise'").count() == 0


def test_shuffled_corpora_cost_more(spark):
    sets = corpus.publish(toy(spark))
    own = pairwise.set_costs(pairwise.aligned(pairwise.form_pairs(sets))).agg(F.avg("cost")).first()[0]
    null = [r.cost for r in null_costs(sets, 2).collect()]
    assert len(null) == 2 and min(null) > own


def test_refused_corpora(spark):
    with pytest.raises(ValueError, match="confidence"):
        train(toy(spark).withColumn("confidence", F.lit(2.0)))


def test_shared_members(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2), ("a", 3)], "o string, m int")
    got = {(r.a, r.b): r.shared for r in grouping.shared_members(df, "o", F.col("m")).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_contexts(spark):
    rows = [("w", list("pat"), [], [2], ["", "primary", ""])]
    words = spark.createDataFrame(rows, "word string, graphemes array<string>, given array<int>, morphemes array<int>, stress array<string>")
    got = {r.pos: r.tokens for r in contexts.environments(words).collect()}
    assert "following:vowel=+" in got[0] and "position:initial" in got[0] and "preceding@2:stop=+" in got[2]
    assert "morpheme:only" in got[2] and "stress:primary" in got[1] and "following_stress:primary" in got[0]


def test_events_are_groups_that_agree():
    base = {"environment": ["following:vowel=+"], "displacement": ["+voiced"], "count": 10}
    rows = [dict(base, class_id=k, input=i, outcome=o) for k, (i, o) in enumerate((("p", "b"), ("t", "d"), ("k", "ɡ")))] + [dict(base, class_id=9, input="p", outcome="v", environment=["preceding:nasal=+"])]
    assert [[m["class_id"] for m in g] for g in events.cliques(rows, "environment")] == [[0, 1, 2]]
    assert crossdim.negated("tax=+") == "tax=-" and crossdim.negated("tax=-") == "tax=+" and crossdim.negated("tone=≠2") == "tone=2"


def test_stream_counts(spark, tmp_path):
    from lautwerk.streaming.incremental import running_counts

    spark.createDataFrame([("p", "f"), ("p", "f"), ("t", "t")], "source string, target string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source string, target string").parquet(f"{tmp_path}/in")
    q = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.source, r["count"]) for r in spark.table("counts").collect()} == {("p", 2), ("t", 1)}


def test_tables_of_links(spark):
    from lautwerk.operators import tables

    rows = ["cognate_id\tlect_id\tsegments"]
    for k in range(12):
        c, tone = ("b", "²") if k % 2 else ("p", "⁵")
        rows += [f"{k}\ta\tm {c} a t e s", f"{k}\tb\tm p a{tone} t e", f"{k}\tc\tm p a{tone} t e"]
    sets = corpus.publish(corpus.load_long(spark, text="\n".join(rows)))
    links = pairwise.aligned(pairwise.form_pairs(sets), max_chunk=1)
    at = tables.bound(links, sets).cache()
    gaps = {(r.lect_a, r.lect_b, r.source, r.target): r["count"] for r in tables.gap_rows(at).collect()}
    assert sum(n for (a, _, s, t), n in gaps.items() if a == "a" and t == "∅") == 24 and all("∅" in (s, t) for _, _, s, t in gaps)
    tones = {(r.lect_a, r.lect_b, r.source_tone, r.target_tone): r["count"] for r in tables.tonal_counts(at).collect()}
    assert tones["b", "c", "⁵", "⁵"] == 6 and tones["a", "b", "", "²"] == 6
    assert [(r.a, r.b, r.shared) for r in tables.duplicate_lects(sets).collect()] == [("b", "c", 12)]
    seen = classes.reconciled(links, sets)
    band = {r.tuple: (r.low, r.high) for r in tables.class_intervals(seen, 50).collect()}
    assert all(0 <= low <= high <= 1 for low, high in band.values()) and len(band) >= 3
    assert tables.dimension_rules(at).count() >= 0


def test_dependency_folds(spark):
    from lautwerk.operators.graph import Scratch
    from lautwerk.plans.evaluate import folds

    rows = [(f"s{i}", f"c{i // 2}", "" if i % 5 else "e", "") for i in range(30)]
    sets = spark.createDataFrame(rows, "set_id string, cognate_id string, etymon_group string, source_group string")
    got = {r.set_id: r.fold for r in folds(sets, 3, Scratch(spark, "folds")).collect()}
    assert len(got) == 30 and all(got[f"s{2 * i}"] == got[f"s{2 * i + 1}"] for i in range(15))
    assert len({got[f"s{i}"] for i in range(0, 30, 5)}) == 1 and len(set(got.values())) == 3


def test_held_out_prediction(spark):
    from lautwerk.plans.evaluate import predictive

    rows = {r.kind: r for r in predictive(corpus.publish(toy(spark)), 4).collect()}
    r = rows["unconditioned"]
    assert r.n > 100 and r.top1 > 0.7 and r.log_loss < rows["inventory"].log_loss


def test_cldf(spark):
    from lautwerk.sources.cldf import from_cldf

    forms = spark.createDataFrame([("1", "x", "p a"), ("2", "y", "f a"), ("3", "y", None)], "ID string, Language_ID string, Segments string")
    cognates = spark.createDataFrame([("1", "c", "false"), ("2", "c", "true"), ("3", "c", "false")], "Form_ID string, Cognateset_ID string, Doubt string")
    assert [tuple(r) for r in from_cldf(forms, cognates).collect()] == [("c", "x", "p a")]


def test_ranks_over_blocks(spark):
    from lautwerk.operators.graph import ranked

    ids = [-9, 0, 1, 5000, 4096 * 4096 * 3, 7, 2**40]
    got = {r.i: r.place for r in ranked(spark.createDataFrame([(i,) for i in ids], "i long"), "i").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
