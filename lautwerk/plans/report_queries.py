"""Queries that train on words of page titles, and those of the sinks, with the SQL that gives the same rows.

Each distinct word is a set of three lects by rule: old is the word itself;
new has ɾ for l before a vowel; mid has p for b.  (Losses, chunks and tones are
in the tests' corpora: what a promoted chunk takes is no rule that SQL could state.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lautwerk.functions.features import features, is_syllabic, sonority
from lautwerk.operators import classes, contexts, counts, crossdim, pairwise, tables
from lautwerk.operators.graph import Scratch
from lautwerk.plans import render
from lautwerk.plans.queries import C_SQL, PREDICATES, intervals_sql, lines_of_x, query, r6, read, words_of_c
from lautwerk.plans.rule_queries import MIX
from lautwerk.sources import corpus


TITLE = "<title>([^<]*)</title>"


def title_words(spark: SparkSession, d: str) -> DataFrame:
    """``word``: the distinct words of ASCII letters of all page titles."""
    title = F.lower(F.regexp_extract("html", TITLE, 1))
    return read(spark, d, "pages", "html").select(F.explode(F.regexp_extract_all(title, F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()


def rule_forms(spark: SparkSession, d: str) -> DataFrame:
    word = F.col("word")
    forms = {"old": word, "new": F.regexp_replace(word, "l([aeiou])", "ɾ$1"), "mid": F.translate(word, "b", "p")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lect_id"), F.array_join(counts.letters(c), " ").alias("segments")) for k, c in forms.items()]))
    rows = title_words(spark, d).select(word.alias("cognate_id"), each.alias("f")).select("cognate_id", "f.*")
    return corpus.load_long(spark, frame=rows)


_TITLES = f"SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(html, '{TITLE}', 1)), '[a-z]+')) AS w FROM pages"
_RULE = f"""
  w0 AS (SELECT w AS id, w FROM ({_TITLES})), p0 AS (SELECT id, w, unnest(range(1, length(w) + 1)) AS i FROM w0),
  m AS (SELECT id, i, w[i] AS o, CASE WHEN w[i] = 'l' AND i < length(w) AND contains('aeiou', w[i + 1]) THEN 'ɾ' ELSE w[i] END AS n,
    CASE WHEN w[i] = 'b' THEN 'p' ELSE w[i] END AS d FROM p0)"""
_RULE_C = f"""
  w0 AS (SELECT p_partkey || '-' || k AS id, CASE k WHEN 'one' THEN one ELSE two END AS w FROM ({C_SQL}), (VALUES ('one'), ('two')) t(k)), p0 AS (SELECT id, w, unnest(range(1, length(w) + 1)) AS i FROM w0),
  m AS (SELECT id, i, w[i] AS o, CASE WHEN w[i] = 'l' AND i < length(w) AND contains('aeiou', w[i + 1]) THEN 'r' ELSE w[i] END AS n FROM p0)"""

_LETTER_SCORES = "(VALUES " + ", ".join(f"('{g}', {sonority(g)}, {str(is_syllabic(g)).lower()})" for g in "abcdefghijklmnopqrstuvwxyzɾ") + ") v(g, s, y)"

_MODELS: dict = {}


def _model(spark, d):
    """The model of a session and folder, trained once; its tables lie in the session's scratch folder."""
    from lautwerk.plans.train import train

    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = train(rule_forms(spark, d))
    return _MODELS[key]


@query()
def train_full(spark, d):
    """Conditioned classes, from loading to the verdict against permuted contexts."""
    return _model(spark, d).conditioned


@query(f"""
WITH {_RULE}, t AS (SELECT 'mid=' || d || ' ~ new=' || n || ' ~ old=' || o AS tuple, id FROM m), c AS (SELECT tuple, count(*) AS n, count(DISTINCT id) AS sets FROM t GROUP BY 1)
SELECT tuple, round(CAST(n AS DOUBLE), 6) AS count, CAST(sets AS BIGINT) AS sets, round(n / sum(n) OVER (), 6) AS rate, CAST(row_number() OVER (ORDER BY n DESC, tuple) - 1 AS BIGINT) AS class_id FROM c
""")
def train_classes(spark, d):
    """Classes of the trained model: what alignment and reconciliation find of the rules that made the corpus."""
    rows = _model(spark, d).classes
    return rows.select("tuple", r6("count").alias("count"), "sets", r6("rate").alias("rate"), "class_id")


_CLASSES = "SELECT 'own:' || id AS unit, 'mid=' || d || ' ~ new=' || n || ' ~ old=' || o AS tuple, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY 1, 2"


@query(f"WITH {_RULE}, {intervals_sql(_CLASSES, 'tuple', 200, 20260815)}")
def class_intervals(spark, d):
    """Intervals of the trained model's unconditioned classes when sets are drawn anew."""
    rows = _model(spark, d).intervals.where(~F.contains("tuple", F.lit(" / ")))
    return rows.select("tuple", r6("low").alias("low"), r6("high").alias("high"))


@query(f"""
WITH {_RULE}, f AS (SELECT id, 'old' AS lect, list(o ORDER BY i) AS gs FROM m GROUP BY 1 UNION ALL SELECT id, 'new', list(n ORDER BY i) FROM m GROUP BY 1 UNION ALL SELECT id, 'mid', list(d ORDER BY i) FROM m GROUP BY 1),
p AS (SELECT id, lect, i, s, y, lag(s) OVER w AS before, lead(s) OVER w AS after FROM (SELECT id, lect, unnest(gs) AS g, unnest(range(len(gs))) AS i FROM f) JOIN {_LETTER_SCORES} USING (g) WINDOW w AS (PARTITION BY id, lect ORDER BY i)),
w AS (SELECT id, lect, bool_or(s >= 6 OR y OR (s >= 4 AND (before IS NULL OR before < s) AND (after IS NULL OR after < s))) AS own FROM p GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS syllabified, CAST(count(*) FILTER (NOT own) AS BIGINT) AS inferred FROM w
""")
def syllable_fit(spark, d):
    """Forms of the training corpus that have syllables, and those whose nucleus is only their loudest segment."""
    return contexts.syllable_counts(_model(spark, d).sets)


@query()
def merged_classes(spark, d):
    """Conditioned classes of the trained model, of which what several lects' pivots found is one."""
    return _model(spark, d).merged


@query()
def shuffle_baseline(spark, d):
    """What training finds in two copies of the corpus whose forms are dealt anew: costs, numbers of classes, the margin that chance reaches."""
    from lautwerk.plans.train import Options, baseline, null_models

    return baseline(null_models(_model(spark, d).sets, 2, Options()))


@query(f"""
WITH {_RULE}, x AS (SELECT 'mid' AS a, 'new' AS b, d AS s, n AS t FROM m UNION ALL SELECT 'mid', 'old', d, o FROM m UNION ALL SELECT 'new', 'old', n, o FROM m),
c AS (SELECT a, b, s, t, CAST(count(*) AS DOUBLE) AS n FROM x WHERE s <> '∅' AND t <> '∅' GROUP BY 1, 2, 3, 4)
SELECT a AS lect_a, b AS lect_b, s AS source, t AS target, n AS count, sum(n) OVER (PARTITION BY a, b, s) AS source_total, sum(n) OVER (PARTITION BY a, b, t) AS target_total FROM c
""")
def train_segments(spark, d):
    """Counted correspondences of each pair of lects under the trained model."""
    return _model(spark, d).segments.select("lect_a", "lect_b", "source", "target", "count", "source_total", "target_total")


@query(f"""
WITH c AS ({C_SQL}), a AS (SELECT p_partkey, unnest(range(1, length(one) + 1)) AS i, one FROM c), b AS (SELECT p_partkey, unnest(range(1, length(two) + 1)) AS i, two FROM c),
k AS (SELECT coalesce(one[a.i], '∅') AS s, coalesce(two[b.i], '∅') AS t, CAST(count(*) AS DOUBLE) AS n FROM a FULL JOIN b ON a.p_partkey = b.p_partkey AND a.i = b.i GROUP BY 1, 2)
SELECT 'one' AS lect_a, 'two' AS lect_b, s AS source, t AS target, n AS count, CASE WHEN t = '∅' THEN (SELECT sum(n) FROM k x WHERE x.s = k.s) ELSE (SELECT sum(n) FROM k x WHERE x.t = k.t) END AS total FROM k WHERE s = '∅' OR t = '∅'
""")
def gap_counts(spark, d):
    """Losses and gains of positions bound one to one, against what has the kept segment, as training's table has them."""
    words = words_of_c(spark, d)
    seg = F.struct(F.col("g").alias("grapheme"))
    sides = [words.select("p_partkey", F.posexplode(counts.letters(F.col(c))).alias("i", "g")).select("p_partkey", "i", seg.alias(name)) for c, name in (("one", "source"), ("two", "target"))]
    met = sides[0].join(sides[1], ["p_partkey", "i"], "full").select(F.lit("one").alias("lect_a"), F.lit("two").alias("lect_b"), F.lit(1.0).alias("weight"), "source", "target")
    return tables.gap_rows(met).select("lect_a", "lect_b", "source", "target", "count", "total")


@query(f"WITH {_RULE} SELECT count(*) AS forms, count(DISTINCT id) AS sets, CAST(3 AS BIGINT) AS lects, CAST(3 * count(DISTINCT id) AS BIGINT) AS pairs FROM (SELECT id, l FROM w0, (VALUES (1), (2), (3)) t(l))")
def train_sizes(spark, d):
    """Forms, sets, lects and pairs that training sees."""
    model = _model(spark, d)
    one = model.sets.agg(F.count(F.lit(1)).alias("forms"), F.count_distinct("set_id").alias("sets"), F.count_distinct("lect_id").alias("lects"))
    return one.crossJoin(model.pairs.agg(F.count(F.lit(1)).alias("pairs")))


@query(f"""
WITH {_RULE}, t AS (SELECT id, 'mid=' || d || ' ~ new=' || n || ' ~ old=' || o AS tuple, i FROM m), c AS (SELECT tuple, row_number() OVER (ORDER BY count(*) DESC, tuple) - 1 AS class_id FROM t GROUP BY 1)
SELECT id AS set_id, i - 1 AS pos_a, i - 1 AS pos_b, CAST(class_id AS VARCHAR) AS class_ids FROM t JOIN c USING (tuple)
""")
def classes_at_positions(spark, d):
    """Which classes hold a position of old and the same one of mid."""
    model = _model(spark, d)
    at = render.class_positions(model.observations, model.classes)
    a = at.where("lect = 'mid'").select("set_id", F.col("lect").alias("lect_a"), F.col("pos").alias("pos_a"))
    pairs = a.join(at.where("lect = 'old'").select("set_id", F.col("lect").alias("lect_b"), F.col("pos").alias("pos_b")), "set_id").where("pos_a = pos_b")
    rows = render.classes_at(at, pairs)
    return rows.select("set_id", F.col("pos_a").cast("long").alias("pos_a"), F.col("pos_b").cast("long").alias("pos_b"), F.array_join(F.col("class_ids").cast("array<string>"), ",").alias("class_ids"))


@query(f"""
WITH {_RULE}, c AS (SELECT 'mid=' || d || ' ~ new=' || n || ' ~ old=' || o AS tuple, row_number() OVER (ORDER BY count(*) DESC, 'mid=' || d || ' ~ new=' || n || ' ~ old=' || o) - 1 AS class_id FROM m GROUP BY 1, d, n, o),
k AS (SELECT id, i, class_id FROM m JOIN c ON c.tuple = 'mid=' || d || ' ~ new=' || n || ' ~ old=' || o)
SELECT id AS set_id, string_agg((i - 1) || ',1,' || (i - 1) || ',1,' || class_id, ' ' ORDER BY i) AS links FROM k GROUP BY 1
""")
def alignment_export(spark, d):
    """Aligned pairs of mid and old with the classes of their links, read back from the exported lines."""
    model = _model(spark, d)
    out = render.alignments(model.links.where("lect_a = 'mid' and lect_b = 'old'"), render.class_positions(model.observations, model.classes))
    link = "struct<source_start:int,source_length:int,target_start:int,target_length:int,classes:array<bigint>>"
    rows = out.select(F.from_json("value", f"set_id string, links array<{link}>").alias("x")).select("x.*")
    text = F.transform("links", lambda l: F.concat_ws(",", l["source_start"], l["source_length"], l["target_start"], l["target_length"], F.array_join(l["classes"].cast("array<string>"), "+")))
    return rows.select("set_id", F.array_join(text, " ").alias("links"))


@query()
def evaluate_full(spark, d):
    """Held-out prediction of symbols of the same corpus."""
    from lautwerk.plans.evaluate import predictive as evaluate

    return evaluate(corpus.publish(rule_forms(spark, d)), 4)


@query()
def evaluate_trained(spark, d):
    """Scores of the five kinds of prediction of each fold of title words by models that were trained without it."""
    from lautwerk.plans.evaluate import FoldModels

    return FoldModels(corpus.publish(rule_forms(spark, d)), 3).scores()


@query(f"""
WITH {_RULE_C}, x AS (SELECT CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 5 AS fold, o AS s, n AS t FROM m), e AS (SELECT fold, s, t, count(*) AS here FROM x GROUP BY 1, 2, 3),
wh AS (SELECT s, t, sum(here) AS n FROM e GROUP BY 1, 2), f AS (SELECT DISTINCT fold, s FROM e), g AS (SELECT t, sum(here) AS tn FROM e GROUP BY 1), h AS (SELECT fold, t, sum(here) AS th FROM e GROUP BY 1, 2),
gr AS (SELECT f.fold, f.s, g.t, tn - coalesce(th, 0) AS tn, coalesce(wh.n, 0) - coalesce(e.here, 0) AS n, e.here FROM f CROSS JOIN g LEFT JOIN h ON h.fold = f.fold AND h.t = g.t LEFT JOIN wh ON wh.s = f.s AND wh.t = g.t LEFT JOIN e ON e.fold = f.fold AND e.s = f.s AND e.t = g.t WHERE tn - coalesce(th, 0) > 0),
p AS (SELECT *, (n + 1.0) / (sum(n) OVER b + count(*) OVER b + 1) AS u, (tn + 1.0) / (sum(tn) OVER b + count(*) OVER b + 1) AS i FROM gr WINDOW b AS (PARTITION BY fold, s))
SELECT CAST(sum(here) AS BIGINT) AS n, round(sum(-here * ln(u)) / sum(here), 6) AS unconditioned, round(sum(-here * ln(i)) / sum(here), 6) AS inventory FROM p WHERE here IS NOT NULL
""")
def held_out_loss(spark, d):
    """Log loss of held-out symbols by what other folds say of their source, and by how often they occur."""
    from lautwerk.plans.evaluate import held_out

    words = words_of_c(spark, d).select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("word")) for k in ("one", "two")])).alias("w"))
    rows = words.select(F.concat_ws("-", F.col("p_partkey").cast("string"), "w.k").alias("id"), F.posexplode(counts.letters(F.col("w.word"))).alias("i", "source"), F.col("w.word").alias("w"))
    last, after = F.col("i") == F.length("w") - 1, F.substring("w", F.col("i") + 2, F.lit(1))
    target = F.when((F.col("source") == "l") & ~last & after.isin(*"aeiou"), "r").otherwise(F.col("source"))
    fold = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("long") % 5
    scored = held_out(rows.select(F.lit("old>new").alias("pair"), fold.alias("fold"), "source", target.alias("target"))).where("place is not null")
    loss = lambda k: (F.sum(F.when(F.col("kind") == k, -F.col("observed") * F.ln("p"))) / F.sum(F.when(F.col("kind") == k, F.col("observed"))))
    return scored.agg(F.sum(F.when(F.col("kind") == "inventory", F.col("observed"))).alias("n"), *[r6(loss(k)).alias(k) for k in ("unconditioned", "inventory")])


_TOKENS = {n: f"{'preceding' if k % 2 else 'following'}:{n}=+" for k, n in enumerate(PREDICATES)}


def _search_sql() -> str:
    longs = " UNION ALL ".join(f"SELECT l_returnflag AS pv, '{_TOKENS[n]}' AS token, ({p}) AS holds, {MIX} AS a, l_linestatus AS b, hash(lineitem) AS h FROM lineitem" for n, p in PREDICATES.items())
    x = lambda v: f"CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END"
    score = f"2 * (({x('sum(i)')} - sum({x('i')})) + ({x('sum(t - i)')} - sum({x('(t - i)')})) - ({x('sum(t)')} - sum({x('t')}))) + (count(*) - 1) * ln(sum(t))"
    one = lambda c: f"SELECT pv, token, sum(i) AS n_in, sum(t - i) AS n_out, count(*) AS k, {score} AS delta FROM (SELECT pv, token, {c}, count(*) FILTER (holds) AS i, count(*) AS t FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2"
    return f"""
WITH r AS ({longs}), s AS (SELECT * FROM ({one('a')}) WHERE k > 1 UNION ALL SELECT * FROM ({one('b')}) WHERE k > 1),
mk AS (SELECT pv, token, least(string_agg(CASE WHEN holds THEN '1' ELSE '0' END, '' ORDER BY h), string_agg(CASE WHEN holds THEN '0' ELSE '1' END, '' ORDER BY h)) AS mark FROM r GROUP BY 1, 2 HAVING bool_or(holds) AND NOT bool_and(holds)),
m AS (SELECT pv, count(DISTINCT mark) AS m FROM mk GROUP BY 1),
d AS (SELECT pv, token, min(n_in) AS n_in, min(n_out) AS n_out, sum(delta) + CASE WHEN any_value(m) > 1 THEN 2 * ln(any_value(m)) ELSE 0 END AS delta FROM s JOIN m USING (pv) GROUP BY 1, 2 HAVING min(n_in) >= 3 AND min(n_out) >= 3),
w AS (SELECT * FROM d WHERE delta < 0 QUALIFY row_number() OVER (PARTITION BY pv ORDER BY round(delta, 9), n_in, token) = 1),
c AS (SELECT r.pv, token, 'a=' || a || ' b=' || b AS outcome, count(*) FILTER (holds) AS n, count(*) FILTER (NOT holds) AS o, any_value(delta) AS delta, any_value(n_in) AS n_in, any_value(n_out) AS n_out FROM r JOIN w USING (pv, token) GROUP BY 1, 2, 3)
SELECT pv AS pivot, token AS environment, outcome, CAST(n AS DOUBLE) AS count, round(n / n_in, 6) AS rate, round(o / n_out, 6) AS contrast_rate, round(-delta, 3) AS margin FROM c
WHERE n >= greatest(2, ceil(0.5 * log2(n_in + n_out + 1))) AND n / n_in > o / n_out"""


@query(_search_sql())
def class_search(spark, d):
    """The first decision of each pivot by the search that training runs: predicates of X as an environment, two sister outcomes."""
    x = lines_of_x(spark, d)
    tokens = F.array_sort(F.array_compact(F.array(*[F.when(F.expr(p), F.lit(_TOKENS[n])) for n, p in PREDICATES.items()])))
    sisters = F.array(F.struct(F.lit("a").alias("lect"), F.expr(MIX).alias("grapheme")), F.struct(F.lit("b").alias("lect"), F.col("l_linestatus").alias("grapheme")))
    rows = x.select(F.lit("x").alias("pivot_lect"), F.col("l_returnflag").alias("pivot"), tokens.alias("tokens"), sisters.alias("sisters"), F.lit(1.0).alias("weight"))
    out = classes.searched(rows, 0, depth=1, commits=1)
    return out.select("pivot", "environment", "outcome", "count", r6("rate").alias("rate"), r6("contrast_rate").alias("contrast_rate"), F.round("margin", 3).alias("margin"))


# --- rules in the costs of alignment, and what conditions a tone


#: Counts of a model of two lects, and its rules for l ~ ɾ: side, tokens, count; the most specific one that holds counts.
_COUNTED = {**{(g, g): 40.0 for g in "abcdefghijklmnopqrstuvwxyz"}, ("l", "ɾ"): 30.0}
_FOLLOWED = [("source", ["following:vowel=+"], 24.0), ("source", ["following:vowel=+", "position:initial"], 3.0), ("target", ["preceding:vowel=+"], 12.0)]


def _said() -> pairwise.Pairwise:
    alpha, log_z = pairwise.prior(sorted({x for pair in _COUNTED for x in pair}))
    moves: dict = {}
    for (s, t), n in sorted(_COUNTED.items()):
        moves[pairwise.move(s, t)] = moves.get(pairwise.move(s, t), 0.0) + n
    return pairwise.Pairwise(dict(_COUNTED), alpha, log_z, moves, {})


def _followed_sql() -> str:
    m = _said()
    names = sorted(m.log_z)
    known = ", ".join(f"('{a}{b}', {m.one(a, b)!r})" for a in names for b in names)
    plain, initial, after = (m.under_rule("l", "ɾ", n) for _, _, n in _FOLLOWED)
    vowel = lambda word, k: f"({k} BETWEEN 1 AND length({word}) AND contains('aeiouy', {word}[CAST({k} AS INT)]))"
    rule = f"CASE WHEN w[i + 1] || v[j] <> 'lɾ' THEN NULL WHEN i = 0 AND {vowel('w', 'i + 2')} THEN {initial!r} WHEN {vowel('w', 'i + 2')} THEN {plain!r} WHEN {vowel('v', 'j - 1')} THEN {after!r} END"
    first = f"list_transform(range(0, length(v) + 1), lambda j: least(line[j + 1] + 0.5, CASE WHEN j > 0 THEN line[j] + coalesce({rule}, costs[w[i + 1] || v[j]]) END))"
    return f"""
WITH RECURSIVE c AS (SELECT map_from_entries(list((a, b))) AS costs FROM (VALUES {known}) t(a, b)),
p AS (SELECT w, regexp_replace(regexp_replace(w, 'l([aeiou])', 'ɾ\\1', 'g'), 'lɾ', 'ɾ', 'g') AS v FROM ({_TITLES})),
d AS (SELECT w, v, CAST(0 AS BIGINT) AS i, list_transform(range(0, length(v) + 1), lambda j: CAST(0.5 * j AS DOUBLE)) AS line FROM p
  UNION ALL
  SELECT w, v, i + 1, list_transform(range(1, len(a) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda k: a[k] + 0.5 * (j - k)))) FROM (SELECT w, v, i, {first} AS a FROM d, c WHERE i < length(w)))
SELECT w AS set_id, CAST(length(v) AS INT) AS b_len, round(line[length(v) + 1], 6) AS cost FROM d WHERE i = length(w)
"""


@query(_followed_sql())
def rule_costs(spark, d):
    """Alignments whose costs follow conditioned rules: words of titles with ɾ for l before a vowel, where an l before ɾ is lost, under a model with rules of both sides."""
    word = F.col("word")
    new = F.regexp_replace(F.regexp_replace(word, "l([aeiou])", "ɾ$1"), "lɾ", "ɾ")
    segment = lambda g: F.struct(g.alias("grapheme"), *[F.lit("").alias(x) for x in ("tone", "length", "stress")])
    none = F.array().cast("array<int>")
    each = F.explode(F.array(F.struct(F.lit("old").alias("lect_id"), word.alias("form")), F.struct(F.lit("xnew").alias("lect_id"), new.alias("form"))))
    sets = title_words(spark, d).select(word.alias("set_id"), each.alias("f")).select("set_id", "f.lect_id", F.lit(1.0).alias("confidence"), F.transform(counts.letters(F.col("f.form")), segment).alias("segments"), none.alias("breaks"), none.alias("syllables"))
    m = _said()
    rows = [("old", "xnew", s, t, n, 0.0, 0.0, "segment") for (s, t), n in m.counts.items()] + [("old", "xnew", g, g, 0.0, 0.0, 0.0, "inventory") for g in m.log_z]
    models = spark.createDataFrame(rows, "lect_a string, lect_b string, source string, target string, count double, source_total double, cost double, kind string")
    told = [("old", "xnew", side, "l" if side == "source" else "ɾ", "ɾ" if side == "source" else "l", tokens, n, k) for k, (side, tokens, n) in enumerate(_FOLLOWED)]
    rules = spark.createDataFrame(told, "lect_a string, lect_b string, side string, pivot string, partner string, tokens array<string>, count double, decision long")
    scratch = Scratch(spark, "rules")
    sets = scratch.keep(sets, "sets")
    name = F.xxhash64("segments", "breaks", "syllables").alias("word")
    places = sets.select("lect_id", name, F.posexplode("segments.grapheme").alias("pos", "grapheme")).distinct()
    held = scratch.keep(pairwise.holding(rules, pairwise.word_environments(sets), places), "held")
    out = pairwise.aligned(pairwise.form_pairs(sets), 1, models, held, reorder=False)
    return out.select("set_id", "b_len", r6("cost").alias("cost"))


_VOICELESS = "".join(g for g in "abcdefghijklmnopqrstuvwxyz" if "voiceless" in features(g))


@query(f"""
WITH p AS (SELECT w, unnest(range(2, length(w) + 1)) AS i FROM ({_TITLES})), v AS (SELECT CASE WHEN contains('{_VOICELESS}', w[i - 1]) THEN '⁵' ELSE '²' END AS tone FROM p WHERE contains('aeiou', w[i])),
n AS (SELECT tone, count(*) AS n FROM v GROUP BY 1)
SELECT t AS context_is_target, t AS lect_internal, 'preceding:voiced=' || CASE tone WHEN '²' THEN '+' ELSE '-' END AS environment, tone AS value, CAST(n AS DOUBLE) AS count, CAST(n AS DOUBLE) AS total,
  CAST(0 AS DOUBLE) AS contrast_count, CAST((SELECT sum(n) FROM n o WHERE o.tone <> n.tone) AS DOUBLE) AS contrast_total FROM n, (VALUES (true), (false)) t(t)
""")
def cross_found(spark, d):
    """All passes of the cross-dimensional search over words of titles, whose vowels are low after something voiced in one of two lects: found across the lects and within the toned one."""
    vowel = lambda g: g.isin(*"aeiou")
    letters = counts.letters(F.col("word"))
    tone = lambda g, k: F.when(~vowel(g) | (k == 0), "").when(F.element_at("l", F.greatest(k, F.lit(1))).isin(*_VOICELESS), "⁵").otherwise("²")
    seg = lambda toned: F.transform("l", lambda g, k: F.struct(g.alias("grapheme"), (tone(g, k) if toned else F.lit("")).alias("tone"), F.lit("").alias("length"), F.lit("").alias("stress")))
    words = title_words(spark, d).select(letters.alias("l")).select(seg(False).alias("plain"), seg(True).alias("toned"))
    words = words.select("*", F.xxhash64("plain").alias("a_word"), F.xxhash64("toned", F.lit(1)).alias("b_word"))
    at = lambda c: F.element_at(c, F.col("k") + 1)
    each = words.select("*", F.explode(F.sequence(F.lit(0), F.size("plain") - 1)).alias("k"))
    singles = each.select(F.lit("plain").alias("lect_a"), F.lit("toned").alias("lect_b"), F.lit(1.0).alias("weight"), "a_word", F.col("k").alias("a_pos"), at("plain").alias("a_seg"), "b_word", F.col("k").alias("b_pos"), at("toned").alias("b_seg"))
    forms = words.select(F.col("a_word").alias("word"), F.col("plain").alias("form")).unionByName(words.select(F.col("b_word").alias("word"), F.col("toned").alias("form")))
    found = crossdim.discovered(crossdim.contexts_of(singles, forms))
    return found.select("context_is_target", "lect_internal", "environment", "value", "count", "total", "contrast_count", "contrast_total")


# --- cross-dimensional tables and sinks


_BOUND = f"SELECT p_partkey AS id, one[1] AS s, two[1] AS t, CASE WHEN p_size % 3 = 0 OR contains('aeiou', two[2]) THEN '5' ELSE '2' END AS tone FROM ({C_SQL}) JOIN part USING (p_partkey)"


def _bound(spark, d) -> DataFrame:
    """First letters of the words of part names as bound positions; the target has a tone."""
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size"), "p_partkey")
    tone = F.when((F.col("p_size") % 3 == 0) | F.substring("two", 2, 1).isin(*"aeiou"), "5").otherwise("2")
    seg = lambda c, t: F.struct(F.substring(c, 1, 1).alias("grapheme"), t.alias("tone"), F.lit("").alias("length"), F.lit("").alias("stress"))
    return words.select(F.lit("one").alias("lect_a"), F.lit("two").alias("lect_b"), F.col("p_partkey").alias("set_id"), F.lit(1.0).alias("weight"), seg("one", F.lit("")).alias("source"), seg("two", tone).alias("target"))


@query(f"SELECT 'one' AS lect_a, 'two' AS lect_b, '' AS source_tone, tone AS target_tone, CAST(count(*) AS DOUBLE) AS count FROM ({_BOUND}) GROUP BY tone")
def tonal_counts(spark, d):
    return tables.tonal_counts(_bound(spark, d))


def _xdim_sql() -> str:
    from lautwerk.plans.corpus_queries import FEATURES_SQL

    x = lambda v: f"CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END"
    code = lambda h, t: f"({x(t)} - {x(h)} - {x(f'({t} - {h})')})"
    return f"""
WITH b AS ({_BOUND}), v AS (SELECT tone, count(*) AS vm FROM b GROUP BY 1), n AS (SELECT count(*) AS n FROM b),
h AS (SELECT feature, tone, count(*) AS a FROM b JOIN {FEATURES_SQL} ON b.t = f.g GROUP BY 1, 2), i AS (SELECT *, sum(a) OVER (PARTITION BY feature) AS ins FROM h),
r AS (SELECT feature, tone, CAST(a AS DOUBLE) AS a, CAST(ins AS DOUBLE) AS i, CAST(vm - a AS DOUBLE) AS c, CAST(n - ins AS DOUBLE) AS o FROM i JOIN v USING (tone), n WHERE n > ins),
d AS (SELECT *, 2 * ({code('a', 'i')} + {code('c', 'o')} - {code('(a + c)', '(i + o)')}) + ln(i + o) AS delta FROM r)
SELECT feature, tone AS value, a AS count, i AS total, round(a / i, 6) AS rate, c AS contrast_count, round(c / o, 6) AS contrast_rate, round(delta, 3) AS delta FROM d WHERE a >= 3 AND a / i > c / o AND delta < 0"""


@query(_xdim_sql())
def xdim(spark, d):
    """Features of a segment that raise its own tone, as training's table has them."""
    rows = tables.dimension_rules(_bound(spark, d), "tone", context_is_target=True, lect_internal=True)
    return rows.select("feature", "value", "count", "total", r6("rate").alias("rate"), "contrast_count", r6("contrast_rate").alias("contrast_rate"), F.round("delta", 3).alias("delta"))


_SEGS = f"WITH b AS ({_BOUND}), c AS (SELECT s, t, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY s) AS st FROM c), z AS (SELECT *, n / st AS p, 1.959963984540054 AS z FROM w)"


def _segments(spark, d) -> DataFrame:
    rows = _bound(spark, d).select("lect_a", "lect_b", F.col("source.grapheme").alias("source"), F.col("target.grapheme").alias("target"), "weight")
    return counts.pair_counts(rows, F.col("weight"), ["lect_a", "lect_b"])


@query(f"""{_SEGS}
SELECT 'SEG' || chr(9) || 'one>two' || chr(9) || s || chr(9) || t || chr(9) || '-' || chr(9) || printf('%.6f', n) || chr(9) || '[' ||
  printf('%.4f', greatest(0, (p + z*z/(2*st)) / (1 + z*z/st) - z / (1 + z*z/st) * sqrt(p*(1-p)/st + z*z/(4.0*st*st)))) || ',' || printf('%.4f', least(1, (p + z*z/(2*st)) / (1 + z*z/st) + z / (1 + z*z/st) * sqrt(p*(1-p)/st + z*z/(4.0*st*st)))) || ']' || chr(9) || 'wilson' AS value FROM z
UNION ALL SELECT 'TONE' || chr(9) || 'one>two' || chr(9) || '>' || tone || chr(9) || printf('%.6f', CAST(count(*) AS DOUBLE)) FROM b GROUP BY tone
""")
def pair_tables(spark, d):
    """SEG and TONE lines of a pair of lects."""
    return render.pair_tables(_segments(spark, d), tones=tables.tonal_counts(_bound(spark, d)))


@query(f"""{_SEGS}, k AS (SELECT *, n < 8 AND n / st < 0.25 AS weak FROM w), o AS (SELECT *, row_number() OVER (ORDER BY weak, n DESC, s, t) AS place FROM k)
SELECT 'one' AS lect_a, 'two' AS lect_b, CAST(place AS INTEGER) AS place, s || ' ~ ' || t || '  ' || printf('%.1f', n) || ' of ' || printf('%.1f', st) || ' (' || printf('%.0f', 100 * n / st) || '%)' || CASE WHEN weak THEN '  weak' ELSE '' END AS value FROM o WHERE place <= 15
""")
def pair_report(spark, d):
    """The fifteen commonest correspondences for people to read, weak ones last."""
    return render.pair_report(_segments(spark, d))


@query(f"""
WITH {_RULE}, t AS (SELECT id, 'mid=' || d || ' ~ new=' || n || ' ~ old=' || o AS tuple FROM m), c AS (SELECT tuple, count(*) AS n, count(DISTINCT id) AS sets FROM t GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, tuple) - 1 AS class_id, n / sum(n) OVER () AS rate FROM c)
SELECT 'LECTS' || chr(9) || 'mid new old' AS value UNION ALL SELECT 'UNCOND' || chr(9) || class_id || chr(9) || replace(replace(tuple, ' ~ ', '|'), '=', ':') || chr(9) || printf('%.6f', CAST(n AS DOUBLE)) || chr(9) || printf('%.6f', rate) || chr(9) || sets FROM k
""")
def summary_lines(spark, d):
    """Lines of the lects and of the trained classes."""
    model = _model(spark, d)
    return render.lect_line(model.sets).unionByName(render.class_lines(model.classes, "UNCOND")).select("value")


@query("""
WITH t AS (SELECT p_type, p_brand || '|' || min(p_size) AS label, count(*) AS n FROM part GROUP BY p_type, p_brand)
SELECT CAST(0 AS BIGINT) AS place, '| p_type | label | n |' AS value UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL
SELECT row_number() OVER (ORDER BY n DESC, p_type, label) + 1, '| ' || p_type || ' | ' || replace(label, '|', '\\|') || ' | ' || n || ' |' FROM t
""")
def markdown_table(spark, d):
    t = read(spark, d, "part", "p_type", "p_brand", "p_size").groupBy("p_type", "p_brand").agg(F.concat_ws("|", F.first("p_brand"), F.min("p_size").cast("string")).alias("label"), F.count(F.lit(1)).alias("n"))
    return render.markdown(t.select("p_type", "label", "n"), [F.desc("n"), "p_type", "label"])


@query("SELECT p_brand, p_type, p_name || ', \"' || p_size || '\"' AS note FROM part WHERE p_size > 45")
def csv_export(spark, d):
    """A table written as CSV and read back."""
    path = f"{Scratch(spark, 'csv').base}/table"
    render.to_csv(read(spark, d, "part", "p_brand", "p_type", "p_name", "p_size").where("p_size > 45").select("p_brand", "p_type", F.expr("concat(p_name, ', \"', p_size, '\"')").alias("note")), path)
    return corpus.read_table(spark, path, sep=",")


@query("SELECT CAST(json_object('source', l_returnflag, 'target', l_linestatus, 'n', count(*)) AS VARCHAR) AS value FROM lineitem GROUP BY l_returnflag, l_linestatus")
def json_lines(spark, d):
    rows = lines_of_x(spark, d).groupBy(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return render.as_json(rows)


_TOKEN_SETS = {"a": ["preceding:vowel=+", "position:initial", "preceding:high=-"], "b": [], "c": ["following:nasal=+"]}


@query("SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'position=initial,preceding=high=-+vowel=+' WHEN 'N' THEN '-' ELSE 'following=nasal=+' END AS key, count(*) AS n FROM lineitem GROUP BY 1")
def environment_keys(spark, d):
    """Canonical keys of environments: slots in order, their features sorted."""
    arr = lambda ts: F.array(*[F.lit(t) for t in ts]).cast("array<string>")
    tokens = F.when(F.col("l_returnflag") == "A", arr(_TOKEN_SETS["a"])).when(F.col("l_returnflag") == "N", arr(_TOKEN_SETS["b"])).otherwise(arr(_TOKEN_SETS["c"]))
    rows = lines_of_x(spark, d).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("l_returnflag", render.environment_key(tokens).alias("key"), "n")


@query("""
WITH r AS (SELECT p_brand AS id, string_agg(p_type, ' ' ORDER BY p_partkey) AS w, min(p_size) / 100.0 AS conf FROM part GROUP BY 1),
s AS (SELECT CAST('0x' || substr(md5(id || '|x|' || w || '|' || CAST(conf AS DOUBLE) || '|'), 1, 13) AS HUGEINT) AS v FROM r)
SELECT printf('%x', CAST(sum(v) % 2305843009213693952 AS BIGINT)) AS checksum, count(*) AS forms FROM s
""")
def corpus_checksum(spark, d):
    """An order-free checksum of a corpus, to which equal rows add up."""
    from lautwerk.plans.train import checksum

    p = read(spark, d, "part", "p_brand", "p_type", "p_partkey", "p_size").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("x"), (F.min("p_size") / 100.0).alias("confidence"))
    sets = p.select(F.col("p_brand").alias("set_id"), F.lit("x").alias("lect_id"), F.transform("x", lambda s: F.struct(s["p_type"].alias("grapheme"))).alias("segments"), "confidence", F.lit("").alias("etymon_group"))
    return checksum(sets)


@query(f"SELECT one, two, CAST(length(one) AS BIGINT) AS a, CAST(length(two) AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n FROM ({C_SQL}) GROUP BY 1, 2")
def align_conservation(spark, d):
    """Every symbol of either side stands in one link of the span alignment."""
    from lautwerk.functions.features import distance
    from lautwerk.operators.alignment import align_pairs, prior_costs

    pairs = words_of_c(spark, d).groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.select("one", "two", "n", counts.letters(F.col("one")).alias("source"), counts.letters(F.col("two")).alias("target"))
    out = align_pairs(pairs, prior_costs(distance, tier=pairwise.chunk_tier))
    mass = lambda f: F.aggregate("links", F.lit(0).cast("long"), lambda a, l: a + l[f])
    return out.select("one", "two", mass("s_len").alias("a"), mass("t_len").alias("b"), "n")
