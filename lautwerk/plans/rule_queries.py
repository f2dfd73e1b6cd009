"""Queries of split search, classes, cross-dimensional rules, chunks, translation, prediction, events, drift and notation, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lautwerk.functions import features as phon
from lautwerk.operators import chunks, contexts, counts, crossdim, events, prediction, splits, translation
from lautwerk.plans import notation as lines
from lautwerk.plans.corpus_queries import FEATURES_SQL, WORDS_SQL, phon_distances, vocabulary_words
from lautwerk.plans.queries import BAND, C_SQL, PREDICATES, SQL, _LONG, _MARKS, _scores_sql, _with_identity, lines_of_x, predicates, query, r6, read, words_of_c

#: Slots of the predicates of X, and tiers by which one of several equal ones is named.
SLOTS = {"linestatus_o": "status", "quantity_25": "amount", "discount_5": "price", "tax_4": "price", "first_line": "place", "not_first_line": "place", "dear": "price", "many_lines": "place"}
#: An outcome that several predicates condition.
MIX = "CASE WHEN l_quantity * l_discount >= 1.5 THEN 'much' WHEN l_tax * l_quantity >= 1 THEN 'some' ELSE 'little' END"
_BANDS = _LONG.replace("l_returnflag AS outcome", f"{MIX} AS outcome")
_SLOT_SQL = "CASE predicate " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in SLOTS.items()) + " END"

_PART_PREDICATES = {"large": "p_size >= 25", "odd": "p_size % 2 = 1", "dear": "p_retailprice >= 950", "ring": "p_name LIKE '%ring'"}


def _part_scores_sql(body: str) -> str:
    longs = " UNION ALL ".join(f"SELECT p_brand, '{n}' AS predicate, p_type AS outcome, ({p}) AS holds FROM part" for n, p in _PART_PREDICATES.items())
    return f"""
WITH c AS (SELECT p_brand, predicate, outcome, CAST(count(*) FILTER (holds) AS DOUBLE) AS i, CAST(count(*) AS DOUBLE) AS t FROM ({longs}) GROUP BY 1, 2, 3),
w AS (SELECT *, t - i AS o, count(*) OVER g AS k, sum(i) OVER g AS ni, sum(t - i) OVER g AS no, sum(t) OVER g AS n FROM c WINDOW g AS (PARTITION BY p_brand, predicate)){body}"""


def _gamma_code(m: str, n: str) -> str:
    a = f"({n} / k)"
    return f"(CASE WHEN any_value({n}) > 0 THEN lgamma(any_value({n}) * 2) - lgamma(any_value({n})) - sum(CASE WHEN {n} > 0 THEN lgamma({m} + {a}) - lgamma({a}) ELSE 0 END) ELSE 0 END)"


@query(_part_scores_sql(f" SELECT p_brand, predicate, round(2 * ({_gamma_code('i', 'ni')} + {_gamma_code('o', 'no')} - {_gamma_code('t', 'n')}), 3) AS delta FROM w GROUP BY 1, 2"))
def split_dirichlet(spark, d):
    """Splits of part types by brand, scored under a symmetric prior."""
    rows = splits.scores(splits.masses(_parts(spark, d), "p_type", {k: F.expr(v) for k, v in _PART_PREDICATES.items()}, ["p_brand"]), ["p_brand"], scorer="dirichlet")
    return rows.select("p_brand", "predicate", F.round("delta", 3).alias("delta"))


def _parts(spark, d) -> DataFrame:
    return read(spark, d, "part", "p_brand", "p_type", "p_size", "p_retailprice", "p_name", "p_partkey")


_XLX = lambda v: f"(CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END)"
_NML_BODY = f""",
sides AS (SELECT p_brand, predicate, k, side, any_value(n) AS n, sum({_XLX('m')}) AS x FROM (
  SELECT p_brand, predicate, k, 1 AS side, ni AS n, i AS m FROM w UNION ALL SELECT p_brand, predicate, k, 1, no, o FROM w WHERE false UNION ALL
  SELECT p_brand, predicate, k, 2, no, o FROM w UNION ALL SELECT p_brand, predicate, k, 3, n, t FROM w) GROUP BY 1, 2, 3, 4),
ns AS (SELECT DISTINCT CAST(n AS BIGINT) AS n FROM sides WHERE n > 0), h AS (SELECT n, unnest(range(0, n + 1)) AS h FROM ns),
c2 AS (SELECT n, sum(exp(lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1) + {_XLX('h')} + {_XLX('(n - h)')} - n * ln(n))) AS c2 FROM h GROUP BY n),
c3 AS (SELECT n, c2, c2 + n / 1.0 AS c3 FROM c2), c4 AS (SELECT *, c3 + n / 2.0 * c2 AS c4 FROM c3), c5 AS (SELECT *, c4 + n / 3.0 * c3 AS c5 FROM c4), c6 AS (SELECT *, c5 + n / 4.0 * c4 AS c6 FROM c5),
cost AS (SELECT p_brand, predicate, side, {_XLX('s.n')} - x + coalesce(CASE k WHEN 2 THEN ln(c2) WHEN 3 THEN ln(c3) WHEN 4 THEN ln(c4) WHEN 5 THEN ln(c5) WHEN 6 THEN ln(c6) ELSE 0 END, 0) AS y FROM sides s LEFT JOIN c6 ON c6.n = s.n)
SELECT p_brand, predicate, round(2 * sum(CASE WHEN side = 3 THEN -y ELSE y END), 3) AS delta FROM cost GROUP BY 1, 2"""


@query(_part_scores_sql(_NML_BODY))
def split_nml(spark, d):
    """The same splits by normalised maximum likelihood."""
    rows = splits.scores(splits.masses(_parts(spark, d), "p_type", {k: F.expr(v) for k, v in _PART_PREDICATES.items()}, ["p_brand"]), ["p_brand"], scorer="nml")
    return rows.select("p_brand", "predicate", F.round("delta", 3).alias("delta"))


@query(f"""
WITH s AS ({_scores_sql(_BANDS)}), m AS ({_MARKS}), c AS (SELECT 2 * ln(count(DISTINCT mark)) AS charge FROM m),
r AS (SELECT s.predicate, s.place, -(delta + charge) AS margin, mark, {_SLOT_SQL.replace('predicate', 's.predicate', 1)} AS slot FROM s JOIN m ON s.predicate = m.predicate, c WHERE n_in >= 3 AND n_out >= 3),
w AS (SELECT * FROM r WHERE margin > 0 ORDER BY round(-margin, 9), place LIMIT 1),
o AS (SELECT r.*, w.predicate AS winner, row_number() OVER (PARTITION BY r.mark ORDER BY r.place) AS k FROM r, w WHERE r.margin > 0 AND r.slot <> w.slot AND r.mark <> w.mark)
SELECT winner, predicate AS rival, round(margin, 4) AS margin FROM o WHERE k = 1 QUALIFY row_number() OVER (ORDER BY round(margin, 9) DESC, place) <= 8
""")
def near_rivals(spark, d):
    x = lines_of_x(spark, d).withColumn("band", F.expr(MIX))
    marks = splits.partition_marks(_with_identity(x.drop("band")), "identity", predicates())
    rows = splits.near_rivals(splits.scores(splits.masses(x, "band", predicates())), marks, SLOTS, order=list(PREDICATES))
    return rows.select("winner", "rival", F.round("margin", 4).alias("margin"))


@query(f"""
WITH a AS (SELECT 'x' AS g, predicate, {_SLOT_SQL} AS slot, count(*) FILTER (holds) AS matches FROM ({_LONG}) GROUP BY 2),
t AS (SELECT *, CASE WHEN predicate IN ('first_line') THEN 0 WHEN predicate IN ('quantity_25') THEN 1 ELSE 2 END AS tier FROM a)
SELECT predicate, CAST(tier AS INTEGER) AS tier, CAST(matches AS BIGINT) AS matches FROM t WHERE slot = 'price' OR tier < 2 ORDER BY tier, matches LIMIT 1
""")
def relabelled_split(spark, d):
    """Which of several predicates of one division names it, were all alike: a lower tier, else the slot's own of fewest matches."""
    x = lines_of_x(spark, d)
    one = x.agg(*[F.count_if(p).alias(k) for k, p in predicates().items()])
    matches = one.select(F.explode(F.create_map(*[y for k in PREDICATES for y in (F.lit(k), F.col(k))])).alias("predicate", "matches"))
    marks = matches.select("predicate", F.lit("same").alias("mark"), F.lit(1).alias("side"))
    return splits.relabelled("dear", marks, matches, SLOTS, {"first_line": 0, "quantity_25": 1}, list(PREDICATES))


@query(f"""
WITH c AS (SELECT l_returnflag AS source, l_linestatus AS target, l_linenumber % 3 AS env, l_suppkey % 4 AS decision, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT source, target, CAST(env AS INTEGER) AS env, CAST(min(decision) AS BIGINT) AS decision, CAST(arg_max(n, decision) AS BIGINT) AS n FROM c GROUP BY 1, 2, 3
""")
def commit_rules(spark, d):
    """A repeated rule takes the later count and keeps the earlier decision."""
    c = read(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
    c = c.groupBy(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"), (F.col("l_linenumber") % 3).cast("int").alias("env"), (F.col("l_suppkey") % 4).cast("long").alias("decision")).agg(F.count(F.lit(1)).alias("n"))
    return splits.commit(c, ["source", "target", "env"])


@query(f"""
WITH a AS ({SQL['decision_list']}), b AS ({SQL['decision_list'].replace(BAND, MIX)}),
u AS (SELECT 'source' AS side, * FROM a UNION ALL SELECT 'target', * FROM b)
SELECT side, predicate, outcome, min(decision) AS decision, arg_max(count, decision) AS count, arg_max(delta, decision) AS delta FROM u GROUP BY 1, 2, 3
""")
def both_sides(spark, d):
    """Decision lists of two outcomes over the same observations, committed together."""
    x = _with_identity(lines_of_x(spark, d)).withColumns({"band": F.expr(BAND), "mix": F.expr(MIX)})
    rows = splits.both_sides(x, {"source": "band", "target": "mix"}, {"source": predicates(), "target": predicates()}, "identity")
    return rows.select("side", "predicate", "outcome", "decision", "count", F.round("delta", 4).alias("delta"))


_SPLIT_ROWS = " UNION ALL ".join(f"SELECT l_returnflag AS key, CAST({k} AS BIGINT) AS decision, l_suppkey AS obs FROM lineitem WHERE {w}" for k, w in enumerate(("l_linestatus = 'O'", "l_linestatus = 'O' AND l_quantity >= 25", "l_quantity >= 49 AND l_discount >= 0.09", "l_quantity = 50 AND l_discount >= 0.1 AND l_tax >= 0.07")))


@query(f"""
WITH s AS (SELECT DISTINCT * FROM ({_SPLIT_ROWS})), n AS (SELECT key, decision, count(*) AS n FROM s GROUP BY 1, 2),
h AS (SELECT a.key, a.decision, b.decision AS o, count(*) AS m FROM s a JOIN s b ON a.key = b.key AND a.obs = b.obs AND b.decision < a.decision GROUP BY 1, 2, 3),
w AS (SELECT key, decision, min(o) AS o FROM h JOIN n USING (key, decision) WHERE m = n GROUP BY 1, 2)
SELECT key, decision, coalesce(o, decision) AS "into" FROM n LEFT JOIN w USING (key, decision)
""")
def merged_splits(spark, d):
    """Splits whose observations an earlier one of the same key holds go into it."""
    x = lines_of_x(spark, d)
    tests = ("l_linestatus = 'O'", "l_linestatus = 'O' AND l_quantity >= 25", "l_quantity >= 49 AND l_discount >= 0.09", "l_quantity = 50 AND l_discount >= 0.1 AND l_tax >= 0.07")
    each = F.explode(F.array_compact(F.array(*[F.when(F.expr(t), F.lit(k).cast("long")) for k, t in enumerate(tests)])))
    return splits.merged(x.select(F.col("l_returnflag").alias("key"), each.alias("decision"), F.col("l_suppkey").alias("obs")))


@query("""
WITH c AS (SELECT l_returnflag AS sister, count(*) FILTER (l_quantity >= 25) AS a, count(*) FILTER (l_quantity < 25) AS c FROM lineitem GROUP BY 1),
w AS (SELECT sum(a) AS inside, sum(c) AS ct, arg_min(sister, (-c, sister)) AS complement FROM c)
SELECT sister, CAST(a AS BIGINT) AS count, CAST(inside AS BIGINT) AS inside, round(a / inside, 6) AS rate, complement, CAST(c AS BIGINT) AS contrast_count, CAST(ct AS BIGINT) AS contrast_total
FROM c, w WHERE a >= greatest(2, ceil(0.5 * log2(inside + 1)))
""")
def emitted_classes(spark, d):
    """Classes of a committed split with their contrast and the commonest outcome outside."""
    rows = splits.emitted(lines_of_x(spark, d), F.col("l_quantity") >= 25, "l_returnflag")
    return rows.withColumn("rate", r6("rate"))


@query("""
WITH t AS (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS tuple, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT tuple, CAST(count(*) AS BIGINT) AS sets, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY first, o_custkey) AS supporting FROM t GROUP BY 1
""")
def supporting_sets(spark, d):
    """The sets that support each class, distinct, in the order of the corpus."""
    t = read(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderkey").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("tuple"), F.min("o_orderkey").alias("first"))
    return counts.supporting(t, "tuple", "o_custkey", "first")


# --- cross-dimensional


_XD = {"status=O": "l_linestatus = 'O'", "price=+": "l_extendedprice >= 30000", "discount=+": "CASE WHEN l_quantity < 49 THEN l_discount >= 0.05 END", "tax=+": "l_tax >= 0.04"}
_XD_NEG = {**_XD, **{crossdim.negated(k): f"NOT ({v})" for k, v in _XD.items()}}


@query("""
WITH c AS (SELECT l_returnflag AS value, count(*) FILTER (l_extendedprice >= 30000) AS a, count(*) FILTER (l_extendedprice < 30000) AS c FROM lineitem GROUP BY 1),
w AS (SELECT *, sum(a) OVER () AS ni, sum(c) OVER () AS no FROM c),
x AS (SELECT *, """ + " ".join(f"CASE WHEN {e} > 0 THEN {e} * ln({e}) ELSE 0 END AS {n}," for n, e in {"x1": "ni", "x2": "a", "x3": "(ni - a)", "x4": "no", "x5": "c", "x6": "(no - c)", "x7": "(ni + no)", "x8": "(a + c)", "x9": "(ni + no - a - c)"}.items()) + """ 1 AS one FROM w)
SELECT value, CAST(a AS BIGINT) AS count, CAST(c AS BIGINT) AS contrast_count, round(2 * ((x1 - x2 - x3) + (x4 - x5 - x6) - (x7 - x8 - x9)) + ln(ni + no), 4) AS delta FROM x
""")
def xdim_values(spark, d):
    """Two-by-two scores of the values that an environment may raise."""
    from pyspark.sql import Window

    c = lines_of_x(spark, d).groupBy(F.col("l_returnflag").alias("value")).agg(F.count_if(F.col("l_extendedprice") >= 30000).alias("count"), F.count_if(F.col("l_extendedprice") < 30000).alias("contrast_count"))
    w = Window.partitionBy()
    delta = crossdim.value_delta(F.col("count"), F.sum("count").over(w), F.col("contrast_count"), F.sum("contrast_count").over(w))
    return c.select("value", "count", "contrast_count", F.round(delta, 4).alias("delta"))


def _xdim_single_sql(preds: dict[str, str]) -> str:
    longs = " UNION ALL ".join(f"SELECT '{n}' AS predicate, {k} AS place, l_returnflag AS outcome, ({p}) AS holds FROM lineitem" for k, (n, p) in enumerate(preds.items()))
    x = lambda v: f"CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END"
    return f"""
  SELECT predicate, place, sum(i) AS n_in, sum(t - i) AS n_out, 2 * (({x('sum(i)')} - sum({x('i')})) + ({x('sum(t - i)')} - sum({x('(t - i)')})) - ({x('sum(t)')} - sum({x('t')}))) + (count(*) - 1) * ln(sum(t)) AS delta
  FROM (SELECT predicate, place, outcome, count(*) FILTER (holds) AS i, count(*) AS t FROM ({longs}) WHERE holds IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(f"SELECT predicate, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, round(delta, 4) AS delta FROM ({_xdim_single_sql(_XD_NEG)}) ORDER BY round(delta, 9), predicate LIMIT 5")
def xdim_singles(spark, d):
    """The best predicates and negations, each over the rows where it is defined."""
    rows = crossdim.singles(lines_of_x(spark, d), "l_returnflag", {k: F.expr(v) for k, v in _XD_NEG.items()}, 5)
    return rows.select("predicate", "n_in", "n_out", F.round("delta", 4).alias("delta"))


@query("""
WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'vowel=+' WHEN o_orderstatus = 'O' THEN 'tone=2' ELSE 'tone=2;vowel=-' END AS environment, o_orderpriority AS pair, o_custkey % 7 AS lect, CAST(count(*) AS BIGINT) AS total FROM orders GROUP BY 1, 2, 3)
SELECT environment, CAST(lect AS BIGINT) AS lect, arg_max(pair, (total, -ascii(pair))) AS pair, max(total) AS total FROM s WHERE environment <> 'tone=2' GROUP BY 1, 2
""")
def xdim_lifted(spark, d):
    """Rules of one lect found by several pairs, the one of the largest mass; those that only restate the dimension aren't published."""
    kind = F.when(F.col("o_orderstatus") == "F", "vowel=+").when(F.col("o_orderstatus") == "O", "tone=2").otherwise("tone=2;vowel=-")
    rows = read(spark, d, "orders", "o_orderstatus", "o_orderpriority", "o_custkey").groupBy(kind.alias("environment"), F.col("o_orderpriority").alias("pair"), (F.col("o_custkey") % 7).cast("long").alias("lect")).agg(F.count(F.lit(1)).alias("total"))
    return crossdim.lifted(rows.where(crossdim.publishable(F.col("environment"), "tone")), ["environment", "lect"])


@query()
def xdim_search(spark, d):
    """The whole search: environments of an outcome that several predicates condition, best first."""
    rows = crossdim.search(lines_of_x(spark, d).withColumn("mix", F.expr(MIX)), "mix", {k: F.expr(v) for k, v in _XD_NEG.items()})
    return rows.withColumn("delta", F.round("delta", 4))


# --- chunks


def _pieces(spark, d) -> DataFrame:
    """Spans of part names: the first letters of the one word and of the other, one to three of each, with what a positional decomposition gives."""
    words = words_of_c(spark, d).select("one", "two").distinct()
    spans = words.select(F.explode(F.expr("flatten(transform(sequence(1, 3), k -> transform(sequence(1, 3), l -> struct(substring(one, 1, k) AS s, substring(two, 1, l) AS t))))")).alias("x")).select("x.*").distinct()
    return spans.select("s", "t", counts.letters(F.col("s")).alias("source"), counts.letters(F.col("t")).alias("target"))


_PIECES = f"""
  wd AS (SELECT DISTINCT one, two FROM ({C_SQL})), sp AS (SELECT DISTINCT one[1:k] AS s, two[1:l] AS t FROM wd, range(1, 4) a(k), range(1, 4) b(l) WHERE length(one) >= k AND length(two) >= l),
  fe AS (SELECT g, list(feature) AS fs FROM {FEATURES_SQL} GROUP BY 1)"""


@query(f"""
WITH {_PIECES}, o AS (SELECT a.s, a.t, count(DISTINCT (b.s, b.t)) AS n FROM sp a JOIN sp b ON contains(a.s, b.s) AND contains(a.t, b.t) AND (length(b.s) < length(a.s) OR length(b.t) < length(a.t)) GROUP BY 1, 2)
SELECT s, t, CAST(coalesce(n, 0) AS BIGINT) AS overlaps FROM sp LEFT JOIN o USING (s, t)
""")
def chunk_overlaps(spark, d):
    """Chunks that lie within each chunk."""
    rows = chunks.overlaps(_pieces(spark, d))
    return rows.select(F.array_join("source", "").alias("s"), F.array_join("target", "").alias("t"), "overlaps")


def _decomposed(spark, d) -> DataFrame:
    rows = _pieces(spark, d)
    dims = contexts.described(rows.select(F.explode(F.concat("source", "target")).alias("grapheme")))
    known = F.map_from_entries(F.collect_list(F.struct("grapheme", "features")))
    rows = rows.crossJoin(F.broadcast(dims.agg(known.alias("known"))))
    both = F.least(F.size("source"), F.size("target"))
    same = F.size(F.filter(F.zip_with(F.slice("source", F.lit(1), both), F.slice("target", F.lit(1), both), lambda a, b: a == b), lambda x: x))
    changed = F.element_at(F.filter(F.zip_with(F.slice("source", F.lit(1), both), F.slice("target", F.lit(1), both), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"]), 1)
    longer = F.when(F.size("source") > F.size("target"), F.col("source")).otherwise(F.col("target"))
    rows = rows.withColumns({"identity": same, "changed": both - same, "deletions": F.greatest(F.size("source") - F.size("target"), F.lit(0)), "insertions": F.greatest(F.size("target") - F.size("source"), F.lit(0)), "c": F.try_element_at(F.filter(F.zip_with(F.slice("source", F.lit(1), both), F.slice("target", F.lit(1), both), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"]), F.lit(1)), "gone": F.try_element_at(longer, both + 1)})
    look = lambda g: F.element_at("known", g)
    return rows.withColumns({"process": chunks.process(F.col("identity"), F.col("changed"), F.col("deletions"), F.col("insertions"), look(F.col("c.a")), look(F.col("c.b")), look(F.col("gone")))})


_DECOMPOSED = f"""{_PIECES},
  de AS (SELECT s, t, least(length(s), length(t)) AS m, length(s) AS sl, length(t) AS tl, len(list_filter(range(1, least(length(s), length(t)) + 1), lambda i: s[i] = t[i])) AS same,
         list_filter(range(1, least(length(s), length(t)) + 1), lambda i: s[i] <> t[i])[1] AS ci, CASE WHEN length(s) > length(t) THEN s ELSE t END AS lg FROM sp),
  dd AS (SELECT *, m - same AS ch, greatest(sl - tl, 0) AS del, greatest(tl - sl, 0) AS ins, s[ci] AS ca, t[ci] AS cb, CASE WHEN m < length(lg) THEN lg[m + 1] END AS gone FROM de),
  pr AS (SELECT dd.*, CASE WHEN ch = 1 AND del + ins = 1 AND (list_contains(coalesce(fa.fs, []), 'approximant') OR list_contains(coalesce(fb.fs, []), 'approximant')) THEN 'glide_or_vocalization_fusion'
    WHEN ch = 1 AND del + ins = 1 AND m + del + ins <= 2 THEN 'compact_fusion' WHEN same = 1 AND del + ins = 1 AND m + del + ins <= 2 THEN 'residual_reduction'
    WHEN del > 0 AND ins > 0 AND m <= 1 THEN 'balanced_restructuring' WHEN m + del + ins >= 3 AND del + ins > 0 AND m > 0 THEN 'bundled_reduction' ELSE 'mixed_or_unclear' END AS process
    FROM dd LEFT JOIN fe fa ON fa.g = ca LEFT JOIN fe fb ON fb.g = cb)"""


@query(f"WITH {_DECOMPOSED} SELECT s, t, process FROM pr")
def chunk_processes(spark, d):
    return _decomposed(spark, d).select("s", "t", "process")


_SHIFT = "CASE process " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in chunks.PROCESS_SHIFT.items()) + " ELSE 0 END"


@query(f"""
WITH {_DECOMPOSED}, ov AS (SELECT s, t, "overlaps" AS ovl FROM ({SQL['chunk_overlaps']})),
x AS (SELECT *, sl + tl AS total, abs(sl - tl) AS apart, del + ins AS gaps, (del + ins) / (m + del + ins) AS ratio FROM pr JOIN ov USING (s, t))
SELECT s, t, round(greatest(0, least(1, 1.0 - 0.18 * apart - 0.24 * ratio - 0.14 * greatest(total - 3, 0) - 0.09 * least(ovl, 3) / 3.0
  - CASE WHEN total >= 5 AND apart > 0 THEN 0.1 ELSE 0 END - CASE WHEN del >= 2 THEN 0.1 ELSE 0 END - CASE WHEN ins >= 2 THEN 0.1 ELSE 0 END
  - CASE WHEN del > 0 AND ins = 0 AND apart > 0 THEN 0.1 ELSE 0 END - CASE WHEN ins > 0 AND del = 0 AND apart > 0 THEN 0.1 ELSE 0 END
  + CASE WHEN total <= 4 AND apart = 1 AND m = 1 AND gaps = 1 AND ch = 1 THEN 0.08 ELSE 0 END + CASE WHEN total <= 4 AND apart = 1 AND m = 1 AND gaps = 1 AND same = 1 THEN 0.03 ELSE 0 END
  + CASE WHEN apart = 0 AND del > 0 AND ins > 0 THEN 0.12 ELSE 0 END + CASE WHEN m >= 2 AND apart <= 1 THEN 0.05 ELSE 0 END
  + CASE WHEN apart = 0 AND ratio = 0 AND total <= 4 THEN 0.08 WHEN total <= 4 AND apart <= 1 THEN 0.05 ELSE 0 END + {_SHIFT})), 6) AS score FROM x
""")
def chunk_transparency(spark, d):
    rows = _decomposed(spark, d).join(chunks.overlaps(_pieces(spark, d)), ["source", "target"])
    gaps = F.col("deletions") + F.col("insertions")
    links = F.col("identity") + F.col("changed") + gaps
    score = chunks.transparency(F.size("source"), F.size("target"), F.col("identity"), F.col("changed"), F.col("deletions"), F.col("insertions"), gaps, links, F.col("overlaps"), F.col("process"))
    return rows.select("s", "t", r6(score).alias("score"))


@query(f"""
WITH {_PIECES}, m AS (SELECT s, t, length(s) AS sl, length(t) AS tl, len(list_filter(string_split(s, ''), lambda c: contains('aeiou', c))) AS sv, len(list_filter(string_split(t, ''), lambda c: contains('aeiou', c))) AS tv,
  regexp_matches(s, '[mn]') AS sn, regexp_matches(t, '[mn]') AS tn FROM sp)
SELECT s, t, CAST(CASE WHEN sv = sl AND tv = tl AND sl <> tl THEN 0 WHEN sv = 0 AND tv = 0 AND sl <> tl AND sn AND tn THEN 0 WHEN (sv = sl AND tv = tl) OR (sv = 0 AND tv = 0) THEN 2 ELSE 4 END AS DOUBLE) AS tier FROM m
""")
def chunk_tiers(spark, d):
    rows = _pieces(spark, d)
    dims = contexts.described(rows.select(F.explode(F.concat("source", "target")).alias("grapheme")))
    rows = rows.crossJoin(F.broadcast(dims.agg(F.map_from_entries(F.collect_list(F.struct("grapheme", "features"))).alias("known"))))
    fs = lambda c: F.transform(c, lambda g: F.element_at("known", g))
    vowels = lambda c: F.size(F.filter(fs(c), lambda f: F.array_contains(f, "vowel")))
    return rows.select("s", "t", chunks.tier(F.size("source"), F.size("target"), vowels("source"), vowels("target"), F.flatten(fs("source")), F.flatten(fs("target"))).alias("tier"))


# --- translation tables


def _em_ctes(a: str, b: str, tag: str, rounds: int) -> list[str]:
    out = [
        f"c{tag} AS (SELECT one, two, {a} AS x, {b} AS y, count(*) AS w FROM ({C_SQL}) GROUP BY 1, 2)",
        f"s{tag} AS (SELECT one, two, y, w, unnest(list_concat(['∅'], list_filter(string_split(x, ''), lambda z: z <> ''))) AS s FROM c{tag})",
        f"e{tag} AS (SELECT one, two, y, w, s, unnest(range(1, length(y) + 1)) AS j FROM s{tag})",
        f"l{tag} AS (SELECT one, two, w, s, j, y[j] AS t FROM e{tag})",
        f"p{tag}0 AS (SELECT s, t, 1.0 / count(*) OVER (PARTITION BY s) AS p FROM (SELECT DISTINCT s, t FROM l{tag}))",
    ]
    for k in range(rounds):
        out.append(f"m{tag}{k} AS (SELECT s, t, w * p / sum(p) OVER (PARTITION BY one, two, j) AS share FROM l{tag} JOIN p{tag}{k} USING (s, t))")
        out.append(f"p{tag}{k + 1} AS (SELECT s, t, sum(share) / sum(sum(share)) OVER (PARTITION BY s) AS p FROM m{tag}{k} GROUP BY s, t)")
    return out


_BOTH_EM = ", ".join(_em_ctes("one", "two", "f", 2) + _em_ctes("two", "one", "b", 2))
_SYM = "SELECT f.s, f.t, sqrt(f.p * b.p) AS p FROM pf2 f JOIN pb2 b ON f.s = b.t AND f.t = b.s WHERE f.p * b.p > 0"


def _em_pairs(spark, d) -> DataFrame:
    pairs = words_of_c(spark, d).groupBy("one", "two").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return pairs.select(F.concat_ws("|", "one", "two").alias("pair"), F.concat(F.array(F.lit(translation.NULL)), counts.letters(F.col("one"))).alias("source"), counts.letters(F.col("two")).alias("target"), "weight")


def _symmetric(spark, d) -> tuple[DataFrame, DataFrame]:
    pairs = _em_pairs(spark, d)
    return pairs, translation.symmetric(translation.train(pairs, 2), translation.train(translation.reversed_pairs(pairs), 2))


@query(f"WITH {_BOTH_EM} SELECT s, t, round(p, 6) AS p FROM ({_SYM})")
def ibm1_symmetric(spark, d):
    """Both directions trained, and their geometric mean."""
    return _symmetric(spark, d)[1].select("s", "t", r6("p").alias("p"))


_BEST = f"""
  y AS ({_SYM}), i AS (SELECT one, two, unnest(range(1, length(one) + 1)) AS i FROM cf), ij AS (SELECT one, two, i, unnest(range(1, length(two) + 1)) AS j FROM i),
  g AS (SELECT ij.one, ij.two, i, j, one[i] AS s, two[j] AS t, p FROM ij JOIN y ON y.s = one[i] AND y.t = two[j]),
  best AS (SELECT one, two, i, s, arg_max({{'j': j, 't': t, 'p': p}}, (round(p, 12), -j)) AS b FROM g GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_BOTH_EM}, {_BEST} SELECT one || '|' || two AS pair, CAST(i AS INTEGER) AS i, s, CAST(b.j - 1 AS INTEGER) AS j, b.t AS t, round(b.p, 6) AS p FROM best")
def ibm1_links(spark, d):
    """For each source place the target place of the largest probability."""
    return translation.best_links(*_symmetric(spark, d)).withColumn("p", r6("p"))


@query(f"WITH {_BOTH_EM}, {_BEST} SELECT one || '|' || two AS pair, round(sum(ln(b.p)) / length(one), 6) AS score FROM best GROUP BY one, two")
def ibm1_scores(spark, d):
    return translation.pair_scores(*_symmetric(spark, d)).withColumn("score", r6("score"))


_GRID = f"WITH c AS ({C_SQL}), v AS (SELECT DISTINCT unnest(string_split(one || two, '')) AS x FROM c), g AS (SELECT a.x AS a, b.x AS b, abs(ord(a.x) - ord(b.x)) / 25.0 AS d FROM v a, v b)"


def _grid(spark, d) -> DataFrame:
    v = words_of_c(spark, d).select(F.explode(F.array_union(counts.letters(F.col("one")), counts.letters(F.col("two")))).alias("a")).distinct()
    return v.crossJoin(F.broadcast(v.withColumnRenamed("a", "b"))).withColumn("d", F.abs(F.ascii("a") - F.ascii("b")) / 25.0)


@query(f"{_GRID} SELECT a AS s, b AS t, round(exp(-d) / (sum(exp(-d)) OVER (PARTITION BY a) + exp(-0.5)), 6) AS p FROM g")
def ibm1_prior(spark, d):
    return translation.prior_table(_grid(spark, d)).withColumn("p", r6("p"))


@query(f"""
{_GRID}, {_BOTH_EM}, q AS (SELECT a, b, 5 * exp(-d) / sum(exp(-d)) OVER (PARTITION BY a) AS alpha FROM g)
SELECT a, b, round(coalesce(5 * p, alpha), 6) AS alpha, CAST(0 AS DOUBLE) AS log_z FROM q LEFT JOIN pf2 ON pf2.s = a AND pf2.t = b
""")
def ibm1_seeded(spark, d):
    """A prior whose alphas come from a trained table."""
    return translation.seeded(translation.softmax_prior(_grid(spark, d)), translation.train(_em_pairs(spark, d), 2)).withColumn("alpha", r6("alpha"))


@query(f"WITH {', '.join(_em_ctes('one', 'two', 'f', 2))}, z AS (SELECT one, two, j, any_value(w) AS w, sum(p) AS p FROM lf JOIN pf2 USING (s, t) GROUP BY 1, 2, 3) SELECT round(sum(w * ln(p)), 3) AS log_likelihood FROM z")
def ibm1_likelihood(spark, d):
    pairs = _em_pairs(spark, d)
    return translation.log_likelihood(pairs, translation.train(pairs, 2)).select(F.round("log_likelihood", 3).alias("log_likelihood"))


# --- prediction


_POS = f"SELECT p_partkey, one[1] AS source, two[1] AS target, CASE WHEN contains('aeiou', one[2]) THEN 'v' ELSE 'c' END AS env FROM ({C_SQL})"


def _first_letters(spark, d) -> DataFrame:
    return words_of_c(spark, d).select("p_partkey", F.substring("one", 1, 1).alias("source"), F.substring("two", 1, 1).alias("target"), F.when(F.substring("one", 2, 1).isin(*"aeiou"), "v").otherwise("c").alias("env"))


_KINDS = f"""
  x AS ({_POS}), tr AS (SELECT * FROM x WHERE p_partkey % 5 <> 0), cd AS (SELECT * FROM tr WHERE env = 'v'),
  so AS (SELECT DISTINCT env, source FROM x), tg AS (SELECT target, count(*) AS tn FROM tr GROUP BY 1 UNION ALL SELECT '?', 0),
  gr AS (SELECT so.env, so.source, tg.target, tn, coalesce((SELECT count(*) FROM tr WHERE tr.source = so.source AND tr.target = tg.target), 0) AS n,
         coalesce((SELECT count(*) FROM cd WHERE cd.env = so.env AND cd.source = so.source AND cd.target = tg.target), 0) AS m, (so.env, so.source) IN (SELECT (env, source) FROM cd) AS fires FROM so, tg),
  ds AS (SELECT a, b, d FROM ({SQL['segment_distance'].replace('round(', '(').replace(', 6) AS d', ') AS d')})),
  ra AS (SELECT gr.*, exp(-coalesce(d, 1)) AS fe FROM gr LEFT JOIN ds ON ds.a = gr.source AND ds.b = gr.target),
  ks AS (SELECT 'conditioned' AS kind, env, source, target, CAST(1 + CASE WHEN fires THEN m ELSE n END AS DOUBLE) AS mass FROM ra UNION ALL SELECT 'unconditioned', env, source, target, 1 + n FROM ra
         UNION ALL SELECT 'identity', env, source, target, CASE WHEN source = target THEN 1 ELSE 1e-6 END FROM ra UNION ALL SELECT 'inventory', env, source, target, tn + 1 FROM ra UNION ALL SELECT 'feature', env, source, target, fe FROM ra),
  pk AS (SELECT kind, env, source, target, mass / sum(mass) OVER (PARTITION BY kind, env, source) AS p FROM ks)"""


def _kinds(spark, d) -> DataFrame:
    x = _first_letters(spark, d)
    train = x.where("p_partkey % 5 <> 0")
    distances = phon_distances(contexts.described(vocabulary_words(spark, d).select(F.explode("graphemes").alias("grapheme"))))
    return prediction.distributions(train.select("source", "target"), train.where("env = 'v'").select("env", "source", "target"), x.select("env", "source").distinct(), distances)


@query(f"WITH {_KINDS} SELECT kind, env, source, target, round(p, 6) AS p FROM pk")
def prediction_kinds(spark, d):
    """The five kinds of prediction of a first letter from another, with and without its environment."""
    return _kinds(spark, d).withColumn("p", r6("p"))


@query(f"""
WITH {_KINDS}, g AS (SELECT source, target, exp(avg(ln(p))) AS g, count(DISTINCT kind) AS k FROM pk WHERE env = 'v' AND kind IN ('conditioned', 'feature', 'inventory') GROUP BY 1, 2 HAVING count(DISTINCT kind) >= 2)
SELECT source, target, round(g / sum(g) OVER (PARTITION BY source), 6) AS p FROM g
""")
def prediction_pooled(spark, d):
    """Predictors pooled by their geometric mean, as for a lect that is left out."""
    rows = _kinds(spark, d).where("env = 'v' and kind in ('conditioned', 'feature', 'inventory')")
    return prediction.pooled(rows.select("source", F.col("kind").alias("predictor"), "target", "p"), ["source"]).withColumn("p", r6("p"))


@query(f"SELECT DISTINCT target FROM ({_POS}) WHERE env = 'v' AND p_partkey % 3 = 0 UNION SELECT target FROM ({_POS}) WHERE env = 'c' AND p_partkey % 3 = 1")
def prediction_inventory(spark, d):
    """Targets of two directions' training, each once."""
    x = _first_letters(spark, d)
    sides = [prediction.target_inventory(x.where(w)) for w in ("env = 'v' and p_partkey % 3 = 0", "env = 'c' and p_partkey % 3 = 1")]
    return prediction.united_inventory(sides)


@query(f"""
WITH x AS ({_POS}), fu AS (SELECT source, target, count(*) AS n FROM x GROUP BY 1, 2),
fo AS (SELECT source, target, p_partkey % 5 AS fold, count(*) AS observed, (count(*) % 7 - 3) / 10.0 AS gain FROM x WHERE p_partkey % 11 < 4 GROUP BY 1, 2, 3),
h AS (SELECT source, target, count(DISTINCT fold) AS folds, sum(observed) AS held, sum(observed * gain) AS s FROM fo GROUP BY 1, 2)
SELECT source, target, CAST(n AS BIGINT) AS n, CAST(coalesce(folds, 0) AS BIGINT) AS folds, CAST(coalesce(held, 0) AS BIGINT) AS held_out, round(s / held, 6) AS gain,
  CASE WHEN folds >= 2 AND held >= 8 AND s / held > 0 THEN 'confirmed' WHEN folds IS NULL THEN 'not_evaluated' ELSE 'not_confirmed' END AS verdict FROM fu LEFT JOIN h USING (source, target)
""")
def confirmed_rules(spark, d):
    """Rules of the whole corpus matched with those found without a fold, and their verdict."""
    x = _first_letters(spark, d)
    full = x.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    folds = x.where("p_partkey % 11 < 4").groupBy("source", "target", (F.col("p_partkey") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("observed"))
    folds = folds.withColumn("gain", (F.col("observed") % 7 - 3) / 10.0)
    return prediction.confirmed(full, folds, ["source", "target"]).withColumn("gain", r6("gain"))


# --- events, drift, notation


@query("""
WITH c AS (SELECT p_brand AS lect, p_type AS outcome, p_size % 3 AS slot, count(*) AS n FROM part GROUP BY 1, 2, 3),
k AS (SELECT *, max(n) OVER (PARTITION BY lect, slot) AS top FROM c)
SELECT lect, outcome, CAST(slot AS INTEGER) AS slot, CAST(n AS BIGINT) AS count, n = top AS leads, (lead_weak) AS weak FROM (SELECT *, (n < 8 AND n / top < 0.25) OR (top - n > n) AS lead_weak FROM k)
""")
def leading_classes(spark, d):
    """Whether a class leads its lect and slot, and whether it is weak beside the leader."""
    c = _parts(spark, d).groupBy(F.col("p_brand").alias("lect"), F.col("p_type").alias("outcome"), (F.col("p_size") % 3).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("count"))
    rows = events.leading(c, ["lect", "slot"])
    from pyspark.sql import Window

    top = F.max("count").over(Window.partitionBy("lect", "slot"))
    rows = rows.withColumn("top", top)
    return rows.select("lect", "outcome", "slot", "count", "leads", events.is_weak(F.col("count"), F.col("count") / F.col("top"), F.col("top") - F.col("count")).alias("weak"))


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size = 50)
SELECT p_brand, p_type, CAST(n AS BIGINT) AS n, (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM k) AS has FROM c
""")
def conditioned_counterparts(spark, d):
    """Classes that have a conditioned counterpart, and those that have none."""
    c = _parts(spark, d).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    with_, without = events.without_conditioned(c, _parts(spark, d).where("p_size = 50"), ["p_brand", "p_type"])
    return with_.withColumn("has", F.lit(True)).unionByName(without.withColumn("has", F.lit(False)))


@query(f"""
WITH w AS (SELECT DISTINCT one AS grp, unnest(list_distinct(string_split(one, ''))) AS g FROM ({C_SQL}) UNION SELECT 'beginnings', one[1] FROM ({C_SQL}) UNION SELECT 'vowels', unnest(['a', 'e', 'i', 'o', 'u']) UNION SELECT 'close', unnest(['i', 'u'])),
iv AS (SELECT DISTINCT g FROM (SELECT unnest(string_split(word, '')) AS g FROM ({WORDS_SQL}))), fe AS (SELECT iv.g, feature FROM iv JOIN {FEATURES_SQL} ON iv.g = f.g),
m AS (SELECT grp, count(*) AS m FROM w GROUP BY 1), co AS (SELECT grp, feature, any_value(m) AS m FROM w JOIN fe USING (g) JOIN m USING (grp) GROUP BY 1, 2 HAVING count(*) = any_value(m)),
t AS (SELECT feature, count(*) AS k FROM fe GROUP BY 1), one_f AS (SELECT grp, min(feature) AS name FROM co JOIN t USING (feature) WHERE k = m GROUP BY 1),
b AS (SELECT x.feature AS f, y.feature AS h, count(*) AS k FROM fe x JOIN fe y USING (g) GROUP BY 1, 2),
two AS (SELECT a.grp, min(a.feature || '+' || c.feature) AS pair FROM co a JOIN co c ON a.grp = c.grp AND a.feature < c.feature JOIN b ON b.f = a.feature AND b.h = c.feature WHERE k = a.m GROUP BY 1)
SELECT coalesce(one_f.grp, two.grp) AS "group", coalesce(name, pair) AS name FROM one_f FULL JOIN two ON one_f.grp = two.grp
""")
def natural_classes(spark, d):
    """Features that name a set of letters among all letters of the corpus."""
    words = words_of_c(spark, d)
    members = words.select(F.col("one").alias("group"), F.explode(counts.letters(F.col("one"))).alias("grapheme"))
    members = members.unionByName(words.select(F.lit("beginnings").alias("group"), F.substring("one", 1, 1).alias("grapheme")))
    for name, letters in (("vowels", "aeiou"), ("close", "iu")):
        members = members.unionByName(words.limit(1).select(F.lit(name).alias("group"), F.explode(F.array(*[F.lit(c) for c in letters])).alias("grapheme")))
    inventory = contexts.described(vocabulary_words(spark, d).select(F.explode("graphemes").alias("grapheme"))).select("grapheme", "features")
    return events.natural_class(members.distinct(), inventory)


@query("""
WITH m AS (SELECT p_brand AS lect, p_type AS grp, two, count(*) AS n, sum(p_size) / 100 AS margin, min(p_retailprice) AS delta, min(p_partkey) AS id FROM (SELECT *, split_part(p_name, ' ', 2) AS two FROM part) GROUP BY 1, 2, 3),
g AS (SELECT lect, grp, string_agg(DISTINCT two, ',' ORDER BY two) AS inputs, CAST(sum(n) AS BIGINT) AS count, round(min(margin), 4) AS margin, max(delta) AS delta, min(id) AS first_id, count(*) AS members FROM m GROUP BY 1, 2)
SELECT lect, grp, inputs, count, margin, round(delta, 4) AS delta, first_id, members, row_number() OVER (ORDER BY count DESC, first_id) AS rank FROM g
""")
def built_events(spark, d):
    """Events of groups: members, pooled count, the weakest evidence, in order of count."""
    m = _parts(spark, d).groupBy(F.col("p_brand").alias("lect"), F.col("p_type").alias("grp"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("input")).agg(F.count(F.lit(1)).alias("count"), (F.sum("p_size") / 100).alias("margin"), F.min("p_retailprice").alias("delta"), F.min("p_partkey").alias("class_id"))
    rows = events.built(m.withColumn("outcome", F.col("input")), ["lect", "grp"])
    return rows.select("lect", "grp", "inputs", "count", F.round("margin", 4).alias("margin"), F.round("delta", 4).alias("delta"), "first_id", "members", "rank")


@query("""
WITH c AS (SELECT p_type AS class_id, list_distinct(list(p_brand)) AS ls FROM part WHERE p_size > 47 GROUP BY 1), w AS (SELECT p_brand, bool_or(p_size % 5 = 0) AS written FROM part GROUP BY 1)
SELECT class_id, bool_and(written) AS in_scope FROM (SELECT class_id, unnest(ls) AS p_brand FROM c) JOIN w USING (p_brand) GROUP BY 1
""")
def scope_of_dimension(spark, d):
    """A dimension counts for a class where all of its lects write it somewhere."""
    p = _parts(spark, d)
    forms = p.select(F.col("p_brand").alias("lect_id"), F.array(F.struct(F.when(F.expr("p_size % 5 = 0"), "5").otherwise("").alias("tone"))).alias("segments"))
    classes = p.where("p_size > 47").groupBy(F.col("p_type").alias("class_id")).agg(F.collect_set("p_brand").alias("lects"))
    return events.in_scope(classes, events.scope(forms, "tone")).select("class_id", "in_scope")


_DRIFT = f"""
  f AS (SELECT p_partkey, p_brand AS lect, CASE WHEN p_size % 3 = 0 THEN [one[1] || 'ʰ', one[2] || 'ː', two[1]] ELSE [one[1], 'h', one[2], one[2], two[1]] END AS w FROM ({C_SQL}) JOIN part USING (p_partkey) WHERE NOT (p_brand IN ('Brand#2', 'Brand#4') AND p_size % 3 = 0)),
  u AS (SELECT lect, g, count(*) AS forms FROM (SELECT lect, unnest(list_distinct(w)) AS g FROM f) GROUP BY 1, 2),
  c AS (SELECT DISTINCT g, g[1:length(g) - 1] AS base, CASE WHEN g LIKE '%ʰ' THEN 'modifier' ELSE 'length' END AS kind FROM u WHERE g LIKE '%ʰ' OR g LIKE '%ː'),
  r AS (SELECT lect, a, b, count(*) AS n FROM (SELECT DISTINCT p_partkey, lect, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM f)) GROUP BY 1, 2, 3),
  x AS (SELECT u.lect, r.lect AS other, u.g, kind, a || ' ' || b AS pieces, u.forms, r.n AS corroborated FROM u JOIN c USING (g) JOIN r ON r.a = base AND r.b = CASE kind WHEN 'modifier' THEN 'h' ELSE base END WHERE u.lect <> r.lect AND NOT EXISTS (SELECT 1 FROM u o WHERE o.lect = r.lect AND o.g = u.g))"""


def _drifts(spark, d) -> DataFrame:
    from lautwerk.operators import drift

    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size", "p_brand"), "p_partkey").where("not (p_brand in ('Brand#2', 'Brand#4') and p_size % 3 = 0)")
    a, b, t = F.substring("one", 1, 1), F.substring("one", 2, 1), F.substring("two", 1, 1)
    w = F.when(F.expr("p_size % 3 = 0"), F.array(F.concat(a, F.lit("ʰ")), F.concat(b, F.lit("ː")), t)).otherwise(F.array(a, F.lit("h"), b, b, t))
    return drift.drifts(words.select("p_brand", w.alias("w")), "p_brand", "w")


@query(f"WITH {_DRIFT} SELECT lect, other, g AS grapheme, kind, pieces, CAST(forms AS BIGINT) AS forms, CAST(corroborated AS BIGINT) AS corroborated FROM x")
def drift_kinds(spark, d):
    """Graphemes that one lect writes whole and another, which never does, in pieces: modifiers and doubled length."""
    return _drifts(spark, d).withColumn("pieces", F.array_join("pieces", " "))


@query(f"WITH {_DRIFT} SELECT lect || ' writes ' || g || ' where ' || other || ' writes ' || pieces || ' (' || kind || '; ' || forms || ' against ' || corroborated || ')' AS value FROM x")
def drift_text(spark, d):
    from lautwerk.operators import drift

    return drift.written_out(_drifts(spark, d))


@query(f"""
WITH w AS (SELECT DISTINCT one, two FROM ({C_SQL})),
f AS (SELECT one, two, CASE WHEN length(one) > 3 THEN '# ' ELSE '' END || CASE WHEN contains('aeiou', one[2]) THEN '[+vowel] ' ELSE '' END || CASE WHEN length(one) = 4 THEN '_[role=onset]' ELSE '_' END || CASE WHEN length(two) > 4 THEN ' [+nasal,-voiced]' ELSE '' END AS a,
  CASE WHEN length(two) = 4 THEN '· [+stop] · _' WHEN length(two) = 3 THEN '[+open] … _' ELSE '' END AS b,
  NOT (length(one) <= 3 AND NOT contains('aeiou', one[2]) AND length(two) <= 4 AND length(one) <> 4) AS has FROM w),
s AS (SELECT *, CASE WHEN has THEN a ELSE '' END AS fa FROM f)
SELECT one, two, one[1] || '  ~  {{' || two[1] || ',' || two[2] || '}}' || CASE WHEN fa = '' AND b = '' THEN '' ELSE '  /  ' END || CASE WHEN fa <> '' THEN 'one: ' || fa ELSE '' END || CASE WHEN fa <> '' AND b <> '' THEN ' ;  ' ELSE '' END || CASE WHEN b <> '' THEN 'two: ' || b ELSE '' END AS line,
  'one [tone=' || two[1] || ']' || CASE WHEN b <> '' THEN '  /  two: ' || b ELSE '' END AS cross_line FROM s
""".replace("'· [+stop] · _'", "'[+stop] · _'"))
def rule_lines(spark, d):
    """Rules and cross-dimensional rules as lines."""
    w = words_of_c(spark, d).select("one", "two").distinct()
    n, m = F.length("one"), F.length("two")
    a = F.array_compact(F.array(F.when(n > 3, "position:initial"), F.when(F.substring("one", 2, 1).isin(*"aeiou"), "preceding:vowel=+"), F.when(n == 4, "role:onset"), F.when(m > 4, "following:nasal=+"), F.when(m > 4, "following:voiced=-")))
    b = F.array_compact(F.array(F.when(m == 4, "preceding@2:stop=+"), F.when(m == 3, "somewhere_preceding:open=+")))
    w = w.withColumns({"a": a, "b": b})
    one, two = F.array(F.substring("one", 1, 1)), F.array(F.substring("two", 1, 1), F.substring("two", 2, 1))
    line = lines.line([(F.lit("one"), one, F.col("a")), (F.lit("two"), two, F.col("b"))])
    cross = lines.cross_dimensional(F.lit("one"), F.lit("tone"), F.substring("two", 1, 1), F.lit("two"), F.col("b"))
    return w.select("one", "two", line.alias("line"), cross.alias("cross_line"))
