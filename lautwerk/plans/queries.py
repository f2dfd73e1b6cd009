"""Queries over the generic tables, one for each family of operators, with the SQL that gives the same rows.

Three adapters make sequences of the tables: a user's events in the order of
their ids (E), the letters of the two words of a part's name (C), and order
lines as observations whose outcome is the return flag (X).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lautwerk.functions import stats
from lautwerk.operators import counts, grouping, outliers, prediction, resampling, sequences, splits, translation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Candidate predicates of X in the order in which ties are broken, as Spark and DuckDB both read them.
PREDICATES = {
    "linestatus_o": "l_linestatus = 'O'",
    "quantity_25": "l_quantity >= 25",
    "discount_5": "l_discount >= 0.05",
    "tax_4": "l_tax >= 0.04",
    "first_line": "l_linenumber = 1",
    "not_first_line": "l_linenumber > 1",
    "dear": "l_extendedprice >= 30000",
    "many_lines": "l_linenumber >= 4",
}
#: What best_split and decision_list explain: bands of the price of a line.
BAND = "CASE WHEN l_extendedprice >= 50000 THEN 'high' WHEN l_extendedprice >= 20000 THEN 'middle' ELSE 'low' END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def predicates() -> dict[str, Column]:
    return {k: F.expr(v) for k, v in PREDICATES.items()}


def lines_of_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def words_of_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name")
    return parts.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("one"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("two"))


def r6(x) -> Column:
    return F.round(x, 6)


E_SQL = "SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS target, user_id FROM events"
C_SQL = "SELECT p_partkey, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part"


@query(f"""
WITH t AS (SELECT source, target, count(*) AS n FROM ({E_SQL}) WHERE target IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY source) AS st, sum(n) OVER (PARTITION BY target) AS tt FROM t),
z AS (SELECT *, n / st AS p, 1.959963984540054 AS z FROM w)
SELECT source, target, CAST(n AS BIGINT) AS count, CAST(st AS BIGINT) AS source_total, CAST(tt AS BIGINT) AS target_total, round(p, 6) AS rate,
  round(greatest(0, (p + z*z/(2*st)) / (1 + z*z/st) - z / (1 + z*z/st) * sqrt(p*(1-p)/st + z*z/(4.0*st*st))), 6) AS low,
  round(least(1, (p + z*z/(2*st)) / (1 + z*z/st) + z / (1 + z*z/st) * sqrt(p*(1-p)/st + z*z/(4.0*st*st))), 6) AS high FROM z
""")
def seg_counts(spark, d):
    pairs = sequences.transitions(read(spark, d, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    rows = counts.pair_counts(pairs)
    return rows.select("source", "target", "count", "source_total", "target_total", *[r6(c).alias(c) for c in ("rate", "low", "high")])


@query("""
WITH g AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (l_discount >= 0.05) AS c, count(*) AS n FROM lineitem GROUP BY 1, 2),
z AS (SELECT *, c / n AS p, 2.5758293035489004 AS z FROM g)
SELECT l_returnflag, l_linestatus, CAST(c AS BIGINT) AS count, CAST(n AS BIGINT) AS total,
  round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4.0*n*n))), 6) AS low,
  round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4.0*n*n))), 6) AS high FROM z
""")
def wilson(spark, d):
    g = lines_of_x(spark, d).groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.expr("l_discount >= 0.05")).alias("count"), F.count(F.lit(1)).alias("total"))
    low, high = stats.wilson(F.col("count"), F.col("total"), 0.01)
    return g.select("l_returnflag", "l_linestatus", "count", "total", r6(low).alias("low"), r6(high).alias("high"))


@query("""
SELECT event_id, lag(event_type, 1) OVER w AS before_1, lag(event_type, 2) OVER w AS before_2, lag(event_type, 3) OVER w AS before_3,
  lead(event_type, 1) OVER w AS after_1, lead(event_type, 2) OVER w AS after_2, lead(event_type, 3) OVER w AS after_3,
  CASE WHEN lag(event_type) OVER w IS NULL THEN 'initial' WHEN lead(event_type) OVER w IS NULL THEN 'final' ELSE 'medial' END AS position
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def ctx_neighbours(spark, d):
    rows = sequences.neighbours(read(spark, d, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    return rows.select("event_id", *[f"{s}_{k}" for s in ("before", "after") for k in (1, 2, 3)], "position")


@query("""
SELECT event_id,
  coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_purchase,
  coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS before_error
FROM events
""")
def ctx_somewhere(spark, d):
    tests = {"after_purchase": ("before", F.col("event_type") == "purchase"), "before_error": ("after", F.col("event_type") == "error")}
    return sequences.somewhere(read(spark, d, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", tests).select("event_id", *tests)


@query(f"""
WITH l AS (SELECT list_distinct(string_split(one, '')) AS a, list_distinct(string_split(two, '')) AS b FROM ({C_SQL}))
SELECT array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '') AS lost,
       array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), '') AS gained, CAST(count(*) AS BIGINT) AS count
FROM l GROUP BY 1, 2
""")
def displacement(spark, d):
    one, two = counts.letters(F.col("one")), counts.letters(F.col("two"))
    lost, gained = counts.displacement(one, two)
    rows = words_of_c(spark, d).select(F.array_join(lost, "").alias("lost"), F.array_join(gained, "").alias("gained"))
    return rows.groupBy("lost", "gained").agg(F.count(F.lit(1)).alias("count"))


@query(f"""
WITH c AS ({C_SQL}),
a AS (SELECT p_partkey, unnest(range(1, length(one) + 1)) AS i, one FROM c), b AS (SELECT p_partkey, unnest(range(1, length(two) + 1)) AS i, two FROM c)
SELECT coalesce(one[a.i], '∅') AS source, coalesce(two[b.i], '∅') AS target, CAST(count(*) AS BIGINT) AS count
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey AND a.i = b.i GROUP BY 1, 2
""")
def null_rows(spark, d):
    words = words_of_c(spark, d)
    sides = [words.select("p_partkey", F.posexplode(counts.letters(F.col(c))).alias("i", "symbol")) for c in ("one", "two")]
    return counts.null_rows(*sides, ["p_partkey", "i"])


@query(f"""
WITH t AS (SELECT source, target, count(*) AS n FROM ({E_SQL}) WHERE target IS NOT NULL GROUP BY 1, 2),
p AS (SELECT source, n, sum(n) OVER (PARTITION BY source) AS t FROM t)
SELECT source, CAST(max(t) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS outcomes, round(sum(-(n / t) * log2(n / t)), 6) AS bits FROM p GROUP BY source
""")
def entropy_residue(spark, d):
    pairs = sequences.transitions(read(spark, d, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    rows = counts.residue(counts.pair_counts(pairs))
    return rows.select("source", "total", "outcomes", r6("bits").alias("bits"))


_LONG = " UNION ALL ".join(f"SELECT {k} AS place, '{n}' AS predicate, l_returnflag AS outcome, ({p}) AS holds, lineitem.* FROM lineitem" for k, (n, p) in enumerate(PREDICATES.items()))


def _scores_sql(source: str) -> str:
    x = lambda v: f"CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END"
    return f"""
  SELECT place, predicate, sum(i) AS n_in, sum(t - i) AS n_out, sum(t) AS n, count(*) AS k, max(i) AS top,
    2 * (({x('sum(i)')} - sum({x('i')})) + ({x('sum(t - i)')} - sum({x('(t - i)')})) - ({x('sum(t)')} - sum({x('t')}))) + (count(*) - 1) * ln(sum(t)) AS delta
  FROM (SELECT place, predicate, outcome, count(*) FILTER (holds) AS i, count(*) AS t FROM ({source}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(f"""
SELECT predicate, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, round(delta, 4) AS delta, round(CASE WHEN n_in > 0 THEN top / n_in ELSE 0 END, 6) AS dominant
FROM ({_scores_sql(_LONG)})
""")
def bic_split(spark, d):
    rows = splits.scores(splits.masses(lines_of_x(spark, d), "l_returnflag", predicates()))
    return rows.select("predicate", "n_in", "n_out", F.round("delta", 4).alias("delta"), r6("dominant").alias("dominant"))


_BANDS = _LONG.replace("l_returnflag AS outcome", f"{BAND} AS outcome")
_MARKS = """
  SELECT place, predicate, least(bits, translate(bits, '01', '10')) AS mark FROM (
    SELECT place, predicate, string_agg(CASE WHEN holds THEN '1' ELSE '0' END, '' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS bits
    FROM ({}) GROUP BY 1, 2)""".format(_LONG)


@query(f"""
WITH s AS ({_scores_sql(_BANDS)}), m AS (SELECT count(DISTINCT mark) AS m FROM ({_MARKS}))
SELECT predicate, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, round(delta + 2 * ln(m), 4) AS delta, CAST(m AS BIGINT) AS partitions
FROM s, m WHERE n_in >= 3 AND n_out >= 3 AND delta + 2 * ln(m) < 0 ORDER BY round(delta, 9), place LIMIT 1
""")
def best_split(spark, d):
    x = lines_of_x(spark, d).withColumn("band", F.expr(BAND))
    n = splits.partition_marks(_with_identity(x), "identity", predicates()).select("mark").distinct().count()
    won = splits.best(splits.scores(splits.masses(x, "band", predicates())), n, order=list(PREDICATES))
    return won.select("predicate", "n_in", "n_out", F.round("delta", 4).alias("delta"), F.lit(n).cast("long").alias("partitions"))


def _with_identity(x: DataFrame) -> DataFrame:
    return x.withColumn("identity", F.xxhash64(*x.columns))


@query(f"SELECT min(predicate) AS first, CAST(count(*) AS BIGINT) AS predicates FROM ({_MARKS}) GROUP BY mark")
def distinct_partitions(spark, d):
    marks = splits.partition_marks(_with_identity(lines_of_x(spark, d)), "identity", predicates())
    return marks.groupBy("mark").agg(F.min("predicate").alias("first"), F.count(F.lit(1)).alias("predicates")).drop("mark")


@query(f"WITH m AS ({_MARKS}) SELECT a.predicate AS a, b.predicate AS b FROM m a JOIN m b ON a.mark = b.mark AND a.predicate < b.predicate")
def confounds(spark, d):
    marks = splits.partition_marks(_with_identity(lines_of_x(spark, d)), "identity", predicates()).select("predicate", "mark")
    a, b = marks.withColumnRenamed("predicate", "a"), marks.withColumnRenamed("predicate", "b")
    return a.join(b, "mark").where("a < b").select("a", "b")


def _rounds_sql() -> str:
    ctes = [f"m AS (SELECT count(DISTINCT mark) AS m FROM ({_MARKS}))", "x0 AS (SELECT * FROM lineitem)"]
    for k in range(2):
        long = _BANDS.replace("FROM lineitem", f"FROM x{k} AS lineitem")
        ctes.append(f"s{k} AS (SELECT s.*, delta + 2 * ln(m) AS charged FROM ({_scores_sql(long)}) s, m)")
        ctes.append(f"w{k} AS (SELECT * FROM s{k} WHERE n_in >= 3 AND n_out >= 3 AND charged < 0 ORDER BY round(charged, 9), place LIMIT 1)")
        ctes.append(f"h{k} AS (SELECT l.* FROM ({long}) l JOIN w{k} ON l.predicate = w{k}.predicate)")
        ctes.append(f"x{k + 1} AS (SELECT * EXCLUDE (place, predicate, outcome, holds) FROM h{k} WHERE NOT holds)")
    rows = " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS decision, h.predicate, outcome, CAST(count(*) AS BIGINT) AS count, round(max(charged), 4) AS delta FROM h{k} h JOIN w{k} USING (predicate) WHERE holds GROUP BY 2, 3"
        for k in range(2)
    )
    return f"WITH {', '.join(ctes)} {rows}"


@query(_rounds_sql())
def decision_list(spark, d):
    rows = splits.decision_list(_with_identity(lines_of_x(spark, d)).withColumn("band", F.expr(BAND)), "band", predicates(), "identity")
    return rows.select("decision", "predicate", "outcome", "count", F.round("delta", 4).alias("delta"))


@query(f"""
SELECT predicate, CAST(count(*) AS BIGINT) AS lects, round(sum(delta), 4) AS delta FROM (
  SELECT * FROM ({_scores_sql(_LONG)}) UNION ALL SELECT * FROM ({_scores_sql(_LONG.replace("l_returnflag AS outcome", "l_linestatus AS outcome"))})
) GROUP BY predicate
""")
def per_lect_score(spark, d):
    x = lines_of_x(spark, d)
    sides = [splits.scores(splits.masses(x, c, predicates())) for c in ("l_returnflag", "l_linestatus")]
    return sides[0].unionByName(sides[1]).groupBy("predicate").agg(F.count(F.lit(1)).alias("lects"), F.round(F.sum("delta"), 4).alias("delta"))


@query("SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n, CAST(greatest(2, ceil(0.5 * log2(count(*) + 1))) AS BIGINT) AS min_commit FROM customer GROUP BY 1, 2")
def min_commit(spark, d):
    rows = read(spark, d, "customer", "c_mktsegment", "c_nationkey").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("min_commit", stats.min_commit(F.col("n")))


@query("""
WITH f AS (SELECT user_id, event_type, count(*) AS n, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1, 2),
s AS (SELECT *, coalesce(CAST(product(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 1) AS stride,
      product(n) OVER (PARTITION BY user_id) AS total FROM f),
c AS (SELECT s.*, CAST(least(total, 8) AS BIGINT) AS combinations, unnest(range(0, CAST(least(total, 8) AS BIGINT))) AS combination FROM s)
SELECT user_id, combination, string_agg(event_type || '=' || ids[CAST(floor(combination / stride) AS BIGINT) % n + 1], ',' ORDER BY event_type) AS forms,
  round(1.0 / max(combinations), 6) AS confidence
FROM c GROUP BY 1, 2
""")
def doublets(spark, d):
    rows = grouping.doublets(read(spark, d, "events", "user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")
    return rows.select("user_id", "combination", "forms", r6("confidence").alias("confidence"))


@query("SELECT doc_id, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS group_size, round(1.0 / count(*) OVER (PARTITION BY text), 6) AS weight FROM documents")
def etymon_weight(spark, d):
    rows = grouping.group_weights(read(spark, d, "documents", "doc_id", "text"), F.col("text"), "doc_id")
    return rows.select("doc_id", "group_size", r6("weight").alias("weight"))


@query("""
WITH t AS (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus || '=' || o_orderpriority))), ',') AS tuple FROM orders GROUP BY 1),
g AS (SELECT tuple, CAST(count(*) AS BIGINT) AS count FROM t GROUP BY 1)
SELECT tuple, count, CAST(row_number() OVER (ORDER BY count DESC, tuple) - 1 AS BIGINT) AS class_id FROM g
""")
def class_buckets(spark, d):
    return counts.class_buckets(read(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT a.source AS a, b.source AS b, CAST(count(DISTINCT a.text) AS BIGINT) AS shared FROM documents a JOIN documents b ON a.text = b.text AND a.source < b.source GROUP BY 1, 2")
def doc_dups(spark, d):
    return grouping.shared_members(read(spark, d, "documents", "source", "text"), "source", F.sha2(F.col("text").cast("binary"), 256))


@query("SELECT u.o_custkey, p.o_orderpriority FROM (SELECT DISTINCT o_custkey FROM orders) u, (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = u.o_custkey AND o.o_orderpriority = p.o_orderpriority)")
def missing_slots(spark, d):
    return grouping.missing_slots(read(spark, d, "orders", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


@query("SELECT text_sources, CAST(count(*) AS BIGINT) AS sets, CAST(count(*) FILTER (n > text_sources) AS BIGINT) AS doublet_sets FROM (SELECT count(DISTINCT source) AS text_sources, count(*) AS n FROM documents GROUP BY text) GROUP BY 1")
def unpaired(spark, d):
    rows = read(spark, d, "documents", "source", "text").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("m"), "source").agg(F.count(F.lit(1)).alias("n"))
    sets = rows.groupBy("m").agg(F.count(F.lit(1)).alias("text_sources"), F.sum("n").alias("n"))
    return sets.groupBy("text_sources").agg(F.count(F.lit(1)).alias("sets"), F.count_if(F.col("n") > F.col("text_sources")).alias("doublet_sets"))


@query("""
WITH c AS (SELECT o_custkey, avg(CAST(o_totalprice AS DECIMAL(18, 2))) AS cost FROM orders GROUP BY 1)
SELECT o_custkey, round(cost, 4) AS cost, round((cost - avg(cost) OVER ()) / stddev_samp(cost) OVER (), 4) AS z FROM c ORDER BY z DESC, o_custkey LIMIT 20
""")
def cost_outliers(spark, d):
    costs = read(spark, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("price"))
    rows = outliers.outliers(costs, "o_custkey", "price").select("o_custkey", F.round("cost", 4).alias("cost"), F.round("z", 4).alias("z"))
    return rows.orderBy(F.desc("z"), "o_custkey").limit(20)


@query("""
WITH x AS (SELECT n_name, CAST(round(o_totalprice * 100) AS BIGINT) / 100000.0 AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT n_name, row_number() OVER w AS k, count(*) OVER (PARTITION BY n_name) AS n, sum(c) OVER w AS s, sum(c * c) OVER w AS q,
      sum(c) OVER (PARTITION BY n_name) AS st, sum(c * c) OVER (PARTITION BY n_name) AS qt FROM x WINDOW w AS (PARTITION BY n_name ORDER BY c ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, greatest(q - s * s / k + (qt - q) - (st - s) * (st - s) / (n - k), 0) AS within FROM r WHERE k < n),
b AS (SELECT n_name, arg_min({'k': k, 'n': n, 's': s, 'st': st, 'within': within}, (within, k)) AS b FROM v GROUP BY 1)
SELECT n_name, CAST(b.n AS BIGINT) AS n, round(((b.st - b.s) / (b.n - b.k) - b.s / b.k) / sqrt(b.within / (b.n - 2)), 3) AS separation, round((b.n - b.k) / b.n, 6) AS above FROM b
""")
def cost_split(spark, d):
    orders, customer, nation = read(spark, d, "orders", "o_custkey", "o_totalprice"), read(spark, d, "customer", "c_custkey", "c_nationkey"), read(spark, d, "nation", "n_nationkey", "n_name")
    x = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.select("n_name", (F.round(F.col("o_totalprice") * 100).cast("long") / 100000.0).alias("c"))
    rows = outliers.cost_split(x, "n_name", "c")
    return rows.select("n_name", "n", F.round("separation", 3).alias("separation"), r6("above").alias("above"))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS estimate, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1")
def percentile_ci(spark, d):
    rows = read(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return rows.select("event_type", *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(("low", "estimate", "high"))])


@query("""
WITH g AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place, count(*) OVER () AS groups FROM (SELECT DISTINCT user_id FROM events)),
p AS (SELECT b AS draw, CAST('0x' || substr(md5(b || '-' || place), 1, 8) AS BIGINT) % groups AS place FROM g, range(50) t(b)),
m AS (SELECT draw, place, count(*) AS times FROM p GROUP BY 1, 2),
c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT draw, event_type, sum(n * times) AS mass FROM m JOIN g USING (place) JOIN c USING (user_id) GROUP BY 1, 2),
v AS (SELECT event_type, mass / sum(mass) OVER (PARTITION BY draw) AS rate FROM r)
SELECT event_type, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high, CAST(count(*) AS BIGINT) AS draws FROM v GROUP BY 1
""")
def bootstrap(spark, d):
    c = read(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rates = resampling.bootstrap_rates(c, "user_id", "event_type", "n", 50)
    rows = rates.groupBy("event_type").agg(F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("draws"))
    return rows.select("event_type", r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"), "draws")


def copies_sql(seed: int, block: str, unit: str) -> str:
    """The multiplicities of hashed draws in SQL: a list of a digest's four."""
    piece = f"md5('{seed}-' || {block} || '-' || {unit})"
    number = f"CAST('0x' || substr({piece}, 8 * k + 1, 8) AS BIGINT)"
    return "(" + " + ".join(f"CAST({number} >= {t} AS INT)" for t in resampling.STEPS) + ")"


def intervals_sql(counted: str, label: str, draws: int, seed: int = 0, whole: str | None = None) -> str:
    """``label, low, high`` of hashed draws over ``counted`` (unit, label, n); whole: another table (unit, n) of the denominators."""
    per = resampling.PER_DIGEST
    return f"""
cnt AS ({counted}), whole AS ({whole or 'SELECT unit, sum(n) AS n FROM cnt GROUP BY 1'}),
u AS (SELECT unit, b, k, {copies_sql(seed, 'b', 'unit')} AS times FROM (SELECT DISTINCT unit FROM whole), range({-(-draws // per)}) t(b), range({per}) s(k) WHERE b * {per} + k < {draws}),
mass AS (SELECT {label}, b, k, sum(n * times) AS m FROM cnt JOIN u USING (unit) GROUP BY ALL), tot AS (SELECT b, k, sum(n * times) AS t FROM whole JOIN u USING (unit) GROUP BY ALL),
rates AS (SELECT {label}, CASE WHEN t > 0 THEN CAST(m AS DOUBLE) / t ELSE 0 END AS rate FROM mass JOIN tot USING (b, k))
SELECT {label}, round(greatest(quantile_cont(rate, 0.025), 0), 6) AS low, round(least(quantile_cont(rate, 0.975), 1), 6) AS high FROM rates GROUP BY 1"""


def intervals_of(rates, label: str):
    return resampling.percentile_intervals(rates, label).select(label, r6("low").alias("low"), r6("high").alias("high"))


@query(f"WITH {intervals_sql('SELECT CAST(user_id AS VARCHAR) AS unit, event_type, count(*) AS n FROM events GROUP BY 1, 2', 'event_type', 200)}")
def bootstrap_hashed(spark, d):
    """Shares of event types when users are drawn anew by hashes, without numbering them."""
    c = read(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return intervals_of(resampling.hashed_rates(c, "user_id", "event_type", "n", 200), "event_type")


_UNIT = "CASE WHEN o_orderpriority < '3' THEN 'of:' || o_custkey ELSE 'own:' || o_orderkey END"


@query(f"WITH {intervals_sql(f'SELECT {_UNIT} AS unit, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2', 'o_orderstatus', 100, 7)}")
def bootstrap_units(spark, d):
    """Shares of states of orders, of which the urgent ones are drawn together with all urgent ones of their customer, the others each on its own."""
    rows = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    unit = resampling.observation_group(F.when(F.col("o_orderpriority") < "3", F.col("o_custkey").cast("string")), F.col("o_orderkey"))
    c = rows.groupBy(unit.alias("unit"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return intervals_of(resampling.hashed_rates(c, "unit", "o_orderstatus", "n", 100, 7), "o_orderstatus")


@query(f"""
WITH x AS (SELECT p_partkey, one, two, p_brand, rep FROM ({C_SQL}) JOIN part USING (p_partkey), range(5) t(rep)),
a AS (SELECT rep, p_brand, p_partkey, one, row_number() OVER (PARTITION BY rep, p_brand ORDER BY p_partkey) AS k FROM x),
b AS (SELECT rep, p_brand, two, row_number() OVER (PARTITION BY rep, p_brand ORDER BY CAST('0x' || substr(md5(rep || '-' || p_partkey), 1, 8) AS BIGINT), p_partkey) AS k FROM x)
SELECT rep AS replicate, one, two, CAST(count(*) AS BIGINT) AS count FROM a JOIN b USING (rep, p_brand, k) GROUP BY 1, 2, 3
""")
def pair_shuffle(spark, d):
    x = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_brand"), "p_partkey")
    rows = resampling.pairing_shuffle(x, "p_partkey", "one", "two", "p_brand", 5)
    return rows.groupBy("replicate", "one", "two").agg(F.count(F.lit(1)).alias("count"))


_FOLD = "CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 5"


@query(f"""
WITH e AS (SELECT *, {_FOLD} AS fold FROM ({E_SQL}) WHERE target IS NOT NULL),
tr AS (SELECT * FROM e WHERE fold <> 0), te AS (SELECT source, target, count(*) AS w FROM e WHERE fold = 0 GROUP BY 1, 2),
inv AS (SELECT DISTINCT target FROM tr), k AS (SELECT count(*) AS k FROM inv),
n AS (SELECT source, target, count(*) AS n FROM tr GROUP BY 1, 2),
g AS (SELECT s.source, inv.target, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM te) s CROSS JOIN inv LEFT JOIN n ON n.source = s.source AND n.target = inv.target),
p AS (SELECT source, target, (n + 1) / (sum(n) OVER (PARTITION BY source) + k + 1) AS p FROM g, k),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p DESC, target) AS place FROM p),
q AS (SELECT source, sum(p * p) AS square, max(p) AS top FROM r GROUP BY 1),
j AS (SELECT te.w, r.p, r.place, q.square, q.top FROM te JOIN r USING (source, target) JOIN q USING (source)),
b AS (SELECT least(floor(top * 10), 9) AS bin, sum(w) AS m, sum(CASE WHEN place = 1 THEN w ELSE 0 END) AS hit, sum(w * top) AS said FROM j GROUP BY 1)
SELECT CAST(sum(w) AS BIGINT) AS n, round(sum(-w * ln(p)) / sum(w), 6) AS log_loss, round(sum(CASE WHEN place = 1 THEN w ELSE 0 END) / sum(w), 6) AS top1,
  round(sum(CASE WHEN place <= 3 THEN w ELSE 0 END) / sum(w), 6) AS top_k, round(sum(w * (square - 2 * p + 1)) / sum(w), 6) AS brier,
  round(sum(CASE WHEN top < 0.5 THEN w ELSE 0 END) / sum(w), 6) AS abstained, (SELECT round(sum(abs(hit - said)) / sum(m), 6) FROM b) AS ece FROM j
""")
def predictive(spark, d):
    fold = F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events", "user_id", "event_id", "event_type")
    e = e.select(fold.alias("fold"), F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target")).where("target is not null")
    rows = prediction.score(prediction.predict(e.where("fold <> 0"), e.where("fold = 0")))
    return rows.select("n", *[r6(c).alias(c) for c in ("log_loss", "top1", "top_k", "brier", "abstained", "ece")])


def _em_sql(rounds: int) -> str:
    ctes = [
        f"c AS (SELECT one, two, count(*) AS w FROM ({C_SQL}) GROUP BY 1, 2)",
        "s AS (SELECT one, two, w, unnest(list_concat(['∅'], list_filter(string_split(one, ''), lambda x: x <> ''))) AS s FROM c)",
        "e AS (SELECT one, two, w, s, unnest(range(1, length(two) + 1)) AS j FROM s)",
        "l AS (SELECT one, two, w, s, j, two[j] AS t FROM e)",
        "p0 AS (SELECT s, t, 1.0 / count(*) OVER (PARTITION BY s) AS p FROM (SELECT DISTINCT s, t FROM l))",
    ]
    for k in range(rounds):
        ctes.append(f"m{k} AS (SELECT s, t, w * p / sum(p) OVER (PARTITION BY one, two, j) AS share FROM l JOIN p{k} USING (s, t))")
        ctes.append(f"p{k + 1} AS (SELECT s, t, sum(share) / sum(sum(share)) OVER (PARTITION BY s) AS p FROM m{k} GROUP BY s, t)")
    return f"WITH {', '.join(ctes)} SELECT s, t, round(p, 6) AS p FROM p{rounds}"


@query(_em_sql(3))
def ibm1_em(spark, d):
    pairs = words_of_c(spark, d).groupBy("one", "two").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    pairs = pairs.select(F.concat_ws("|", "one", "two").alias("pair"), F.concat(F.array(F.lit(translation.NULL)), counts.letters(F.col("one"))).alias("source"), counts.letters(F.col("two")).alias("target"), "weight")
    return translation.train(pairs, 3).select("s", "t", r6("p").alias("p"))


@query(f"""
WITH c AS ({C_SQL}), v AS (SELECT DISTINCT unnest(string_split(one || two, '')) AS x FROM c),
g AS (SELECT a.x AS a, b.x AS b, abs(ord(a.x) - ord(b.x)) / 25.0 AS d FROM v a, v b)
SELECT a, b, round(5 * exp(-d) / sum(exp(-d)) OVER (PARTITION BY a), 6) AS alpha, round(ln(sum(exp(-d)) OVER (PARTITION BY a)), 6) AS log_z FROM g
""")
def prior_softmax(spark, d):
    v = words_of_c(spark, d).select(F.explode(F.array_union(counts.letters(F.col("one")), counts.letters(F.col("two")))).alias("a")).distinct()
    grid = v.crossJoin(F.broadcast(v.withColumnRenamed("a", "b"))).withColumn("d", F.abs(F.ascii("a") - F.ascii("b")) / 25.0)
    return translation.softmax_prior(grid).select("a", "b", r6("alpha").alias("alpha"), r6("log_z").alias("log_z"))


@query(f"SELECT one, two, CAST(levenshtein(one, two) AS BIGINT) AS cost, CAST(count(*) AS BIGINT) AS count FROM ({C_SQL}) GROUP BY 1, 2, 3")
def align_unit(spark, d):
    from lautwerk.operators.alignment import align_pairs, unit_costs

    pairs = words_of_c(spark, d).groupBy("one", "two").agg(F.count(F.lit(1)).alias("count"))
    pairs = pairs.select("one", "two", "count", counts.letters(F.col("one")).alias("source"), counts.letters(F.col("two")).alias("target"))
    return align_pairs(pairs, unit_costs()).select("one", "two", F.col("cost").cast("long").alias("cost"), "count")


@query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
g AS (SELECT user_id, k // 3 AS g, list(event_type ORDER BY k) AS span FROM r GROUP BY 1, 2 HAVING count(*) = 3),
p AS (SELECT span, lead(span) OVER (PARTITION BY user_id ORDER BY g) AS next FROM g)
SELECT array_to_string(span, ' ') AS span, array_to_string(next, ' ') AS next, CAST(count(*) AS BIGINT) AS count
FROM p WHERE next IS NOT NULL AND span <> next AND list_sort(span) = list_sort(next) GROUP BY 1, 2
""")
def reorder(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    r = read(spark, d, "events", "user_id", "event_id", "event_type").withColumn("k", F.row_number().over(w) - 1)
    g = r.groupBy("user_id", F.floor(F.col("k") / 3).alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "event_type"))).alias("x")).where("size(x) = 3")
    g = g.select("user_id", "g", F.col("x.event_type").alias("span"))
    p = g.withColumn("next", F.lead("span").over(Window.partitionBy("user_id").orderBy("g")))
    p = p.where((F.col("span") != F.col("next")) & (F.array_sort("span") == F.array_sort("next")))
    return p.groupBy(F.array_join("span", " ").alias("span"), F.array_join("next", " ").alias("next")).agg(F.count(F.lit(1)).alias("count"))



@query("""
WITH d AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT DISTINCT lang, unnest(ws) AS w FROM d),
pairs AS (SELECT DISTINCT lang, ws[i] AS p, ws[i + 1] AS q FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM d))
SELECT a.lang AS lect, b.lang AS other, CAST(count(DISTINCT a.w) AS BIGINT) AS graphemes, CAST(count(*) AS BIGINT) AS corroborated
FROM words a JOIN pairs b ON a.w = b.p || b.q AND a.lang <> b.lang
WHERE NOT EXISTS (SELECT 1 FROM words c WHERE c.lang = b.lang AND c.w = a.w) GROUP BY 1, 2
""")
def drift(spark, d):
    from lautwerk.operators.drift import written_apart

    docs = read(spark, d, "documents", "lang", "text")
    words = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda x: x != "")
    rows = written_apart(docs.select("lang", words.alias("ws")), "lang", "ws")
    return rows.groupBy(F.col("lect"), "other").agg(F.count_distinct("grapheme").alias("graphemes"), F.count(F.lit(1)).alias("corroborated"))


_RULES = [("late", ["linestatus_o"]), ("bulk", ["quantity_25"]), ("late_bulk", ["linestatus_o", "quantity_25"]), ("late_bulk_dear", ["linestatus_o", "quantity_25", "dear"]), ("taxed", ["tax_4", "discount_5"])]


def _match_sql() -> str:
    rules = " UNION ALL ".join(
        f"SELECT l_orderkey, l_returnflag, '{n}' AS rule, {len(ps)} AS size, {k} AS place, r FROM x WHERE {' AND '.join(f'({PREDICATES[p]})' for p in ps)}" for k, (n, ps) in enumerate(_RULES)
    )
    return f"""
WITH x AS (SELECT row_number() OVER () AS r, * FROM lineitem), m AS ({rules}),
b AS (SELECT r, arg_min(rule, (-size, place)) AS rule FROM m GROUP BY r)
SELECT coalesce(b.rule, '-') AS rule, l_returnflag, CAST(count(*) AS BIGINT) AS count FROM x LEFT JOIN b USING (r) GROUP BY 1, 2"""


@query(_match_sql())
def subset_match(spark, d):
    from lautwerk.functions.environments import most_specific

    x = lines_of_x(spark, d)
    tokens = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates().items()]))
    return x.select("l_returnflag", most_specific(tokens, _RULES).alias("rule")).groupBy("rule", "l_returnflag").agg(F.count(F.lit(1)).alias("count"))


@query("""
WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_returnflag, a.l_linestatus, CAST(a.n AS BIGINT) AS count, coalesce(b.l_returnflag || b.l_linestatus, '-') AS contrast, CAST(coalesce(b.n, 0) AS BIGINT) AS contrast_count
FROM c a LEFT JOIN c b ON a.l_returnflag = b.l_returnflag AND a.l_linestatus <> b.l_linestatus
""")
def contrast_link(spark, d):
    c = lines_of_x(spark, d).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("count"))
    other = c.select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("count").alias("m"))
    met = c.join(other, (F.col("l_returnflag") == F.col("f")) & (F.col("l_linestatus") != F.col("s")), "left")
    return met.select("l_returnflag", "l_linestatus", "count", F.coalesce(F.concat("f", "s"), F.lit("-")).alias("contrast"), F.coalesce("m", F.lit(0)).alias("contrast_count"))


@query("""
WITH m AS (SELECT DISTINCT p_type, p_brand, p_size FROM part), g AS (SELECT p_type, count(DISTINCT p_brand) AS members FROM m GROUP BY 1),
s AS (SELECT p_type, p_size, count(*) AS n FROM m GROUP BY 1, 2)
SELECT g.p_type, CAST(members AS BIGINT) AS members, coalesce(string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) FILTER (n = members), '') AS shared, CAST(max(n) AS BIGINT) AS widest
FROM g JOIN s USING (p_type) GROUP BY 1, 2
""")
def events_group(spark, d):
    m = read(spark, d, "part", "p_type", "p_brand", "p_size").distinct()
    g = m.groupBy("p_type").agg(F.count_distinct("p_brand").alias("members"))
    s = m.groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).join(g, "p_type")
    shared = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") == F.col("members"), F.col("p_size")))), lambda x: x.cast("string")), ",")
    return s.groupBy("p_type", "members").agg(shared.alias("shared"), F.max("n").alias("widest"))


@query("""
WITH c AS (SELECT c_nationkey, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS DOUBLE) AS a, CAST(count(*) FILTER (c_mktsegment = 'FURNITURE') AS DOUBLE) AS b, CAST(count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'FURNITURE')) AS DOUBLE) AS c FROM customer GROUP BY 1),
t AS (SELECT *, a + b + c AS n, (a + b + c) / 3 AS k FROM c)
SELECT c_nationkey, CAST(n AS BIGINT) AS n, round(lgamma(n + n) - lgamma(n) + 3 * lgamma(k) - lgamma(a + k) - lgamma(b + k) - lgamma(c + k), 4) AS nll FROM t
""")
def dirichlet(spark, d):
    s = F.col("c_mktsegment")
    kinds = [s == "BUILDING", s == "FURNITURE", ~s.isin("BUILDING", "FURNITURE")]
    c = read(spark, d, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey").agg(*[F.count_if(k).alias(n) for k, n in zip(kinds, "abc")])
    n = F.col("a") + F.col("b") + F.col("c")
    return c.select("c_nationkey", n.alias("n"), F.round(stats.dirichlet_nll([F.col(x) for x in "abc"]), 4).alias("nll"))


@query("""
WITH n AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part WHERE p_size > 0),
h AS (SELECT n, unnest(range(0, n + 1)) AS h FROM n),
c AS (SELECT n, sum(exp(lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1) + CASE WHEN h > 0 THEN h * ln(h) ELSE 0 END + CASE WHEN n > h THEN (n - h) * ln(n - h) ELSE 0 END - n * ln(n))) AS c2 FROM h GROUP BY n)
SELECT n, round(ln(c2), 6) AS two, round(ln(c2 + n / 1.0), 6) AS three, round(ln(c2 + n / 1.0 + n / 2.0 * c2), 6) AS four FROM c
""")
def nml(spark, d):
    n = read(spark, d, "part", "p_size").where("p_size > 0").select(F.col("p_size").cast("long").alias("n")).distinct()
    return n.select("n", *[r6(stats.nml_normalizer(F.col("n"), k)).alias(name) for k, name in ((2, "two"), (3, "three"), (4, "four"))])


# --- without SQL: kernels and training


@query()
def align_spans(spark, d):
    """Alignment with spans and feature distances of the words of part names."""
    from lautwerk.functions.features import distance
    from lautwerk.operators.alignment import align_pairs, prior_costs
    from lautwerk.operators.pairwise import chunk_tier

    pairs = words_of_c(spark, d).groupBy("one", "two").agg(F.count(F.lit(1)).alias("count"))
    pairs = pairs.select("one", "two", "count", counts.letters(F.col("one")).alias("source"), counts.letters(F.col("two")).alias("target"))
    return align_pairs(pairs, prior_costs(distance, tier=chunk_tier)).select("one", "two", "count", F.size("links").cast("long").alias("links"), r6("cost").alias("cost"))


_EDGES = """
  e AS (SELECT p_partkey AS a, min(p_partkey) OVER (PARTITION BY p_name, p_size) AS b FROM part
        UNION SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) FROM part),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(a, b) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
  comp AS (SELECT a AS p_partkey, min(b) AS comp FROM reach GROUP BY 1)"""


def _components(spark, d) -> DataFrame:
    from lautwerk.operators.graph import Scratch, label_components

    parts = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return label_components(parts, "p_partkey", [["p_name", "p_size"], ["p_brand", "p_type", "p_size"]], Scratch(spark, "components"))


@query(f"WITH RECURSIVE {_EDGES} SELECT p_partkey, comp FROM comp")
def components(spark, d):
    return _components(spark, d)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT comp, (row_number() OVER (ORDER BY comp) - 1) % 5 AS fold FROM (SELECT DISTINCT comp FROM comp)) SELECT p_partkey, CAST(fold AS BIGINT) AS fold FROM comp JOIN r USING (comp)")
def folds(spark, d):
    from lautwerk.operators.graph import ranked

    comp = _components(spark, d)
    dealt = ranked(comp.select("comp").distinct(), "comp").select("comp", (F.col("place") % 5).alias("fold"))
    return comp.join(dealt, "comp").select("p_partkey", "fold")
