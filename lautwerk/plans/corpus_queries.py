"""Queries of sources, features, syllables and environments, on words and sets made of part names, with the SQL that gives the same rows.

A part is a set of related forms: the two words of its name are forms of two
lects, its letters their segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lautwerk.functions import features as phon
from lautwerk.operators import contexts, counts
from lautwerk.plans.queries import C_SQL, query, r6, read, words_of_c
from lautwerk.sources import cldf as lexibank
from lautwerk.sources import corpus

_LETTERS = [g for g in phon.table() if g in "abcdefghijklmnopqrstuvwxyz"]
#: The letters' features, as rows that SQL reads: fixed values of the chart.
FEATURES_SQL = "(VALUES " + ", ".join(f"('{g}', '{f}')" for g in _LETTERS for f in sorted(phon.table()[g])) + ") f(g, feature)"
WORDS_SQL = f"SELECT w AS word, count(*) AS n FROM (SELECT one AS w FROM ({C_SQL}) UNION ALL SELECT two FROM ({C_SQL})) GROUP BY 1"
_EACH = f"SELECT word, unnest(range(0, length(word))) AS pos, word[pos + 1] AS g, length(word) AS n FROM ({WORDS_SQL})"


def vocabulary_words(spark, d) -> DataFrame:
    """``word, count, graphemes, given`` of the words of part names."""
    words = words_of_c(spark, d).select(F.explode(F.array("one", "two")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    none = F.array().cast("array<int>")
    return words.select("word", "count", counts.letters(F.col("word")).alias("graphemes"), none.alias("given"))


@query(f"SELECT word, string_agg(DISTINCT feature, ' ' ORDER BY feature) AS features, CAST(count(DISTINCT feature) AS BIGINT) AS n FROM ({_EACH}) e JOIN {FEATURES_SQL} ON e.g = f.g GROUP BY 1")
def feature_union(spark, d):
    """Features of the graphemes of each word, looked up and united."""
    each = vocabulary_words(spark, d).select("word", F.explode("graphemes").alias("grapheme"))
    met = each.join(contexts.described(each), "grapheme").select("word", F.explode("features").alias("feature")).distinct()
    return met.groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("feature")), " ").alias("features"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH l AS (SELECT DISTINCT g FROM ({_EACH})), s AS (SELECT l.g, list(feature) AS fs FROM l JOIN {FEATURES_SQL} ON l.g = f.g GROUP BY 1)
SELECT a.g AS a, b.g AS b, round(CASE WHEN a.g = b.g THEN 0 ELSE 1 - len(list_intersect(a.fs, b.fs)) / len(list_distinct(list_concat(a.fs, b.fs))) END, 6) AS d FROM s a, s b
""")
def segment_distance(spark, d):
    each = contexts.described(vocabulary_words(spark, d).select(F.explode("graphemes").alias("grapheme")))
    return r6_of(phon_distances(each), "d")


def phon_distances(dims: DataFrame) -> DataFrame:
    """``a, b, d`` of every two graphemes of an inventory: the share of features that they don't have in common."""
    a, b = dims.select(F.col("grapheme").alias("a"), F.col("features").alias("x")), dims.select(F.col("grapheme").alias("b"), F.col("features").alias("y"))
    met = a.crossJoin(F.broadcast(b))
    union = F.size(F.array_union("x", "y"))
    apart = F.when(F.col("a") == F.col("b"), 0.0).when((F.size("x") == 0) | (F.size("y") == 0), 1.0).otherwise(1 - F.size(F.array_intersect("x", "y")) / union)
    return met.select("a", "b", apart.alias("d"))


def r6_of(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


_SCORES = "(VALUES " + ", ".join(f"('{g}', {phon.sonority(g)}, {str(phon.is_syllabic(g)).lower()})" for g in _LETTERS) + ") v(g, s, y)"
_SYLLABLES = f"""
  e AS ({_EACH}), sc AS (SELECT word, any_value(n) AS n, list(coalesce(s, 3) ORDER BY pos) AS s, list(coalesce(y, false) ORDER BY pos) AS y FROM e LEFT JOIN {_SCORES} ON e.g = v.g GROUP BY 1),
  nu AS (SELECT *, list_filter(range(0, n), lambda k: s[k + 1] >= 6 OR y[k + 1] OR (s[k + 1] >= 4 AND (k = 0 OR s[k] < s[k + 1]) AND (k = n - 1 OR s[k + 2] < s[k + 1]))) AS own FROM sc),
  tp AS (SELECT word, n, s, CASE WHEN len(own) > 0 THEN own ELSE [list_position(s, list_max(s)) - 1] END AS tops FROM nu),
  pr AS (SELECT word, s, unnest(range(1, len(tops))) AS i, tops[i] AS a, tops[i + 1] AS b FROM tp),
  br AS (SELECT word, i, CASE WHEN b - a < 2 THEN b ELSE coalesce(list_max(list_filter(range(a + 1, b - 1), lambda j: s[j + 1] > s[j + 2])), a) + 1 END AS bk FROM pr),
  sy AS (SELECT tp.word, any_value(n) AS n, any_value(tops) AS tops, coalesce(list(bk ORDER BY i) FILTER (bk IS NOT NULL), []) AS starts FROM tp LEFT JOIN br USING (word) GROUP BY 1)"""


@query(f"WITH {_SYLLABLES} SELECT word, CAST(c.n AS BIGINT) AS count, array_to_string(starts, ',') AS breaks, array_to_string(tops, ',') AS nuclei FROM sy JOIN ({WORDS_SQL}) c USING (word)")
def syllables(spark, d):
    """Nuclei and syllable breaks of the words of part names."""
    rows = contexts.syllabified(vocabulary_words(spark, d))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("word", "count", text("starts").alias("breaks"), text("tops").alias("nuclei"))


_PLACED = f"""{_SYLLABLES},
  un AS (SELECT word, n, tops, starts, unnest(range(0, n)) AS pos FROM sy),
  ps AS (SELECT sy.word, sy.n, pos, tops, starts, len(list_filter(starts, lambda b: b <= pos)) AS syl, len(starts) + 1 AS syls,
         coalesce(list_max(list_filter(starts, lambda b: b <= pos)), 0) AS lo, coalesce(list_min(list_filter(starts, lambda b: b > pos)), sy.n) - 1 AS hi FROM un sy),
  pl AS (SELECT *, list_min(list_filter(tops, lambda t: t >= lo AND t <= hi)) AS top FROM ps),
  ro AS (SELECT *, CASE WHEN top IS NULL OR pos > top THEN 'coda' WHEN pos = top THEN 'nucleus' WHEN pos = lo AND top = pos + 1 AND lo > 0 AND list_contains(tops, lo - 1) THEN 'ambisyllabic' ELSE 'onset' END AS role,
         CASE WHEN syl = 0 THEN 'initial' WHEN syls - 1 - syl = 0 THEN 'final' WHEN syls - 1 - syl = 1 THEN 'penultimate' WHEN syls - 1 - syl = 2 THEN 'antepenultimate' ELSE 'other' END AS in_word,
         CASE WHEN pos = 0 THEN 'initial' WHEN pos = n - 1 THEN 'final' ELSE 'medial' END AS position FROM pl),
  sh AS (SELECT DISTINCT word, syl, CASE WHEN top IS NULL OR hi > top THEN 'closed' ELSE 'open' END AS shape, CASE WHEN top IS NOT NULL THEN 'short' END AS nucleus,
         CASE WHEN top IS NULL THEN NULL WHEN hi > top THEN 'heavy' ELSE 'light' END AS weight FROM ro)"""


@query(f"WITH {_PLACED} SELECT word, pos, role, in_word, shape, nucleus, weight, CAST(syl AS INTEGER) AS syllable FROM ro JOIN sh USING (word, syl)")
def syllable_slots(spark, d):
    """Role of each segment in its syllable, the syllable's place in the word, its shape and weight."""
    rows = contexts.placed(vocabulary_words(spark, d))
    shape = contexts.shapes(rows, contexts.described(rows))
    met = rows.join(shape, ["word", "syllable"])
    return met.select("word", F.col("pos").cast("long").alias("pos"), "role", "in_word", "shape", "nucleus", "weight", "syllable")


@query(f"""
WITH {_PLACED}, fe AS (SELECT g, feature || '=+' AS feature FROM {FEATURES_SQL}),
ot AS (SELECT a.word, a.pos, b.pos AS o, a.syl, b.syl AS there, e.g FROM ro a JOIN ro b ON a.word = b.word AND a.pos <> b.pos JOIN e ON e.word = b.word AND e.pos = b.pos),
sl AS (SELECT word, pos, g, CASE WHEN o < pos THEN 'preceding' ELSE 'following' END || CASE WHEN abs(o - pos) > 1 THEN '@' || abs(o - pos) ELSE '' END AS slot FROM ot WHERE abs(o - pos) <= 3
  UNION ALL SELECT word, pos, g, 'somewhere_' || CASE WHEN o < pos THEN 'preceding' ELSE 'following' END FROM ot
  UNION ALL SELECT word, pos, g, CASE there - syl WHEN 0 THEN 'same_syllable' WHEN -1 THEN 'previous_syllable' ELSE 'next_syllable' END FROM ot WHERE abs(there - syl) <= 1),
kd AS (SELECT word, syl, 'shape=' || shape AS feature FROM sh UNION ALL SELECT word, syl, 'nucleus=' || nucleus FROM sh WHERE nucleus IS NOT NULL UNION ALL SELECT word, syl, 'weight=' || weight FROM sh WHERE weight IS NOT NULL),
tk AS (SELECT word, pos, slot || ':' || feature AS token FROM sl JOIN fe USING (g)
  UNION SELECT ro.word, pos, CASE kd.syl - ro.syl WHEN -1 THEN 'previous_syllable:' ELSE 'next_syllable:' END || feature FROM ro JOIN kd ON kd.word = ro.word AND abs(kd.syl - ro.syl) = 1
  UNION SELECT word, pos, 'position:' || position FROM ro UNION SELECT word, pos, 'role:' || role FROM ro UNION SELECT word, pos, 'syllable:' || in_word FROM ro
  UNION SELECT word, pos, 'morpheme:' || CASE WHEN pos = 0 THEN 'initial' WHEN pos = 1 THEN 'final' WHEN pos = 2 AND n = 3 THEN 'only' WHEN pos = 2 THEN 'initial' WHEN pos = n - 1 THEN 'final' ELSE 'internal' END FROM ro
  UNION SELECT word, pos, 'morpheme_index:' || CASE WHEN pos < 2 THEN '0' ELSE '1' END FROM ro
  UNION SELECT word, pos, 'stress:primary' FROM ro WHERE pos = 0 UNION SELECT word, pos, 'preceding_stress:primary' FROM ro WHERE pos = 1)
SELECT word, pos, string_agg(token, ' ' ORDER BY token) AS tokens, CAST(count(*) AS BIGINT) AS n FROM tk GROUP BY 1, 2
""")
def position_contexts(spark, d):
    """The whole environment of each position: neighbours, distances, anywhere, syllables, shapes, place, morphemes (the second starts at the third segment), stress on the first."""
    words = vocabulary_words(spark, d)
    words = words.withColumns({"morphemes": F.array(F.lit(2)), "stress": F.transform("graphemes", lambda g, i: F.when(i == 0, "primary").otherwise(""))})
    rows = contexts.environments(words)
    return rows.select("word", F.col("pos").cast("long").alias("pos"), F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n"))


PREFERENCE = ["vowel", "consonant", "voiced", "nasal", "stop", "fricative"]


@query(f"""
WITH l AS (SELECT DISTINCT g FROM ({_EACH})), c AS (SELECT feature, string_agg(l.g, ' ' ORDER BY l.g) AS carriers, count(*) AS m FROM l JOIN {FEATURES_SQL} ON l.g = f.g GROUP BY 1),
r AS (SELECT *, coalesce(list_position({PREFERENCE}, feature) - 1, {len(PREFERENCE)}) AS rank FROM c WHERE m < (SELECT count(*) FROM l))
SELECT CAST(rank AS INTEGER) AS rank, feature, carriers FROM (SELECT *, row_number() OVER (PARTITION BY carriers ORDER BY rank, feature) AS k FROM r) WHERE k = 1
""")
def feature_vocabulary(spark, d):
    each = vocabulary_words(spark, d).select(F.explode("graphemes").alias("grapheme"))
    return contexts.vocabulary(contexts.described(each), PREFERENCE)


def _candidate_sql() -> str:
    sql = feature_vocabulary_sql()
    slots = " UNION ALL ".join(f"SELECT {k} AS sp, '{s}' AS slot" for k, s in enumerate(("preceding", "following", "preceding@2", "somewhere_following")))
    return f"SELECT CAST(row_number() OVER (ORDER BY sp, rank, feature) - 1 AS BIGINT) AS place, slot || ':' || feature || '=+' AS token FROM ({sql}), ({slots})"


def feature_vocabulary_sql() -> str:
    from lautwerk.plans.queries import SQL

    return SQL["feature_vocabulary"]


@query(_candidate_sql())
def candidate_predicates(spark, d):
    return contexts.candidates(feature_vocabulary(spark, d), ("preceding", "following", "preceding@2", "somewhere_following"))


@query(f"""
SELECT x AS grapheme, CAST(count(*) AS BIGINT) AS count, CASE WHEN list_contains({_LETTERS}, x) THEN 'ok' WHEN list_contains({_LETTERS}, x[1]) THEN 'partial' ELSE 'unknown' END AS status,
  CASE WHEN list_contains({_LETTERS}, x) THEN x WHEN list_contains({_LETTERS}, x[1]) THEN x[1] ELSE '' END AS prefix,
  CASE WHEN list_contains({_LETTERS}, x) THEN '' WHEN list_contains({_LETTERS}, x[1]) THEN x[2] ELSE x[1] END AS offending
FROM (SELECT one[1:2] AS x FROM ({C_SQL}) UNION ALL SELECT two[1] FROM ({C_SQL}) UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part) WHERE NOT list_contains({_LETTERS}, x) GROUP BY 1
""")
def unreadable_graphemes(spark, d):
    """What can't be read of two-letter beginnings, single letters and numbers."""
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size"), "p_partkey")
    names = F.array(F.substring("one", 1, 2), F.substring("two", 1, 1), F.col("p_size").cast("string"))
    forms = words.select(F.transform(names, lambda g: F.struct(g.alias("grapheme"))).alias("segments"))
    return corpus.unreadable(forms)


# --- sources


def _cell(word: str):
    """Letters parted by spaces, a morpheme boundary after the second, a gap at the end."""
    letters = counts.letters(F.col(word))
    return F.concat(F.array_join(F.slice(letters, 1, 2), " "), F.lit(" + "), F.array_join(F.slice(letters, 3, 30), " "), F.lit(" -"))


def _long_frame(spark, d) -> DataFrame:
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size", "p_type", "p_brand"), "p_partkey")
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("lect_id"), _cell(c).alias("segments")) for c in ("one", "two")])).alias("s")
    rows = words.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("set"), (F.col("p_size") / 100).cast("string").alias("confidence"), F.col("p_type").alias("etymon_group"), F.col("p_brand").alias("source_group"), sides)
    return rows.select("set", "s.*", "confidence", "etymon_group", "source_group", F.lit("3, 1 0 -2").alias("syllables"))


def _text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def _word():
    return F.array_join("segments.grapheme", "").alias("word")


@query(f"""
SELECT 'p' || p_partkey AS cognate_id, lect AS lect_id, CASE lect WHEN 'one' THEN one ELSE two END AS word, '2' AS breaks, '3,1' AS syllables, round(p_size / 100, 6) AS confidence, p_type AS etymon_group, p_brand AS source_group
FROM ({C_SQL}) JOIN part USING (p_partkey), (VALUES ('one'), ('two')) t(lect)
""")
def src_long(spark, d):
    """The long layout: tokens, morpheme and syllable starts, confidence and labels; the id has another name."""
    rows = corpus.load_long(spark, frame=_long_frame(spark, d), columns={"cognate_id": "set"})
    return rows.select("cognate_id", "lect_id", _word(), _text("breaks"), _text("syllables"), r6("confidence").alias("confidence"), "etymon_group", "source_group")


@query(f"""
WITH l AS (SELECT p_partkey, string_split(two, '') AS ls FROM ({C_SQL}))
SELECT 'p' || p_partkey AS cognate_id, array_to_string(list_transform(ls, lambda x, i: x || '/' || CASE i WHEN 2 THEN '⁵⁵' WHEN len(ls) THEN '³' ELSE '' END || '/' || CASE i WHEN 1 THEN 'long' ELSE '' END || '/' || CASE i WHEN 1 THEN 'primary' ELSE '' END), ' ') AS marks FROM l
""")
def src_marks(spark, d):
    """Tones, stress marks and a column of lengths lifted from segments; a token of tone alone belongs to the segment before it."""
    letters = counts.letters(F.col("two"))
    marked = F.transform(letters, lambda x, i: F.concat(F.when(i == 0, "ˈ").otherwise(""), x, F.when(i == 1, "⁵⁵").otherwise("")))
    length = F.array_join(F.transform(letters, lambda x, i: F.when(i == 0, "long").otherwise("-")), " ")
    frame = words_of_c(spark, d).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("cognate_id"), F.lit("two").alias("lect_id"), F.concat(F.array_join(marked, " "), F.lit(" ³")).alias("segments"), length.alias("length"))
    rows = corpus.load_long(spark, frame=frame)
    return rows.select("cognate_id", F.array_join(F.transform("segments", lambda s: F.concat_ws("/", s["grapheme"], s["tone"], s["length"], s["stress"])), " ").alias("marks"))


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM ({C_SQL}) JOIN part USING (p_partkey))
SELECT p_type || CASE WHEN k > 1 THEN '.' || k ELSE '' END AS cognate_id, lect AS lect_id, CASE lect WHEN 'one' THEN one ELSE two END AS word, CASE lect WHEN 'one' THEN '2' ELSE '' END AS breaks, CASE lect WHEN 'two' THEN '1' ELSE '' END AS syllables,
  CASE lect WHEN 'two' THEN 'primary' ELSE '' END AS first_stress FROM n, (VALUES ('one'), ('two')) t(lect)
""")
def src_wide(spark, d):
    """The wide layout: sets numbered within an id, words cut at morpheme, syllable and stress marks."""
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_type"), "p_partkey")
    frame = words.select("p_type", F.expr("concat(substring(one, 1, 2), '+', substring(one, 3))").alias("one"), F.expr("concat(substring(two, 1, 1), '-', 'ˈ', substring(two, 2))").alias("two"), F.col("p_partkey").alias("at"))
    rows = corpus.load_wide(spark, frame=frame, order="at")
    stress = F.array_max(F.transform("segments", lambda s: s["stress"]))
    return rows.select("cognate_id", "lect_id", _word(), _text("breaks"), _text("syllables"), stress.alias("first_stress"))


@query(f"SELECT CAST(p_size AS VARCHAR) AS cognate_id, p_brand AS lect_id, two AS word FROM ({C_SQL}) JOIN part USING (p_partkey) WHERE p_type = 'PROMO' AND p_brand IN ('Brand#2', 'Brand#4', 'Brand#7')")
def src_gled(spark, d):
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size", "p_type", "p_brand"), "p_partkey")
    frame = words.select(F.col("p_brand").alias("DOCULECT"), F.col("p_type").alias("FAMILY"), F.array_join(counts.letters(F.col("two")), " ").alias("IPA"), F.col("p_size").cast("string").alias("COGSET"))
    return corpus.load_gled(spark, frame=frame, family="PROMO", doculects=["Brand#2", "Brand#4", "Brand#7"]).select("cognate_id", "lect_id", _word())


@query(f"SELECT CAST(p_size AS VARCHAR) AS cognate_id, p_brand AS lect_id, one AS word, '2' AS breaks FROM ({C_SQL}) JOIN part USING (p_partkey) WHERE p_size % 7 <> 0 AND p_size % 5 <> 0")
def src_arcaverborum(spark, d):
    """The first of several cognacies; cells without a value are skipped."""
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size", "p_brand"), "p_partkey")
    cognacy = F.expr("CASE WHEN p_size % 7 = 0 THEN '<NA>' ELSE concat(p_size, ';', p_partkey) END")
    frame = words.select(F.col("p_brand").alias("Language_ID"), F.expr("p_size % 5 = 0").alias("none"), _cell("one").alias("cell"), cognacy.alias("Cognacy"))
    frame = frame.select("Language_ID", "Cognacy", F.when(F.col("none"), "NA").otherwise(F.col("cell")).alias("Segments"))
    return corpus.load_arcaverborum(spark, frame=frame).select("cognate_id", "lect_id", _word(), _text("breaks"))


@query(f"SELECT 'pair' || p_partkey AS cognate_id, lect AS lect_id, CASE lect WHEN 'old' THEN one ELSE two END AS word FROM ({C_SQL}), (VALUES ('old'), ('new')) t(lect)")
def src_pairs(spark, d):
    pairs = words_of_c(spark, d).select(F.col("p_partkey").alias("id"), counts.letters(F.col("one")).alias("source"), counts.letters(F.col("two")).alias("target"))
    return corpus.from_pairs(spark, pairs, "old", "new").select("cognate_id", "lect_id", _word())


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', \"' || p_brand || '\"' || chr(10) || 'x' AS name, p_type AS type FROM part")
def src_records(spark, d):
    """A delimited file read back: quoted cells with delimiters, doubled quotes and line breaks, blank lines between."""
    from lautwerk.operators.graph import Scratch

    scratch = Scratch(spark, "records")
    lines = F.expr("concat(p_partkey, ',\"', p_name, ', \"\"', p_brand, '\"\"\\n', 'x\",', p_type, '\\n')")
    path = f"{scratch.base}/table.csv"
    read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type").select(lines.alias("value")).write.text(path)
    return corpus.read_table(spark, path, sep=",", columns=["id", "name", "type"], multiline=True)


_FORMS = f"SELECT p_type || '-' || p_size % 10 AS c, 'l' || p_partkey % 3 AS l, two AS w, p_size / 100 AS conf FROM ({C_SQL}) JOIN part USING (p_partkey)"


def _forms(spark, d, number: str = "p_size % 10") -> DataFrame:
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size", "p_type", "p_brand"), "p_partkey")
    return corpus.load_long(spark, frame=words.select(
        F.expr(f"concat(p_type, '-', {number})").alias("cognate_id"), F.expr("concat('l', p_partkey % 3)").alias("lect_id"), F.array_join(counts.letters(F.col("two")), " ").alias("segments"),
        (F.col("p_size") / 100).alias("confidence"), F.expr("CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END").alias("etymon_group"), F.expr("concat(p_size % 10)").alias("source_group"),
    ))


@query(f"""
WITH f AS ({_FORMS}), p AS (SELECT c, l, count(*) AS n, list(w ORDER BY w) AS ws FROM f GROUP BY 1, 2), q AS (SELECT c, min(conf) AS conf FROM f GROUP BY 1),
s AS (SELECT *, count(*) OVER (PARTITION BY c) AS lects, least(8, coalesce(product(least(n, 8)) OVER (PARTITION BY c ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS stride, least(8, product(least(n, 8)) OVER (PARTITION BY c)) AS total FROM p),
x AS (SELECT *, unnest(range(0, CAST(total AS BIGINT))) AS i FROM s WHERE lects >= 2)
SELECT c || CASE WHEN total > 1 THEN '#' || i ELSE '' END AS set_id, l AS lect_id, ws[CAST(floor(i / stride) AS BIGINT) % n + 1] AS word, round(conf / total, 6) AS confidence FROM x JOIN q USING (c)
""")
def src_publish(spark, d):
    """Sets of one form per lect: at most eight combinations of doublets, which share the least confidence of the set's rows."""
    return corpus.publish(_forms(spark, d)).select("set_id", "lect_id", _word(), r6("confidence").alias("confidence"))


@query("SELECT p_type || '-' || p_size % 10 AS cognate_id, 'etymon_group' AS label, min(p_brand) AS first, max(p_brand) AS last FROM part WHERE p_size % 3 = 0 GROUP BY 1 HAVING min(p_brand) <> max(p_brand)")
def label_conflicts(spark, d):
    return corpus.label_conflicts(_forms(spark, d))


@query(f"SELECT p_type AS cognate_id, CAST(min(length(one)) AS INTEGER) AS shortest, CAST(max(length(one)) AS INTEGER) AS longest FROM ({C_SQL}) JOIN part USING (p_partkey) GROUP BY 1 HAVING min(length(one)) <> max(length(one))")
def hint_conflicts(spark, d):
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_type"), "p_partkey")
    rows = words.select(F.col("p_type").alias("cognate_id"), F.array_join(F.transform(counts.letters(F.col("one")), lambda x, i: F.when(i == 1, "-").otherwise(x)), " ").alias("alignment"))
    return corpus.hint_conflicts(rows)


@query(f"""
SELECT DISTINCT p_type || '/' || p_size AS cognate_id, p_brand AS lect_id, trim(regexp_replace(two, '(.)', '\\1 ', 'g')) AS segments FROM ({C_SQL}) JOIN part USING (p_partkey)
WHERE p_brand IN ('Brand#2', 'Brand#4', 'Brand#7', 'Brand#11') AND p_partkey % 4 = 0 AND two <> 'rod'
""")
def src_cldf(spark, d):
    """Forms and judgements joined: sets within their concept, doubtful ones and unreadable forms left out, chosen lects only."""
    words = words_of_c(spark, d).join(read(spark, d, "part", "p_partkey", "p_size", "p_type", "p_brand"), "p_partkey")
    letters = F.transform(counts.letters(F.col("two")), lambda x: F.when(F.col("two") == "rod", F.lit("?!")).otherwise(x))
    forms = words.select(F.col("p_partkey").cast("string").alias("ID"), F.col("p_brand").alias("Language_ID"), F.col("p_type").alias("Parameter_ID"), F.array_join(letters, " ").alias("Segments"))
    doubt = F.expr("CASE p_partkey % 4 WHEN 1 THEN 'true' WHEN 2 THEN '1' WHEN 3 THEN 'Yes' END")
    judged = words.select(F.col("p_partkey").cast("string").alias("Form_ID"), F.col("p_size").cast("string").alias("Cognateset_ID"), doubt.alias("Doubt"))
    return lexibank.from_cldf(forms, judged, ["Brand#2", "Brand#4", "Brand#7", "Brand#11"])


@query(f"SELECT 'p' || p_partkey AS set_id, lect AS lect_id FROM ({C_SQL}) JOIN part USING (p_partkey), (VALUES ('one'), ('two')) t(lect) WHERE p_size / 20 > 1 OR (p_size % 20 <> 0)")
def src_faults(spark, d):
    """What training refuses where counts must be whole: confidences outside 0..1, and those that aren't whole."""
    frame = _long_frame(spark, d).withColumn("confidence", F.col("confidence").cast("double") * 5)
    rows = corpus.load_long(spark, frame=frame, columns={"cognate_id": "set"}).withColumnRenamed("cognate_id", "set_id")
    return corpus.faults(rows, whole=True).select("set_id", "lect_id")


@query(f"SELECT CAST(2 * count(*) AS BIGINT) AS tone, CAST(count(*) AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS stress, CAST(0 AS BIGINT) AS with_breaks FROM ({C_SQL})")
def src_annotations(spark, d):
    letters = counts.letters(F.col("two"))
    marked = F.transform(letters, lambda x, i: F.concat(F.when(i == 0, "ˈ").otherwise(""), x, F.when(i <= 1, "⁵").otherwise("")))
    length = F.array_join(F.transform(letters, lambda x, i: F.when(i == 0, "long").otherwise("-")), " ")
    frame = words_of_c(spark, d).select(F.col("p_partkey").cast("string").alias("cognate_id"), F.lit("two").alias("lect_id"), F.array_join(marked, " ").alias("segments"), length.alias("length"))
    return corpus.annotations(corpus.load_long(spark, frame=frame))


@query(f"""
WITH f AS ({_FORMS.replace('p_size % 10', 'p_size')}), u AS (SELECT c, l, count(*) AS n, min(w) AS w, min(conf) AS conf FROM f GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.c AS set_id, a.l AS lect_a, b.l AS lect_b, a.w AS source, b.w AS target FROM u a JOIN u b ON a.c = b.c AND a.l < b.l WHERE a.conf > 0 AND a.c IN (SELECT c FROM f GROUP BY 1 HAVING min(conf) > 0.05)
""")
def form_pairs(spark, d):
    """Every two lects of a set whose forms are single, in order; sets without confidence are left out."""
    from lautwerk.operators import pairwise

    forms = _forms(spark, d, "p_size")
    once = forms.groupBy("cognate_id", "lect_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("cognate_id", "lect_id")
    least = forms.groupBy("cognate_id").agg(F.min("confidence").alias("least"))
    sets = forms.join(once, ["cognate_id", "lect_id"]).join(least, "cognate_id").withColumn("confidence", F.when(F.col("least") > 0.05, F.col("least")).otherwise(0.0))
    out = pairwise.form_pairs(sets.withColumnRenamed("cognate_id", "set_id"))
    return out.select("set_id", "lect_a", "lect_b", F.array_join("source", "").alias("source"), F.array_join("target", "").alias("target"))
