"""Corpus sources: tabular layouts of related forms, as one long table.

Every loader returns ``cognate_id, lect_id, segments, confidence,
etymon_group, source_group, breaks, syllables``; segments is an array of
struct(grapheme, tone, length, stress), breaks the indices of morpheme starts,
syllables those of syllable starts that are given (none: to be computed).
Columns are found by their header.  ``publish`` makes sets of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lautwerk.operators.grouping import combinations

TONE = "⁰¹²³⁴⁵⁶⁷⁸⁹˥˦˧˨˩"
SEGMENT = "struct<grapheme:string,tone:string,length:string,stress:string>"
COLUMNS = ["cognate_id", "lect_id", "segments", "confidence", "etymon_group", "source_group", "breaks", "syllables"]


def read_table(
    spark: SparkSession, path: str | None = None, text: str | None = None, sep: str = "\t", frame: DataFrame | None = None, columns: list[str] | None = None, multiline: bool = False
) -> DataFrame:
    """A delimited file, or the same as text, by its header; doubled quotes, CRLF and blank lines as CSV has them.

    frame: a table that is there already, taken as it is; columns: names for a file without a header; multiline: quoted
    cells may hold line breaks (a file is then read by one task).
    """
    if frame is not None:
        return frame
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("multiLine", multiline)
    reader = reader.option("header", True) if columns is None else reader.schema(", ".join(f"`{c}` string" for c in columns))
    if path is not None:
        return reader.csv(path)
    lines = [line for line in (text or "").splitlines() if line.strip()]
    return reader.csv(spark.sparkContext.parallelize(lines, 1))


def tokens(cell: Column) -> Column:
    """White-space tokens without alignment gaps."""
    return F.filter(F.split(F.trim(F.coalesce(cell, F.lit(""))), r"\s+"), lambda x: (x != "") & (x != "-"))


def morpheme_breaks(cell: Column) -> Column:
    """Indices of segments that follow a '+'."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, x: Column) -> Column:
        plus = x == "+"
        return F.struct((s["n"] + F.when(plus, 0).otherwise(1)).alias("n"), F.when(plus & (s["n"] > 0), F.concat(s["at"], F.array(s["n"]))).otherwise(s["at"]).alias("at"))

    return F.aggregate(tokens(cell), start, step, lambda s: s["at"])


def break_indices(cell: Column) -> Column:
    """A list of positive integers, parted by commas or spaces."""
    parts = F.split(F.coalesce(cell, F.lit("")), r"[,\s]+")
    return F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x > 0)


def lifted(cell: Column) -> Column:
    """Segments with their tone marks, stress marks and length signs taken out; a token of tone marks alone belongs to the segment before it."""
    plain = F.filter(tokens(cell), lambda x: x != "+")
    empty = F.array().cast(f"array<{SEGMENT}>")

    def parsed(x: Column) -> Column:
        tone = F.regexp_extract(x, f"[{TONE}]+$", 0)
        body = F.regexp_replace(x, f"[{TONE}]+$", "")
        stress = F.when(F.startswith(body, F.lit("ˈ")), "primary").when(F.startswith(body, F.lit("ˌ")), "secondary").otherwise("")
        body = F.regexp_replace(body, "^[ˈˌ]", "")
        return F.struct(body.alias("grapheme"), tone.alias("tone"), F.lit("").alias("length"), stress.alias("stress"))

    def step(acc: Column, x: Column) -> Column:
        p = parsed(x)
        last = F.element_at(acc, -1)
        joins = (p["grapheme"] == "") & (F.size(acc) > 0)
        moved = F.struct(last["grapheme"].alias("grapheme"), p["tone"].alias("tone"), last["length"].alias("length"), last["stress"].alias("stress"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(moved))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(plain, empty, step)


def attached(segments: Column, cell: Column, field: str) -> Column:
    """Segments with a dimension of their own column, by position; '-' leaves a segment as it is, another length is an error."""
    values = F.filter(F.split(F.trim(F.coalesce(cell, F.lit(""))), r"\s+"), lambda x: x != "")
    names = ["grapheme", "tone", "length", "stress"]

    def put(s: Column, v: Column) -> Column:
        return F.struct(*[(F.when((v != "-") & v.isNotNull(), v).otherwise(s[n]) if n == field else s[n]).alias(n) for n in names])

    same = (F.size(values) == 0) | (F.size(values) == F.size(segments))
    joined = F.zip_with(segments, values, put)
    return F.when(~same, F.raise_error(F.concat(F.lit(f"{field}: count of values differs from segments in "), cell)).cast(f"array<{SEGMENT}>")).when(
        F.size(values) == 0, segments
    ).otherwise(joined)


def alignment_tokens(cell: Column) -> Column:
    """How many columns an aligned cell has, gaps included; none for a blank one."""
    n = F.size(F.filter(F.split(F.trim(F.coalesce(cell, F.lit(""))), r"\s+"), lambda x: x != ""))
    return F.when(n > 0, n)


def hint_conflicts(rows: DataFrame, cognate: str = "cognate_id", cell: str = "alignment") -> DataFrame:
    """Sets whose aligned cells don't have the same number of columns: ``cognate_id, shortest, longest``."""
    n = rows.groupBy(F.col(cognate).alias("cognate_id")).agg(F.min(alignment_tokens(F.col(cell))).alias("shortest"), F.max(alignment_tokens(F.col(cell))).alias("longest"))
    return n.where("shortest <> longest")


def label_conflicts(forms: DataFrame) -> DataFrame:
    """Sets whose rows name different etymon or source groups: ``cognate_id, label, first, last``; empty labels don't count."""
    out = None
    for label in ("etymon_group", "source_group"):
        n = forms.where(F.col(label) != "").groupBy("cognate_id").agg(F.min(label).alias("first"), F.max(label).alias("last")).where("first <> last")
        n = n.select("cognate_id", F.lit(label).alias("label"), "first", "last")
        out = n if out is None else out.unionByName(n)
    return out


def _shaped(df: DataFrame, cognate: Column, lect: Column, cell: Column) -> DataFrame:
    have = {c.lower(): c for c in df.columns}

    def column(name: str) -> Column:
        return F.col(f"`{have[name]}`") if name in have else F.lit(None).cast("string")

    segments = lifted(cell)
    for field in ("tone", "length", "stress"):
        if field in have:
            segments = attached(segments, column(field), field)
    out = df.select(
        F.trim(cognate).alias("cognate_id"),
        F.trim(lect).alias("lect_id"),
        segments.alias("segments"),
        F.coalesce(column("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(column("etymon_group"), F.lit("")).alias("etymon_group"),
        F.coalesce(column("source_group"), F.lit("")).alias("source_group"),
        (break_indices(column("breaks")) if "breaks" in have else morpheme_breaks(cell)).alias("breaks"),
        (break_indices(column("syllables")) if "syllables" in have else F.array().cast("array<int>")).alias("syllables"),
    )
    return out.where((F.coalesce("cognate_id", F.lit("")) != "") & (F.coalesce("lect_id", F.lit("")) != "") & (F.size("segments") > 0))


def load_long(spark: SparkSession, path: str | None = None, text: str | None = None, frame: DataFrame | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """A row per form: cognate_id, lect_id, segments, and what else there is; columns: names in the table of what is called otherwise here.

    Aligned cells (column alignment) whose sets disagree in their number of columns are refused.
    """
    df = read_table(spark, path, text, frame=frame)
    for ours, theirs in (columns or {}).items():
        df = df.withColumnRenamed(theirs, ours)
    missing = {"cognate_id", "lect_id", "segments"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if "alignment" in df.columns:
        wrong = hint_conflicts(df).first()
        if wrong is not None:
            raise ValueError(f"set {wrong.cognate_id}: aligned cells of {wrong.shortest} and {wrong.longest} columns")
    return _shaped(df, F.col("cognate_id"), F.col("lect_id"), F.col("segments"))


def cut_cells(df: DataFrame, column: str, out: str = "cell") -> DataFrame:
    """``df`` with whole words of a column cut into graphemes: ``out`` (tokens, '+' between morphemes) and ``<out>_syllables`` (where '-' stood).

    Each distinct word is cut once, in Arrow batches, and joined back; words that hold spaces are tokens already.
    """
    from lautwerk.functions.features import segment_word

    @F.pandas_udf("cell string, syllables string")
    def cut(words: pd.Series) -> pd.DataFrame:
        rows = []
        for word in words:
            if not word or " " in word.strip():
                rows.append((word, None))
                continue
            tokens, starts, n = [], [], 0
            for k, part in enumerate(word.strip().split("+")):
                tokens += ["+"] if k else []
                for i, piece in enumerate(part.split("-")):
                    own = segment_word(piece)
                    if i and n and own:
                        starts.append(n)
                    tokens += own
                    n += len(own)
            rows.append((" ".join(tokens), " ".join(map(str, starts))))
        return pd.DataFrame(rows, columns=["cell", "syllables"])

    words = df.select(F.col(column).alias("lw_word")).where("lw_word is not null").distinct().withColumn("lw_cut", cut("lw_word"))
    words = words.select("lw_word", F.col("lw_cut.cell").alias(out), F.col("lw_cut.syllables").alias(f"{out}_syllables"))
    return df.join(words, F.col(column) == F.col("lw_word"), "left").drop("lw_word")


def load_wide(spark: SparkSession, path: str | None = None, text: str | None = None, frame: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """A row per set, a column per lect; whole words are cut into graphemes where they hold no spaces.

    Rows of one id are sets of their own, numbered in the order of a column, or as they are read.
    """
    df = read_table(spark, path, text, frame=frame)
    place = F.col(order) if order else F.monotonically_increasing_id()
    df = df.withColumn("lw_place", place).drop(*([order] if order else []))
    key = next(c for c in df.columns if c != "lw_place")
    companions = ("_breaks", "_syllables", "_tone", "_stress", "_length")
    fixed = {"confidence", "etymon_group", "source_group", "lw_place", key}
    lects = [c for c in df.columns if c not in fixed and not (c.endswith(companions) and c.rsplit("_", 1)[0] in df.columns)]
    if len(lects) < 2:
        raise ValueError("at least two lects are needed")
    again = F.row_number().over(Window.partitionBy(key).orderBy("lw_place"))
    df = df.withColumn("cognate_id", F.when(again > 1, F.concat_ws(".", key, again.cast("string"))).otherwise(F.col(key)))
    given = ("tone", "stress", "length", "breaks", "syllables")
    forms = F.explode(F.array(*[F.struct(F.lit(c).alias("lect_id"), F.col(f"`{c}`").alias("word"), *[(F.col(f"`{c}_{d}`") if f"{c}_{d}" in df.columns else F.lit(None).cast("string")).alias(d) for d in given]) for c in lects]))
    keep = [c for c in ("confidence", "etymon_group", "source_group") if c in df.columns]
    rows = cut_cells(df.select("cognate_id", *keep, forms.alias("f")).select("cognate_id", *keep, "f.*"), "word")
    rows = rows.withColumn("syllables", F.coalesce("syllables", "cell_syllables"))
    rows = rows.drop(*[d for d in given[:-1] if not any(f"{c}_{d}" in df.columns for c in lects)])
    return _shaped(rows, F.col("cognate_id"), F.col("lect_id"), F.col("cell"))


def load_gled(spark: SparkSession, path: str | None = None, text: str | None = None, family: str | None = None, doculects: list[str] | None = None, frame: DataFrame | None = None) -> DataFrame:
    """DOCULECT, FAMILY, IPA, COGSET, by family and doculects."""
    df = read_table(spark, path, text, frame=frame)
    if family is not None:
        df = df.where(F.col("FAMILY") == family)
    if doculects is not None:
        df = df.where(F.col("DOCULECT").isin(doculects))
    return _shaped(df, F.col("COGSET"), F.col("DOCULECT"), F.col("IPA"))


def load_arcaverborum(spark: SparkSession, path: str | None = None, text: str | None = None, sep: str = ",", frame: DataFrame | None = None) -> DataFrame:
    """Language_ID, Segments, Cognacy: the first of several cognacies; NA cells are skipped."""
    df = read_table(spark, path, text, "\t" if path and path.endswith((".tsv", ".tab")) else sep, frame)
    first = F.trim(F.split_part("Cognacy", F.lit(";"), F.lit(1)))
    df = df.where(~first.isin("", "<NA>", "NA") & ~F.coalesce("Segments", F.lit("NA")).isin("<NA>", "NA"))
    return _shaped(df, first, F.col("Language_ID"), F.col("Segments"))


def from_pairs(spark: SparkSession, pairs: list[tuple[list[str], list[str]]] | DataFrame, lect_a: str, lect_b: str, prefix: str = "pair") -> DataFrame:
    """Directed pairs of graphemes as sets of two lects; pairs: a list, or a table ``id, source, target`` (arrays)."""
    if isinstance(pairs, DataFrame):
        sides = F.explode(F.array(*[F.struct(F.lit(l).alias("lect_id"), F.array_join(c, " ").alias("segments")) for l, c in ((lect_a, "source"), (lect_b, "target"))]))
        df = pairs.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("cognate_id"), sides.alias("s")).select("cognate_id", "s.*")
    else:
        rows = [(f"{prefix}{k}", lect, " ".join(word)) for k, both in enumerate(pairs) for lect, word in zip((lect_a, lect_b), both)]
        df = spark.createDataFrame(rows, "cognate_id string, lect_id string, segments string")
    return _shaped(df, F.col("cognate_id"), F.col("lect_id"), F.col("segments"))


def publish(forms: DataFrame, min_lects: int = 2, cap: int = 8) -> DataFrame:
    """Sets of one form per lect: doublets become combinations (at most ``cap``), which share the set's confidence, the least of its rows.

    A set's labels are those of the rows that have one; ``label_conflicts`` tells sets whose rows disagree, which training refuses.
    """
    w = Window.partitionBy("cognate_id")
    base = forms.groupBy("cognate_id").agg(F.min("confidence").alias("confidence"), F.max("etymon_group").alias("etymon_group"), F.max("source_group").alias("source_group"))
    form = F.to_json(F.struct("segments", "breaks", "syllables"))
    numbered = forms.select("cognate_id", "lect_id", "segments", "breaks", "syllables", form.alias("form"))
    numbered = numbered.withColumn("k", F.row_number().over(Window.partitionBy("cognate_id", "lect_id").orderBy("form"))).where(F.col("k") <= cap)
    wide = numbered.withColumn("lects", F.size(F.collect_set("lect_id").over(w))).where(F.col("lects") >= min_lects)
    chosen = combinations(forms.select("cognate_id", "lect_id", form.alias("form")), "cognate_id", "lect_id", "form", cap)
    met = wide.join(chosen.select("cognate_id", "lect_id", "k", "combination", "combinations"), ["cognate_id", "lect_id", "k"]).join(base, "cognate_id")
    name = F.when(F.col("combinations") > 1, F.concat_ws("#", "cognate_id", F.col("combination").cast("string"))).otherwise(F.col("cognate_id"))
    share = (F.col("confidence") / F.col("combinations")).alias("confidence")
    return met.select(name.alias("set_id"), "cognate_id", share, "etymon_group", "source_group", "lect_id", "segments", "breaks", "syllables")


def faults(sets: DataFrame, whole: bool = False) -> DataFrame:
    """Rows that training refuses: empty forms, confidences outside 0..1 or, where they must be, not whole."""
    wrong = (F.size("segments") == 0) | ~F.col("confidence").between(0, 1) | F.isnan("confidence")
    return sets.where(wrong | (F.col("confidence") != F.round("confidence")) if whole else wrong)


def annotations(forms: DataFrame) -> DataFrame:
    """How many segments carry tone, length and stress, and how many forms have breaks."""
    s = F.explode("segments")
    counted = forms.select("breaks", s.alias("s"))
    marks = counted.agg(*[F.count_if(F.col(f"s.{c}") != "").alias(c) for c in ("tone", "length", "stress")])
    return marks.crossJoin(forms.agg(F.count_if(F.size("breaks") > 0).alias("with_breaks")))


def unreadable(forms: DataFrame) -> DataFrame:
    """Graphemes without features, by count: looked up once each."""
    from lautwerk.functions.features import diagnose

    @F.udf("status string, prefix string, offending string")
    def look(g: str):
        return diagnose(g)

    counted = forms.select(F.explode("segments.grapheme").alias("grapheme")).groupBy("grapheme").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("d", look("grapheme")).where("d.status <> 'ok'").select("grapheme", "count", "d.*").orderBy(F.desc("count"), "grapheme")
