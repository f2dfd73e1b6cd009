"""Conversion of CLDF wordlists: forms joined with cognate judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lautwerk.operators.contexts import described


def from_cldf(forms: DataFrame, cognates: DataFrame, lects: list[str] | None = None, min_lects: int = 1) -> DataFrame:
    """``cognate_id, lect_id, segments`` (text) of FormTable and CognateTable.

    A judgement's set is one within its form's concept (Parameter_ID).  Doubtful
    judgements (true, 1, yes), forms without segments and forms with a segment
    that can't be read are left out, and sets of fewer lects than asked for.
    """
    judged = cognates.select(F.col("Form_ID").alias("ID"), F.col("Cognateset_ID").alias("set"), *([F.col("Doubt")] if "Doubt" in cognates.columns else []))
    if "Doubt" in judged.columns:
        judged = judged.where(~F.lower(F.coalesce(F.col("Doubt").cast("string"), F.lit("false"))).isin("true", "1", "yes")).drop("Doubt")
    concept = F.col("Parameter_ID") if "Parameter_ID" in forms.columns else F.lit(None).cast("string")
    rows = forms.select("ID", concept.alias("concept"), F.col("Language_ID").alias("lect_id"), F.col("Segments").alias("segments"))
    if lects is not None:
        rows = rows.where(F.col("lect_id").isin(lects))
    rows = rows.where("segments is not null and trim(segments) <> ''")
    tokens = F.explode(F.array_distinct(F.filter(F.split("segments", r"\s+"), lambda x: ~x.isin("", "+", "-"))))
    each = rows.select("ID", tokens.alias("grapheme"))
    wrong = each.join(described(each).where(F.size("features") == 0), "grapheme").select("ID").distinct()
    met = rows.join(wrong, "ID", "left_anti").join(judged, "ID").select(F.concat_ws("/", "concept", "set").alias("cognate_id"), "lect_id", "segments").distinct()
    if min_lects > 1:
        n = F.size(F.collect_set("lect_id").over(Window.partitionBy("cognate_id")))
        met = met.withColumn("n", n).where(F.col("n") >= min_lects).drop("n")
    return met
