"""Line dedup by site-relative frequency.

Pages are grouped by host.  For every line, the pages of the host that contain
it are divided by the host's pages; lines whose share exceeds a boilerplate
ratio, on at least a few pages, are dropped from every page of the host.

Counting sees lines only as 64-bit hashes, summed up before they are
shuffled, so a hot host or line costs a task no more than its distinct lines.
Where lines of a hot host meet the pages of it, or those to drop, both sides
are dealt to SALTS keys each: the small side (a row for each host, or for each
line to drop) is copied, the large one isn't.  Texts are joined once, by a key
of the whole row, with the hashes to drop.

Defined cases: null hosts form one group; a null text has no lines and stays
null, an empty one stays empty; lines of ASCII white space only are neither
counted nor dropped; a line that stands twice on a page counts once; a line
whose share is exactly the ratio stays; texts of any length are read whole;
repeated rows are pages of their own; the order of lines stays; an empty table
gives an empty result; columns of other names pass through, also those that
clash with names used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line on more than this share of a host's pages, and on at least so many of them, is boilerplate.
RATIO, MIN_PAGES = 0.02, 3
#: Keys that a hot host or line is dealt to.
SALTS = 16
#: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(text: Column) -> Column:
    """Hashes of the distinct lines that aren't blank."""
    return F.array_distinct(F.transform(F.filter(lines(text), lambda x: F.trim(x, F.lit(BLANK)) != ""), lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, line, pages, host_pages`` of the lines to drop; line is its hash, blank lines apart."""
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    met = docs.select(F.col(host).alias("host"), F.explode(line_hashes(F.col(text))).alias("line"))
    met = met.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    met = met.withColumnRenamed("host", "line_host").withColumn("deal", F.pmod("line", F.lit(SALTS)))
    pages = pages.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = met.join(pages, F.col("line_host").eqNullSafe(F.col("host")) & (F.col("deal") == F.col("salt")))
    return joined.where(F.col("pages") > F.col("host_pages") * F.lit(ratio)).select("host", "line", "pages", "host_pages")


def deduplicated(
    docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None
) -> DataFrame:
    """``docs`` without their boilerplate lines, and with the number of dropped lines if a name for it is given."""
    spare = "_".join(["lw", *sorted(docs.columns)])[:64]
    names = {x: f"{spare}_{x}" for x in ("key", "drop")}
    bad = boilerplate(docs, host, text, ratio, min_pages)
    bad = bad.select(F.col("host").alias("bh"), F.col("line").alias("bl"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("bs"))
    # a row's key is made of all its columns, so copies of a text don't share one
    key = F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if isinstance(docs.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in docs.columns])
    met = docs.select(F.col(host).alias("h"), key.alias("k"), F.explode(line_hashes(F.col(text))).alias("l")).withColumn("s", F.pmod("k", F.lit(SALTS)))
    hit = met.join(bad, F.col("h").eqNullSafe(F.col("bh")) & (F.col("l") == F.col("bl")) & (F.col("s") == F.col("bs")))
    hit = hit.groupBy(F.col("k").alias(names["key"])).agg(F.collect_set("l").alias(names["drop"]))
    joined = docs.join(hit, key == F.col(names["key"]), "left")
    kept = F.filter(lines(F.col(text)), lambda x: (F.trim(x, F.lit(BLANK)) == "") | ~F.array_contains(names["drop"], F.xxhash64(x)))
    gone = F.col(names["drop"]).isNotNull()
    out = {text: F.when(gone, F.array_join(kept, "\n")).otherwise(F.col(text))}
    if dropped:
        out[dropped] = F.when(gone, F.size(lines(F.col(text))) - F.size(kept)).otherwise(0).cast("long")
    order = [*docs.columns, *([dropped] if dropped else [])]
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in order])


def summary(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: doc_id, the lines it had, those dropped, and the digest of its text then."""
    out = deduplicated(docs.select("doc_id", host, "text"), host, dropped="n_dropped")
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", "n_dropped", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256")
    )


SUMMARY_SQL = f"""
WITH pages AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
met AS (
  SELECT source, l, count(*) AS pages FROM (
    SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))) AS l FROM documents
  ) GROUP BY source, l
),
bad AS (
  SELECT met.source, list(l) AS bad FROM met JOIN pages ON met.source IS NOT DISTINCT FROM pages.source
  WHERE met.pages >= {MIN_PAGES} AND met.pages > host_pages * CAST({RATIO} AS DOUBLE) GROUP BY met.source
),
done AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' OR NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM documents LEFT JOIN bad ON documents.source IS NOT DISTINCT FROM bad.source
)
SELECT doc_id, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CAST(coalesce(length(array_to_string(kept, chr(10))), 0) AS BIGINT) AS n_chars,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256
FROM done
"""
