"""License scans by sentence rules.

A text is cut into pieces (at line ends, and after . ! ? ; before white
space), each piece is normalised (lower case, everything but letters and
digits as one space, so comment marks go; those of letters, rem and dnl, go
too), and where a piece, or a run of pieces without an empty line between
them, is a known licence sentence, it becomes an identifier: sentences may be
wrapped and stand in comment blocks.  The longest run from a piece counts.  The identifiers of a text, in order, are
matched against ordered licence rules: each rule is a run of identifiers, and
a text holds the rule's licence where the run stands in it, other sentences
aside.  Earlier rules win over later ones of the same family that they
contain.

Defined cases: a null or empty text has no identifiers; a text without known
sentences has empty lists; repeated rows are alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, as normalised, by identifier.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2-long": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}

# Licence rules in order of precedence: licence, then the run of identifiers.
RULES = [
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-title", "asis")),
    ("MIT", ("mit-title-2", "asis")),
    ("Apache-2.0", ("apache-2-long", "apache-comply")),
    ("Apache-2.0", ("apache-2-long",)),
    ("Apache-2.0", ("apache-2",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl-2",)),
    ("ISC", ("isc-grant",)),
]

#: Rules that say nothing new once an earlier one has matched.
COVERED = {"BSD-2-Clause": "BSD-3-Clause"}


def identifiers(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, k)])
    # \n: end of a piece, \f: the same at an empty line, which no sentence crosses
    s = F.lower(F.translate(text, "\f", " "))
    for pattern, by in (
        (r"\n[^a-z0-9]*\n", "\f"),
        (r"(?<![^\n\f])[^a-z0-9\n\f]*(?:rem|dnl)(?=[ \t])", ""),
        (r"(?<=[.!?;])[ \t\r\n]+", "\n"),
        (r"[^a-z0-9\n\f]+", " "),
        (r"[ \n]*\f[ \n\f]*", "\f"),
        (r" ?\n[ \n]*", "\n"),
    ):
        s = F.regexp_replace(s, pattern, by)
    each = "|".join(v.replace(" ", r"[ \n]") for v in sorted(SENTENCES.values(), key=lambda v: (-len(v), v)))
    runs = F.regexp_extract_all(F.concat(F.lit("\f"), F.trim(s), F.lit("\f")), F.lit(rf"(?<=[\n\f])(?:{each})(?=[\n\f])"), F.lit(0))
    ids = F.transform(runs, lambda r: F.element_at(known, F.translate(r, "\n", " ")))
    return F.when(text.rlike("(?i)licen[sc]e|granted|warrant|redistribut|copyright|endorse|copies"), ids).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """Licences of the rules whose runs stand in ``ids``, in order of the rules, each once."""
    run = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(run, F.lit("," + ",".join(r) + ",")), F.lit(name)) for name, r in RULES])))
    for less, more in COVERED.items():
        hits = F.when(F.array_contains(hits, more), F.array_remove(hits, less)).otherwise(hits)
    return hits


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentence_ids and licences."""
    return docs.withColumn("sentence_ids", identifiers(F.col(text))).withColumn("licences", matched(F.col("sentence_ids")))


def summary(docs: DataFrame) -> DataFrame:
    out = scanned(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


def summary_sql() -> str:
    rows = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    hits = ", ".join(f"CASE WHEN contains(run, ',{','.join(r)},') THEN '{name}' END" for name, r in RULES)
    covered = "h"
    for less, more in COVERED.items():
        covered = f"CASE WHEN list_contains({covered}, '{more}') THEN list_filter({covered}, lambda x: x <> '{less}') ELSE {covered} END"
    return f"""
WITH known(s, k) AS (VALUES {rows}),
cut AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+') AS ss
  FROM documents
),
each AS (
  SELECT r, i, trim(regexp_replace(lower(ss[i]), '[^a-z0-9]+', ' ', 'g')) AS s
  FROM (SELECT r, ss, unnest(range(1, len(ss) + 1)) AS i FROM cut)
),
ids AS (SELECT r, list(k ORDER BY i) AS ids FROM each JOIN known USING (s) GROUP BY r),
runs AS (
  SELECT doc_id, coalesce(ids, []) AS ids, ',' || coalesce(array_to_string(ids, ','), '') || ',' AS run FROM cut LEFT JOIN ids USING (r)
),
named AS (SELECT doc_id, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS hs FROM runs),
kept AS (SELECT doc_id, ids, list_filter(hs, lambda x, i: list_position(hs, x) = i) AS h FROM named)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string({covered}, ','), '') AS licences
FROM kept
"""
