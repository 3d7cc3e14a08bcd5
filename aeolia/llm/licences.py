"""Licence scans by sentence rules, with DataFrame functions only.

Sentences are normalised and mapped to identifiers of known licence sentences; a sentence may
be wrapped over lines, behind comment signs too, but ends at an empty line. The identifiers of
a text, in its order, are then matched against ordered rules. A rule matches where its
identifiers follow one another, other known sentences may lie between.

A null text is empty and has no sentences; repeated rows get equal rows; other columns are
ignored. Of equal sentences each occurrence counts; ties between rules do not arise, as every
rule that matches is listed, by name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import table

# Known sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache-ref",
    "licensed under the apache license version 2.0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under the bsd license": "bsd-ref",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software": "gpl-free",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-ref",
    "licensed under the mozilla public license version 2.0": "mpl2-ref",
    "licensed under cc by 4.0": "cc-by-ref",
    "licensed under cc by sa 4.0": "cc-by-sa-ref",
    "licensed under cc by nc 4.0": "cc-by-nc-ref",
    "licensed under cc by nd 4.0": "cc-by-nd-ref",
    "licensed under cc by nc sa 4.0": "cc-by-nc-sa-ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-ref",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "cc-by-sa-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "released into the public domain": "public-domain-ref",
    "all rights reserved": "reserved",
    "spdx license identifier mit": "mit-ref",
    "spdx license identifier apache 2.0": "apache-ref",
    "spdx license identifier gpl 3.0 only": "gpl3-ref",
    "spdx license identifier gpl 3.0 or later": "gpl3-ref",
}
#: Known sentences with what follows the comma in the licences themselves.
CONTINUED = {
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
}
# Ordered rules over identifiers; several rules may name one licence.
RULES = (
    ("apache-2.0", ("apache-ref",)),
    ("apache-2.0", ("apache-head", "apache-compliance")),
    ("apache-2.0", ("apache-compliance", "apache-copy", "apache-as-is")),
    ("bsd", ("bsd-ref",)),
    ("bsd", ("bsd-source", "bsd-binary")),
    ("cc-by-4.0", ("cc-by-ref",)),
    ("cc-by-nc-4.0", ("cc-by-nc-ref",)),
    ("cc-by-nc-sa-4.0", ("cc-by-nc-sa-ref",)),
    ("cc-by-nd-4.0", ("cc-by-nd-ref",)),
    ("cc-by-sa-4.0", ("cc-by-sa-ref",)),
    ("gpl-2.0", ("gpl2-ref",)),
    ("gpl-3.0", ("gpl3-ref",)),
    ("gpl-unversioned", ("gpl-free", "gpl-copy")),
    ("lgpl-3.0", ("lgpl3-ref",)),
    ("mit", ("mit-ref",)),
    ("mit", ("mit-title", "mit-notice")),
    ("mit", ("mit-notice", "mit-warranty")),
    ("mpl-2.0", ("mpl2-ref",)),
    ("public-domain", ("public-domain-ref",)),
    ("rights-reserved", ("reserved",)),
    ("unlicense", ("unlicense-ref",)),
)
NAMES = sorted({name for name, _ in RULES})
#: Every known sentence has one of these words, however it is spaced or wrapped.
MAYBE = "(?i)licen[sc]e|public|reserved|copyright|warranty|software|gnu"
assert all(re.search(MAYBE, s) for s in SENTENCES | CONTINUED)
_BY_WORDS = {s.replace(". ", " "): i for s, i in (SENTENCES | CONTINUED).items()}


def plain(c: Column) -> Column:
    """Lower case, everything but letters, digits and inner dots as one space; L for a line's end, P for a sentence's or an empty line."""
    c = F.regexp_replace(F.lower(c), F.lit(r"\r\n?"), F.lit("\n"))
    steps = (
        (r"[.!?;](?=[\x20\t\n]|$)", "P"), (r"[^a-z0-9.P\n]+", " "), (r"(?<![a-z0-9])\.+|\.+(?![a-z0-9])", " "), (r"\x20+", " "),
        (r"\x20?\n\x20?(?:\n\x20?)+", "P"), (r"\x20?\n\x20?", "L"), (r"\x20?([PL])\x20?", "$1"), (r"^\x20|\x20$", ""),
    )
    for a, b in steps:
        c = F.regexp_replace(c, F.lit(a), F.lit(b))
    return c


def _known() -> str:
    """Known sentences, the longest first, whole between two ends; an end of line may stand between words."""
    gap = lambda s: re.sub(r"(\. )|( )", lambda m: "[ LP]+" if m[1] else "[ L]", s.replace(".0", r"\.0"))
    return "(?<![^LP])(?:" + "|".join(gap(s) for s in sorted(SENTENCES | CONTINUED, key=len, reverse=True)) + ")(?![^LP])"


def _rule(ids: tuple[str, ...]) -> str:
    return "," + ",(?:[^,]+,)*".join(ids) + ","


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sentence_ids, licences): identifiers in the text's order; licences by name."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    parts = F.when(F.col("t").rlike(MAYBE), F.regexp_extract_all(plain(F.col("t")), F.lit(_known()), F.lit(0))).otherwise(none)
    known = F.create_map(*(F.lit(x) for kv in _BY_WORDS.items() for x in kv))
    df = df.select("id", F.transform(parts, lambda x: F.element_at(known, F.regexp_replace(x, F.lit("[ LP]+"), F.lit(" ")))).alias("ids"))
    df = df.withColumn("line", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
    matched = [F.when(F.greatest(*hits) if len(hits := [F.col("line").rlike(_rule(ids)) for n, ids in RULES if n == name]) > 1 else hits[0], F.lit(name)) for name in NAMES]
    return df.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_compact(F.array(*matched)), ",").alias("licences"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL whose patterns cannot look around: ends are doubled instead, so that neighbours share none."""
    steps = (
        (r"\r\n?", r"\n"), (r"[.!?;]([\x20\t\n]|$)", r"P\1"), (r"[^a-z0-9.P\n]+", " "), (r"\.{2,}", " "), (r"(^|[^a-z0-9])\.", r"\1 "), (r"\.([^a-z0-9]|$)", r" \1"),
        (r"\x20+", " "), (r"\x20?\n\x20?(?:\n\x20?)+", "P"), (r"\x20?\n\x20?", "L"), (r"\x20?([PL])\x20?", r"\1"), (r"^\x20|\x20$", ""), ("([LP])", r"\1\1"),
    )
    plain_ = "lower(coalesce(text, ''))"
    for x, y in steps:
        plain_ = f"regexp_replace({plain_}, '{x}', {'chr(10)' if y == chr(92) + 'n' else repr(y).replace(chr(92) * 2, chr(92))}, 'g')"
    gap = lambda s: re.sub(r"(\. )|( )", lambda m: "(?: |LL|PP)+" if m[1] else "(?: |LL)", s.replace(".0", r"\.0"))
    sentences = "|".join(gap(s) for s in sorted(SENTENCES | CONTINUED, key=len, reverse=True))
    known = ", ".join(f"('{s}', '{i}')" for s, i in _BY_WORDS.items())
    rules = ", ".join(f"('{n}', '{_rule(ids)}')" for n, ids in RULES)
    return f"""
WITH known(s, i) AS (VALUES {known}), rules(name, rule) AS (VALUES {rules}),
plain AS (SELECT doc_id, row_number() OVER () AS r, {plain_} AS t FROM documents),
parts AS (SELECT r, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT r, regexp_extract_all('P' || t || 'P', '[LP]({sentences})[LP]', 1) AS p FROM plain)),
named AS (SELECT r, k, i FROM parts JOIN known ON s = regexp_replace(x, '[ LP]+', ' ', 'g')),
seq AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY k) AS ids FROM named GROUP BY r),
found AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM seq JOIN rules ON regexp_matches(',' || ids || ',', rule) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM plain LEFT JOIN seq USING (r) LEFT JOIN found USING (r)
"""


OP10_SQL = _sql()
