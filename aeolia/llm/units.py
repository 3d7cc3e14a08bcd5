"""Substring dedup by hashing lines: the earliest occurrence of a unit stays, the rest goes.

A unit is a line (or what ``unit`` splits by). It is normalised (ASCII letters in lower case, runs of white
space as one space, ends trimmed) and counts from ``least_words`` words on; digests of 128
bits are grouped over all texts, and of equal units the one ranked first by (id, place) is
kept. Every other one is reported, or taken out, at its original offsets.

Null and empty texts have no units; shorter lines are never taken out. Equal ranks (rows that
repeat an id) count as one occurrence and all stay. Rows without id are left as they are.
Other columns are ignored in the report and kept as they are by ``removed``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import table

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {k: k + 32 for k in range(65, 91)}


def units_of(text: str, unit: str, least_words: int) -> Iterator[tuple[int, int, int, str]]:
    """(order, start, end, normalised) of the units that count."""
    at = 0
    for k, part in enumerate(text.split(unit)):
        plain = " ".join(x for x in _SPACE.split(part) if x).translate(_LOWER)
        if plain.count(" ") + 1 >= least_words and plain:
            yield k, at, at + len(part), plain
        at += len(part) + len(unit)


def occurrences(docs: DataFrame, id_col: str, text_col: str, unit: str, least_words: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, found = [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    new = list(units_of(text or "", unit, least_words))
                    found += new
                    rows += [r] * len(new)
                digest = pa.array([hashlib.blake2b(x[3].encode(), digest_size=16).digest() for x in found], pa.binary())
                num = [pa.array([x[j] for x in found], pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([digest, part.column(0).take(pa.array(rows, pa.int64())), *num], names=["u", "d", "k", "start", "end"])

    named = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where(F.col("d").isNotNull())
    return named.mapInArrow(run, f"u binary, d {kind}, k long, start long, end long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "\n", least_words: int = 1) -> DataFrame:
    """(id, unit, start, end, kept_id, kept_start): every unit that goes, and the one that stays."""
    rows = occurrences(docs, id_col, text_col, unit, least_words)
    # Counted and ranked in parts before the shuffle, so that a common line costs a row for each task.
    first = rows.groupBy("u").agg(F.min(F.struct("d", "k", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").select("u", "f")
    out = rows.join(first, "u").where((F.col("d") != F.col("f.d")) | (F.col("k") != F.col("f.k")))
    return out.select(F.col("d").alias(id_col), F.col("k").alias("unit"), "start", "end", F.col("f.d").alias("kept_id"), F.col("f.start").alias("kept_start"))


def op7_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word counts, so that short lines, the most repeated, are found too."""
    return repeats(table(spark, sf_dir, "documents"), least_words=1)


OP7_ALL_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
placed AS (
  SELECT doc_id, CAST(unit AS BIGINT) AS unit, length(line) AS n,
    CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS plain
  FROM lines),
counted AS (SELECT *, start + n AS "end" FROM placed WHERE plain <> ''),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_id, first_value(start) OVER w AS kept_start, row_number() OVER w AS r
  FROM counted WINDOW w AS (PARTITION BY plain ORDER BY doc_id, unit))
SELECT doc_id, unit, start, "end", kept_id, kept_start FROM ranked WHERE r > 1
"""
