"""Substring dedup by hashing units of text: the earliest occurrence of a unit stays, later ones go as stretches.

A unit is a sentence within a line: it ends with its full stops, exclamation or question marks, or with the line. It is
normalised (ASCII letters in lower case, runs of white space as one space, ends trimmed) and counts if it has
a word, however short. Digests of 128 bits are grouped over all texts; of equal units the one ranked first by (id,
place) is kept, every other one is repeated. Adjoining repeated units of a text make a stretch, which is reported
with its original offsets; ``least_words`` is asked of whole stretches only, after the grouping.

The most frequent digests (at most ``MOST_FREQUENT``) are broadcast, so that a unit that a third of all texts has is
not joined in one task; all others are joined by digest.

Null and empty texts have no units. Rows that repeat an id are one document: what they have at the same place counts once.
Rows without id are left out of the report and unchanged by :func:`removed`. Other columns are ignored in the report.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolia.llm.tables import most_frequent, shared_folder, table, written

LEAST_WORDS = 40
MOST_FREQUENT = 100_000
_UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+|\n)|[^\n.!?]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {k: k + 32 for k in range(65, 91)}


def units_of(text: str) -> Iterator[tuple[int, int, int, int, str]]:
    """(order, start, end, words, normalised) of the units with a word."""
    k = 0
    for m in _UNIT.finditer(text):
        words = [w for w in _SPACE.split(m[0].translate(_LOWER)) if w]
        if words:
            yield k, m.start(), m.end(), len(words), " ".join(words)
            k += 1


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, d, k, start, end, words): digest, id, order, offsets in characters and words of each unit."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, found = [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    new = list(units_of(text or ""))
                    found += new
                    rows += [r] * len(new)
                digest = pa.array([hashlib.blake2b(x[4].encode(), digest_size=16).digest() for x in found], pa.binary())
                num = [pa.array([x[j] for x in found], pa.int64()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([digest, part.column(0).take(pa.array(rows, pa.int64())), *num], names=["u", "d", "k", "start", "end", "words"])

    named = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where(F.col("d").isNotNull())
    return named.mapInArrow(run, f"u binary, d {kind}, k long, start long, end long, words long")


def repeated(rows: DataFrame, most_frequent_units: int = MOST_FREQUENT) -> DataFrame:
    """The units that are not the first of their digest, with the first one as ``f``; ``stretch`` is equal for adjoining ones of a text."""
    rows = written(rows, shared_folder(rows.sparkSession), "units")
    # Counted and ranked in parts before the shuffle, so that a common unit costs a row for each task.
    first = rows.groupBy("u").agg(F.min(F.struct("d", "k", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = written(first, shared_folder(rows.sparkSession), "first")
    often = most_frequent(first, "n", most_frequent_units).drop("n")
    rare = first.join(F.broadcast(often.select("u")), "u", "left_anti").drop("n")
    met = rows.join(F.broadcast(often), "u")
    others = rows.join(F.broadcast(often.select("u")), "u", "left_anti").join(rare, "u")
    again = met.unionByName(others).where((F.col("d") != F.col("f.d")) | (F.col("k") != F.col("f.k")))
    again = again.dropDuplicates(["d", "k", "start", "end"])
    # A text at a time: its repeated units in order, cut where a unit between them is no repeat.
    order = Window.partitionBy("d").orderBy("k")
    return again.withColumn("stretch", F.col("k") - F.dense_rank().over(order))


def stretches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, most_frequent_units: int = MOST_FREQUENT,
) -> DataFrame:
    """(id, start, end, n_units, n_words, kept_id, kept_start): stretches that go, and where the first unit of each stays."""
    again = repeated(units(docs, id_col, text_col), most_frequent_units)
    out = again.groupBy("d", "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min_by("f", F.struct("k", "f")).alias("f"),
    )
    out = out.where(F.col("n_words") >= least_words)
    return out.select(F.col("d").alias(id_col), "start", "end", "n_units", "n_words", F.col("f.d").alias("kept_id"), F.col("f.start").alias("kept_start"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the stretches of :func:`stretches`; rows without any, or without id, as they are."""
    found = stretches(docs, id_col, text_col, least_words)
    # A document's own stretches, no more than its units.
    cuts = found.groupBy(F.col(id_col).alias("_d")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    out = docs.join(cuts, docs[id_col] == cuts["_d"], "left").drop("_d")

    @F.pandas_udf("string")
    def without(text, cuts):
        def one(t, c):
            if t is None or c is None:
                return t
            at, kept = 0, []
            for x in c:
                kept.append(t[at : x["start"]])
                at = x["end"]
            return "".join([*kept, t[at:]])

        return text.combine(cuts, one)

    text = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("_cuts")))
    return out.withColumn(text_col, text).select(*docs.columns)


def op7_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches(table(spark, sf_dir, "documents"))


OP7_STRETCHES_SQL = f"""
WITH parts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '[^\\n.!?]*(?:[.!?]+|\\n)|[^\\n.!?]+') AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
placed AS (SELECT doc_id, i, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS "end", length(part) AS n,
  trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS plain FROM parts),
units AS (SELECT *, "end" - n AS start, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, length(plain) - length(replace(plain, ' ', '')) + 1 AS words FROM placed WHERE plain <> ''),
ranked AS (SELECT *, first_value(doc_id) OVER w AS kept_id, first_value(start) OVER w AS kept_start, row_number() OVER w AS r FROM units WINDOW w AS (PARTITION BY plain ORDER BY doc_id, k)),
again AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS stretch FROM ranked WHERE r > 1)
SELECT doc_id, min(start) AS start, max("end") AS "end", count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words, arg_min(kept_id, k) AS kept_id, arg_min(kept_start, k) AS kept_start
FROM again GROUP BY doc_id, stretch HAVING sum(words) >= {LEAST_WORDS}
"""
