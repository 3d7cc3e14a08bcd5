"""Substring dedup by runs of words: passages of 40 words that stand earlier too, wherever they are cut.

A unit is 40 words on end (`[^\\x20\\x09-\\x0D]+`, ASCII letters in lower case, white space between them as one space). Units start at any
word, so a passage needs no sentence or line of its own. Of 11 units on end the one with the least hash is taken (all, if equal;
a text with fewer units counts as 11): the choice hangs on the 50 words alone, so that two equal passages of
50 words have a unit in common. Digests of 128 bits of the taken units are grouped as in
:mod:`aeolia.llm.stretches`: the earliest by (id, place) is kept, every other one is repeated, and repeated units of a text with no
other taken unit between them make a stretch, which is reported with its original offsets.

So every passage of 50 words that stands in an earlier place is found, and every 40 words reported as a unit do stand there. A stretch may
lack up to 10 words at either end of its passage.

Null and empty texts, and those of less than 40 words, have no units. Rows that repeat an id are one document: what they have at the same
place counts once. Rows without id are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.stretches import MOST_FREQUENT, repeated
from aeolia.llm.tables import table

WORDS = 40
CHOICE = 11
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each start and end, all arithmetic modulo 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_FACTOR, len(values)), out=total[1:])
    return _mixed((total[end] - total[start]) * _powers(_INVERSE, len(values) + 1)[start])


def _extreme(f, x: np.ndarray, width: int) -> np.ndarray:
    """The least or largest of each ``width`` values on end."""
    size = 1
    while 2 * size <= width:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[: len(x) - (width - size)], x[width - size :])


def chosen(order: np.ndarray, choice: int) -> np.ndarray:
    """Places whose value is the least of some ``choice`` values on end around them."""
    width = min(choice, len(order))
    least = _extreme(np.minimum, order, width)
    none = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_extreme(np.maximum, np.concatenate([none, least, none]), width) == order)


def units_of(text: str, words: int = WORDS, choice: int = CHOICE) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Digests, first words and offsets in characters of the taken units."""
    data = text.encode("utf-8", "surrogatepass").lower()
    raw = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    if len(start) < words:
        none = np.zeros(0, np.int64)
        return [], none, none, none
    hashes = _sums(_BYTES[raw], start, end)
    first = np.arange(len(start) - words + 1)
    at = chosen(_sums(hashes, first, first + words), choice)
    parts = data.split()
    digests = [hashlib.blake2b(b" ".join(parts[p : p + words]), digest_size=16).digest() for p in at.tolist()]
    begin, stop = start[at], end[at + words - 1]
    if not text.isascii():
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        begin, stop = chars[begin], chars[stop]
    return digests, at, begin, stop


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, choice: int = CHOICE) -> DataFrame:
    """(u, d, k, start, end, word): digest, id, order, offsets in characters and first word of each taken unit."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [units_of(text or "", words, choice) for text in part.column(1).to_pylist()]
                counts = [len(x[0]) for x in found]
                digest = pa.array([u for x in found for u in x[0]], pa.binary())
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                k = np.concatenate([np.arange(n) for n in counts])
                word, start, end = (np.concatenate([x[j] for x in found]) for j in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([digest, part.column(0).take(rows), *(pa.array(x, pa.int64()) for x in (k, start, end, word))], names=["u", "d", "k", "start", "end", "word"])

    named = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where(F.col("d").isNotNull())
    return named.mapInArrow(run, f"u binary, d {kind}, k long, start long, end long, word long")


def passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, choice: int = CHOICE, most_frequent_units: int = MOST_FREQUENT,
) -> DataFrame:
    """(id, start, end, n_units, n_words, kept_id, kept_start): passages that stand earlier, and where the first unit of each does."""
    again = repeated(units(docs, id_col, text_col, words, choice), most_frequent_units)
    out = again.groupBy("d", "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"),
        (F.max("word") - F.min("word") + words).alias("n_words"), F.min_by("f", F.struct("k", "f")).alias("f"),
    )
    return out.select(F.col("d").alias(id_col), "start", "end", "n_units", "n_words", F.col("f.d").alias("kept_id"), F.col("f.start").alias("kept_start"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
