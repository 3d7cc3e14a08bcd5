"""Ranked lexical search: accumulator-limited term-at-a-time over blocks of documents.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
The corpus gives N (documents with a term), L (all terms) and df of each query term; a term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))) and a document scores the sum of
w * (1000000000 tf div (1000 tf + 8 m)) over the query's terms, repeats included, m = 25 + 75 n N div L.

Documents are read once into postings of the query terms, written, and ranked block by block in their
tasks. Of each item the rarest terms come first. What the remaining terms can still add is
bounded by their largest entries in the block; once this bound is below the k-th best score so
far (partial scores of the block, final ones of earlier blocks), no further documents get an
accumulator, and those that have one are scored to the end. So nothing is lost, and
a task hands on no more than k rows of an item.

Items are taken in blocks of about ``MOST_TERMS`` distinct terms, which every task holds; more items mean more
passes, not larger tasks. Null and empty texts have no terms: such documents are
not counted and such items have no results. Rows that repeat a document id are documents of their
own. A null document id ranks after others of equal score. Rows that repeat an
item (id and text) are one item; one id with several texts is several items, each with ranks from 1.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolia.llm.tables import shared_folder, table, written

#: Distinct terms of the items that are searched in one pass.
MOST_TERMS = 500_000
#: Postings that a task ranks at once.
MOST_POSTINGS = 2_000_000
_SEGMENT = 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in order, about a megabyte at a time."""
    plain, at = (text or "").encode().translate(_TABLE), 0
    while at < len(plain):
        to = plain.find(b" ", at + _SEGMENT)
        to = len(plain) if to < 0 else to
        yield plain[at:to].split()
        at = to


def _counted(text: str | None, known: dict | None) -> tuple[int, Counter]:
    """How many terms a text has, and how often it has each of the known ones (of all, without ``known``)."""
    n, found = 0, Counter()
    for part in _terms(text):
        n += len(part)
        found.update(part if known is None else map(known.get, part))
    found.pop(None, None)
    return n, found


def _lists(rows: list, kind) -> tuple[pa.Array, pa.Array]:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    keys, counts = [k for r in rows for k in r], [c for r in rows for c in r.values()]
    return pa.ListArray.from_arrays(ends, pa.array(keys, kind)), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))


def _counts_of(texts: DataFrame, keys: list[str], known=None) -> DataFrame:
    """(keys, n, terms, counts) of each text with a term; terms as numbers where a broadcast ``known`` gives them."""
    kind, name = (pa.binary(), "binary") if known is None else (pa.int32(), "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if known is None else known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_counted(t, words) for t in part.column(len(keys)).to_pylist()]
                kept = [k for k, r in enumerate(rows) if r[0]]
                first = [c.take(pa.array(kept, pa.int64())) for c in part.columns[: len(keys)]]
                n = pa.array([rows[k][0] for k in kept], pa.int64())
                yield pa.RecordBatch.from_arrays([*first, n, *_lists([rows[k][1] for k in kept], kind)], names=[*keys, "n", "terms", "counts"])

    types = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "t").mapInArrow(run, f"{types}, n long, terms array<{name}>, counts array<long>")


class Block:
    """Postings of some documents, by term, with what each adds to a score for one occurrence in the query."""

    def __init__(self, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, total: int):
        m = 25 + 75 * n * documents // total
        order = np.argsort(terms, kind="stable")
        self.size, self.rows, terms = len(n), rows[order], terms[order]
        tf = tf[order]
        self.adds = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.rows]))
        self.at = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(self.at[1:] > self.at[:-1])
        if len(held):
            self.most[held] = np.maximum.reduceat(self.adds, self.at[held])

    def scores(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows with an accumulator, their scores, and how many postings made or met one while they were made.

        ``terms`` come rarest first. Rows left out score below ``least`` or below the k-th best row here.
        """
        held = self.most[terms] > 0
        terms, repeats = terms[held], repeats[held]
        bounds = np.cumsum((self.most[terms] * repeats)[::-1])[::-1]
        acc, made, j = np.zeros(self.size, np.int64), 0, 0
        while j < len(terms):
            if made >= k and j:
                so_far = acc[acc > 0]
                reached = max(least, int(np.partition(so_far, -k)[-k])) if len(so_far) >= k else least
            else:
                reached = least
            if bounds[j] < reached:
                break
            at = slice(self.at[terms[j]], self.at[terms[j] + 1])
            acc[self.rows[at]] += repeats[j] * self.adds[at]
            made, j = made + at.stop - at.start, j + 1
        survivors = np.flatnonzero(acc)
        for t, r in zip(terms[j:], repeats[j:], strict=True):
            at = slice(self.at[t], self.at[t + 1])
            rows, adds = self.rows[at], self.adds[at]
            if len(survivors) < len(rows):
                place = np.minimum(np.searchsorted(rows, survivors), len(rows) - 1)
                met = rows[place] == survivors
                acc[survivors[met]] += r * adds[place[met]]
            else:
                met = acc[rows] > 0
                acc[rows[met]] += r * adds[met]
        return survivors, acc[survivors], made


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            kept, size = [*kept, part], size + len(part.column(2).flatten())
            if size >= MOST_POSTINGS:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _ranked(postings: DataFrame, sent, documents: int, total: int, k: int, item_kind: str) -> DataFrame:
    """(item, text, d, score): of each item the k best documents of each task."""
    kind = postings.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best: list[list[tuple]] = [[] for _ in items]
        ids = None
        for part in _blocks(batches):
            ids, lists = part.column("d").combine_chunks(), part.column("terms").combine_chunks()
            n = part.column("n").to_numpy()
            rows = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            block = Block(n, rows, lists.flatten().to_numpy(), part.column("counts").combine_chunks().flatten().to_numpy(), weights, documents, total)
            for found, (_, _, terms, repeats) in zip(best, items, strict=True):
                least = -found[-1][0] if len(found) == k else 1
                at, scores, _ = block.scores(terms, repeats, k, least)
                if len(at) > k:
                    least = max(least, int(np.partition(scores, -k)[-k]))
                at, scores = at[scores >= least], scores[scores >= least]
                new = zip(scores.tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)
                found[:] = sorted([*found, *((-s, d is None, d) for s, d in new)], key=lambda x: x if not x[1] else x[:2])[:k]
        out = [(i[0], i[1], d, -s) for i, found in zip(items, best, strict=True) for s, _, d in found]
        if out:
            item, text, d, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(text, pa.int64()), pa.array(d, ids.type), pa.array(score, pa.int64())], names=["item", "text", "d", "score"])

    return postings.select("d", "n", "terms", "counts").mapInArrow(run, f"item {item_kind}, text long, d {kind}, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", most_terms: int = MOST_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k best documents with a score above 0."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    asked = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("t")).distinct().withColumn("text", F.xxhash64("t"))
    asked = written(_counts_of(asked, ["item", "text"]), folder, "items")
    parts = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms))
    item_kind, out = asked.schema["item"].dataType.simpleString(), None
    for part in range(parts):
        # About most_terms terms come to the driver, which hands them to the tasks.
        own = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).select("item", "text", "terms", "counts").collect()
        numbers = {t: k for k, t in enumerate(sorted({bytes(t) for r in own for t in r["terms"]}))}
        postings = written(_counts_of(named, ["d"], spark.sparkContext.broadcast(numbers)), folder, f"postings{part}")
        documents, total = postings.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(max(1, len(numbers)), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
        searched = []
        for r in own:
            terms = np.array([numbers[bytes(t)] for t in r["terms"]], np.int64)
            order = np.lexsort((terms, df[terms]))
            searched.append((r["item"], r["text"], terms[order], np.array(r["counts"], np.int64)[order]))
        found = _ranked(postings, spark.sparkContext.broadcast((searched, weights)), documents, total or 1, k, item_kind)
        out = found if out is None else out.unionByName(found)
    best = (F.desc("score"), F.asc_nulls_last("d"))
    # First in parts of each item: with very many tasks their rows are many.
    out = out.withColumn("part", F.pmod(F.xxhash64("d"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "text", "part").orderBy(*best)))
    out = out.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item", "text").orderBy(*best)))
    return out.where(F.col("rank") <= k).select(F.col("item").alias(item_id_col), "rank", F.col("d").alias(id_col), "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
