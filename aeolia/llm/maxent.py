"""Language-model scoring with a hashed maximum-entropy model.

A token's probability is that of its class given the words before, times that of the word in
its class. Both factors are softmax models over hashed features: the last word, the last two
together, and skip features of the second and third last. The most frequent tokens are words
of their own, as many as four times the cube root of the number of training tokens, in as many classes as
each has words; all others fall in classes by their last bytes, half as many, within which
smoothed counts over the whole corpus give the word's share, and which stand for them as context. All
sizes grow with the corpus (``Sizes.of``), the work for a token with its sixth root. The
probabilities of all words, known or not, sum to 1.

Counts cover all training texts. Weights are trained in ``ROUNDS`` rounds, each over its own
part of the training texts and all rounds together over every one: each task takes gradient
steps from the round's weights, and the tasks' weights are averaged by their number of tokens. Which texts share a
task depends on how the input is stored, and so do the last digits of the scores.

A null text is empty: its one token is the end. Repeated rows get equal scores, rows without
id too. With no training texts every token has the share of an unknown one. Columns other
than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import most_frequent, shared_folder, table, written
from aeolia.llm.words import slices

WORD_CLASSES, CLASS_SIZE, REST_CLASSES = 32, 32, 16
K = WORD_CLASSES + REST_CLASSES
VOCABULARY = WORD_CLASSES * CLASS_SIZE
CONTEXTS = VOCABULARY + REST_CLASSES + 1
PAIRS = INNER = 1 << 14
MOST_FREQUENT = 1 << 18
ROUNDS, BATCH, RATE = 2, 4096, 0.15
# Tokens scored at a time, few enough that their numbers stay in a core's cache.
SCORED = 2048
END = np.uint64(0x656E64)
BLOCKS = 16
LOG10 = math.log(10)


@dataclass(frozen=True)
class Sizes:
    """Classes of words, words in each, classes of all other tokens, buckets of pairs and of inner features."""

    word_classes: int = WORD_CLASSES
    class_size: int = CLASS_SIZE
    rest_classes: int = REST_CLASSES
    pairs: int = PAIRS
    inner: int = INNER

    @property
    def k(self) -> int:
        return self.word_classes + self.rest_classes

    @property
    def vocabulary(self) -> int:
        return self.word_classes * self.class_size

    @property
    def contexts(self) -> int:
        return self.vocabulary + self.rest_classes + 1

    @staticmethod
    def of(total: int) -> Sizes:
        """From the number of training tokens, at least what the module's constants say."""
        side = max(CLASS_SIZE, math.ceil(2 * total ** (1 / 6)))
        words = side * side
        return Sizes(side, side, side // 2, max(PAIRS, 2 * words), max(INNER, 2 * words))


@dataclass
class Known:
    """The most frequent tokens by hash: counts and places in the vocabulary (-1: none)."""

    h: np.ndarray
    count: np.ndarray
    place: np.ndarray


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, hash, code of the last bytes) of all tokens, an end after each text's words."""
    for at, _, w in slices(column):
        n = len(w.offsets) - 1
        last = w.data[w.end - 1].astype(np.int64)
        before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
        rest = last * 31 + before * 7
        h = w.hashes()
        h = np.where(h == END, h + np.uint64(1), h)
        put = w.first[1:]
        yield at, np.insert(w.row, put, np.arange(n)), np.insert(h, put, np.full(n, END)), np.insert(rest, put, np.zeros(n, np.int64))


def counts(docs: DataFrame) -> DataFrame:
    """(h, rest, c) over all given texts, summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, r) for _, _, h, r in tokens(batch.column(0))]
            if found:
                h, first, c = np.unique(np.concatenate([x[0] for x in found]), return_index=True, return_counts=True)
                rest = np.concatenate([x[1] for x in found])[first]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rest.astype(np.int32)), pa.array(c)], names=["h", "rest", "c"])

    return docs.mapInArrow(run, "h long, rest int, c long").groupBy("h", "rest").agg(F.sum("c").alias("c"))


def looked_up(h: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(count, place) of each token; -1 both where it is not among the frequent."""
    if not len(known.h):
        return np.full(len(h), -1), np.full(len(h), -1)
    u, back = np.unique(h, return_inverse=True)
    p = np.minimum(np.searchsorted(known.h, u), len(known.h) - 1)
    hit = known.h[p] == u
    return np.where(hit, known.count[p], -1)[back], np.where(hit, known.place[p], -1)[back]


def features(place: np.ndarray, rest: np.ndarray, row: np.ndarray, sizes: Sizes = Sizes()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, outer features (n, 4), inner features (n, 2)) of each token."""
    c = np.where(place >= 0, place, sizes.vocabulary + rest)
    past = []
    for k in (1, 2, 3):
        x = np.full(len(c), sizes.contexts - 1)
        same = row[k:] == row[:-k]
        x[k:][same] = c[:-k][same]
        past.append(x)
    pair = (past[0] * 0x9E3779B1 + past[1] * 0x85EBCA77) % 0x7FFFFFFF % sizes.pairs
    outer = np.stack([past[0], sizes.contexts + past[1], 2 * sizes.contexts + past[2], 3 * sizes.contexts + pair], axis=1)
    cls = np.where(place >= 0, place // sizes.class_size, sizes.word_classes + rest)
    inner = np.stack([(past[0] * 0x9E3779B1 + cls * 0xC2B2AE35) % 0x7FFFFFFF % sizes.inner, sizes.inner + (past[1] * 0x85EBCA77 + cls * 0x27D4EB2F) % 0x7FFFFFFF % sizes.inner], axis=1)
    return cls, outer, inner


@dataclass
class Weights:
    outer: np.ndarray
    inner: np.ndarray
    outer_bias: np.ndarray
    inner_bias: np.ndarray

    @staticmethod
    def start(class_counts: np.ndarray, word_counts: np.ndarray, sizes: Sizes = Sizes()) -> Weights:
        log = lambda x: np.log(x + 0.5).astype(np.float32)
        zeros = lambda n, k: np.zeros((n, k), np.float32)
        # A place without a word is never asked for and takes no share.
        inner = np.where(word_counts > 0, log(word_counts), -60).reshape(sizes.word_classes, sizes.class_size).astype(np.float32)
        return Weights(zeros(3 * sizes.contexts + sizes.pairs, sizes.k), zeros(2 * sizes.inner, sizes.class_size), log(class_counts), inner)


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of some rows of a table for each line of ``rows``, added one after another without a copy of all."""
    z = table[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        z += table[rows[:, j]]
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _log_share(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the share of one column in each row's softmax."""
    z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), chosen]
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1))


def log_probability(w: Weights, cls, place, outer, inner) -> np.ndarray:
    """Natural logarithms; of a rest token without its share within the class."""
    out = _log_share(_summed(w.outer, outer) + w.outer_bias, cls)
    own = np.flatnonzero(place >= 0)
    out[own] += _log_share(_summed(w.inner, inner[own]) + w.inner_bias[cls[own]], place[own] % w.inner.shape[1])
    return out


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """One gradient step on the rows of some features, with a rate by row (AdaGrad)."""
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    u, total = ranked[first], np.add.reduceat(g[order], first, axis=0)
    seen[u] += (total * total).mean(axis=1)
    table[u] += RATE * total / np.sqrt(seen[u] + 1e-4)[:, None]


def train_batch(w: Weights, seen: tuple[np.ndarray, np.ndarray], cls, place, outer, inner) -> None:
    for a in range(0, len(cls), BATCH):
        s = np.s_[a : a + BATCH]
        y, o, n = cls[s], outer[s], np.arange(len(cls[s]))
        g = -_softmax(_summed(w.outer, o) + w.outer_bias)
        g[n, y] += 1
        for j in range(o.shape[1]):
            _step(w.outer, seen[0], o[:, j], g)
        own = np.flatnonzero(place[s] >= 0)
        if len(own):
            i = inner[s][own]
            g = -_softmax(_summed(w.inner, i) + w.inner_bias[y[own]])
            g[np.arange(len(own)), place[s][own] % w.inner.shape[1]] += 1
            for j in range(i.shape[1]):
                _step(w.inner, seen[1], i[:, j], g)


def _averaged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of some tasks' changes by their number of tokens, as half-precision numbers."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float16).astype(np.float64) * n for x, n in zip(pdf["v"], pdf["n"], strict=True))
        out = pdf.iloc[:1].copy()
        out["v"], out["n"] = [(total / pdf["n"].sum()).astype(np.float16).tobytes()], [pdf["n"].sum()]
        return out

    return parts.groupBy(*keys).applyInPandas(add, "block int, lane int, n long, v binary")


def trained(docs: DataFrame, w: Weights, known, sizes: Sizes, total: int) -> Weights:
    """The average of the weights that each task reaches from ``w`` on its texts, ``total`` tokens in all."""
    # A task yields all weights, so each has texts of an eighth as many tokens at least; first about the
    # square root of their number is averaged at a time.
    tasks = max(1, 8 * total // (w.outer.size + w.inner.size))
    lanes = math.isqrt(tasks)
    spark = docs.sparkSession
    start = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = start.value
        own = Weights(b.outer.copy(), b.inner.copy(), b.outer_bias, b.inner_bias)
        seen, n = (np.ones(len(own.outer), np.float32), np.ones(len(own.inner), np.float32)), 0
        for batch in batches:
            for _, row, h, rest in tokens(batch.column(0)):
                _, place = looked_up(h, known.value)
                cls, outer, inner = features(place, rest % sizes.rest_classes, row, sizes)
                train_batch(own, seen, cls, place, outer, inner)
                n += len(h)
        if n:
            # Differences to the start, which are small; the means are taken in lanes of tasks.
            flat = np.concatenate([(own.outer - b.outer).ravel(), (own.inner - b.inner).ravel()]).astype(np.float16)
            lane = int(np.bitwise_xor.reduce(np.frombuffer(flat.tobytes()[:4096], np.uint32)) % lanes)
            for k, x in enumerate(np.array_split(flat, BLOCKS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([n], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["block", "lane", "n", "v"])

    parts = docs.coalesce(tasks).mapInArrow(run, "block int, lane int, n long, v binary")
    rows = sorted(_averaged(_averaged(parts, ["block", "lane"]), ["block"]).collect(), key=lambda r: r.block)  # BLOCKS rows
    if not rows:
        return w
    flat = np.concatenate([np.frombuffer(bytes(r.v), np.float16) for r in rows]).astype(np.float32)
    cut = w.outer.size
    return Weights(w.outer + flat[:cut].reshape(w.outer.shape), w.inner + flat[cut:].reshape(w.inner.shape), w.outer_bias, w.inner_bias)


def scored(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score); ``training`` marks the rows to learn from."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(training, F.lit(False)).alias("training"))
    learn = own.where("training")
    all_counts = written(counts(learn.select("t")), folder, "counts")
    total, distinct = all_counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sizes = Sizes.of(total)
    top = most_frequent(all_counts, "c", MOST_FREQUENT).toPandas()  # at most MOST_FREQUENT rows
    top = top.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(h)
    known = spark.sparkContext.broadcast(Known(h[order], c[order], np.where(order < sizes.vocabulary, order, -1)))
    in_words = all_counts.join(F.broadcast(spark.createDataFrame(top[["h"]].head(sizes.vocabulary), "h long")), "h", "left_anti")
    rests = {r.rest: (r.n, r.v) for r in in_words.groupBy((F.col("rest") % sizes.rest_classes).alias("rest")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    words = np.zeros(sizes.vocabulary)
    words[: min(sizes.vocabulary, len(c))] = c[: sizes.vocabulary]
    share = np.array([rests.get(k, (0, 0)) for k in range(sizes.rest_classes)], float)
    w = Weights.start(np.concatenate([words.reshape(sizes.word_classes, sizes.class_size).sum(axis=1), share[:, 0]]), words, sizes)
    if total:
        for k in range(ROUNDS):
            w = trained(learn.where(F.pmod(F.xxhash64("id", "t"), F.lit(ROUNDS)) == k).select("t"), w, known, sizes, total // ROUNDS)
    weights = spark.sparkContext.broadcast(w)
    rest_total = np.log10(share[:, 0] + 0.5 * (share[:, 1] + 1))
    base_total = math.log10(total + 0.5 * (distinct + 1))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row, hashes, rest in tokens(batch.column(1)):
                n = int(row[-1]) + 1 if len(row) else 0
                count, place = looked_up(hashes, known.value)
                rest = rest % sizes.rest_classes
                cls, outer, inner = features(place, rest, row, sizes)
                logs = np.concatenate([log_probability(weights.value, *(x[a : a + SCORED] for x in (cls, place, outer, inner))) for a in range(0, len(cls), SCORED)]) / LOG10
                logs -= np.where(place < 0, rest_total[rest], 0)
                found = count >= 0
                plus = np.where(found, np.log10(np.maximum(count, 0) + 0.5), 0)
                logs += np.where(found & (place < 0), plus, 0)
                add = lambda v: np.bincount(row, weights=v, minlength=n)  # noqa: E731, B023
                size = np.bincount(row, minlength=n)
                # Rare tokens go on by hash and number to meet their counts.
                rare = np.flatnonzero(~found)
                pairs = np.stack([row[rare], hashes[rare].view(np.int64)], axis=1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]) if len(pairs) else np.zeros(0, int)
                times = np.diff(np.r_[first, len(pairs)])
                part = batch.slice(at, n)
                key = part.column(0)
                one = [key, pa.nulls(n, pa.int64()), pa.array(size.astype(np.int64)), pa.array(add(found.astype(float)).astype(np.int64)), pa.array(add(plus) - size * base_total), pa.array(add(logs))]
                two = [key.take(pa.array(pairs[first, 0])), pa.array(pairs[first, 1]), pa.array(times.astype(np.int64)), *(pa.nulls(len(first), t) for t in (pa.int64(), pa.float64(), pa.float64()))]
                for cols in (one, two):
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "h", "n", "known", "base", "model"])

    keyed = own.select(F.xxhash64("id", "t").alias("key"), "t")
    made = written(keyed.mapInArrow(parts, "key long, h long, n long, known long, base double, model double"), folder, "parts")
    rare = made.where("h is not null").select("key", "h", "n")
    # Only counts of rare tokens are met here; frequent ones were added where they stand.
    met = rare.join(all_counts.select("h", "c"), "h", "left").select("key", "n", F.coalesce("c", F.lit(0)).alias("c"))
    sums = met.select("key", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.col("c") + 0.5)).alias("x"), F.lit(0).alias("copies"))
    own_sums = made.where("h is null").select("key", "known", F.lit(0.0).alias("x"), F.lit(1).alias("copies"), "n", "base", "model")
    both = sums.select("*", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("base"), F.lit(0.0).alias("model")).unionByName(own_sums)
    # Rows that repeat id and text share a key; each is one copy of it.
    by_key = both.groupBy("key").agg(*(F.sum(x).alias(x) for x in ("known", "x", "copies", "n", "base", "model")))
    per = lambda x: F.col(x) / F.col("copies")
    by_key = by_key.select("key", per("n").cast("long").alias("n_tokens"), F.round(per("known")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (per("base") + per("x")).alias("base_score"), (per("model") + per("x")).alias("score"))
    return own.select("id", F.xxhash64("id", "t").alias("key")).join(by_key, "key").drop("key").withColumnRenamed("id", id_col)


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    out = scored(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
