"""Benchmark decontamination by spaced-seed hashing.

Every fixed mask picks some word positions of a window and ignores the others, so that a
window still hits where ignored words were replaced. Hashes of test windows and training
windows are joined; each hit names a diagonal (test item, offset between the two texts), and
along the diagonal all words are compared: the passage counts as contained where the share
of equal words over the longest aligned stretch reaches ``least_share``.

Null and empty texts, and items without words, match nothing. A test item shorter than the
shortest mask is compared as one window of all its words. Repeated rows are reported each
under their own id; of several diagonals of one pair the best is kept, on ties the first.
Of items that repeat an id the text that sorts first counts.
Texts and items of few words repeated many times hit each other nearly everywhere: beyond ``MOST_PAIRS`` hits the
diagonals of a text are found seed by seed, as differences of two sets of places, so that memory grows with
the lengths of the texts and not with their product.
An empty side gives an empty result. Columns other than id and text are ignored.

The test side goes to every task only if it has at most ``MOST_WINDOWS`` windows, a count
made first; beyond that the items are dealt into groups below that size, one pass for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import table
from aeolia.llm.words import Words, slices, windows

#: Fixed masks: word positions that count. The first is contiguous; the others skip words.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 3, 6, 8, 9), (0, 3, 4, 6, 9, 11))
LEAST_WORDS = 8
LEAST_SHARE = 0.8
MOST_WINDOWS = 2_000_000
#: Hits of a slice of texts, or of one text, that are listed one by one.
MOST_PAIRS = 4_000_000
_BITS = 22


class TestSide:
    """All test items' words in one array, and their windows sorted by hash."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, h: np.ndarray, masks):
        self.ids, self.h = ids, h
        self.first = np.searchsorted(row, np.arange(len(ids) + 1))
        self.size = np.diff(self.first)
        found = [seeds(h, row, self.size, m, k) for k, m in enumerate(masks)]
        self.seed = np.concatenate([x[0] for x in found])
        at = np.concatenate([x[1] for x in found])
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.at = self.seed[order], at[order]
        self.row = row
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.seed >> np.uint64(64 - _BITS)] = True

    def hits(self, seed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of training words whose windows hash like test windows, with the first and number of those."""
        few = np.flatnonzero(self.maybe[seed >> np.uint64(64 - _BITS)])
        seed, at = seed[few], at[few]
        low = np.searchsorted(self.seed, seed, "left")
        n = np.searchsorted(self.seed, seed, "right") - low
        met = n > 0
        return at[met], low[met], n[met]

    def diagonals(self, w: Words, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place where the item's first word would lie), in order, for hits of :meth:`hits`."""
        texts = w.row[at]
        size = np.bincount(texts, n, len(w.offsets)).astype(np.int64)
        found = []
        # Texts in runs that list at most MOST_PAIRS hits, or one text that has more.
        order = np.argsort(texts, kind="stable")
        at, low, n, texts = at[order], low[order], n[order], texts[order]
        begin = 0
        while begin < len(at):
            total = np.cumsum(size[texts[begin] :])
            last = texts[begin] + max(1, int(np.searchsorted(total, MOST_PAIRS, "right")))
            end = int(np.searchsorted(texts, last))
            part = slice(begin, end)
            if n[part].sum() <= MOST_PAIRS:
                many = np.repeat(np.arange(begin, end), n[part])
                t = self.at[low[many] + np.arange(len(many)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])]
                item = self.row[t]
                found.append(np.unique(np.stack([texts[many], item, at[many] - (t - self.first[item])]), axis=1))
            else:
                found.append(self._dense(int(texts[begin]), w, at[part], low[part], n[part]))
            begin = end
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)

    def _dense(self, text: int, w: Words, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same of one text: differences of the places of each seed in the text and in each item."""
        start = int(w.first[text])
        length = int(w.first[text + 1]) - start
        held: dict[int, np.ndarray] = {}
        order = np.argsort(low, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
            here = np.unique(at[own] - start)
            there = np.sort(self.at[low[own[0]] : low[own[0]] + n[own[0]]])
            for t in np.split(there, np.flatnonzero(np.diff(self.row[there])) + 1):
                item = int(self.row[t[0]])
                t = t - self.first[item]
                m = int(self.size[item])
                marks = held.setdefault(item, np.zeros(length + m, bool))  # diagonal p at p + m
                if len(here) * len(t) <= 16 * (length + m):
                    marks[(here[:, None] - t[None, :]).ravel() + m] = True
                else:
                    a, b = np.zeros(length), np.zeros(m + 1)
                    a[here], b[m - t] = 1, 1
                    k = 1 << (length + m + 1).bit_length()
                    both = np.fft.irfft(np.fft.rfft(a, k) * np.fft.rfft(b, k), k)[: length + m]
                    marks |= both > 0.5
        rows = []
        for item in sorted(held):
            p = np.flatnonzero(held[item]) - int(self.size[item]) + start
            rows.append(np.stack([np.full(len(p), text), np.full(len(p), item), p]))
        return np.concatenate(rows, axis=1)


def seeds(h, row, size, mask, k) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under a mask; the mask's number is part of them."""
    s, at = windows(h, row, list(mask))
    return s ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1), at


def longest(n: np.ndarray, least_share: float) -> np.ndarray:
    """The most neighbours of the sorted places ``n`` that are ``least_share`` of the stretch from first to last.

    On ties the shortest stretch, then the first one.
    """
    k = np.arange(len(n))
    # The k-th to j-th keep the share where level[j] - level[k] >= least_share - 1.
    level = k - least_share * n
    lowest = np.minimum.accumulate(level)
    begin = np.searchsorted(-lowest, -(level + 1 - least_share) - 1e-9)
    most = np.flatnonzero(k - begin == (k - begin).max())
    j = int(most[np.argmin(n[most] - n[begin[most]])])
    return n[begin[j] : j + 1]


def verified(test: TestSide, w: Words, h: np.ndarray, keys: np.ndarray, least_words: int, least_share: float) -> dict:
    """Best diagonal of each (text, item) whose aligned words agree often enough; ``keys`` are in order."""
    first = w.first
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, i, p in keys.T.tolist():
        if (d, i) in best and best[d, i][0] == test.size[i]:
            continue  # all words of the item: no later diagonal is better
        low, high = max(p, int(first[d])), min(p + int(test.size[i]), int(first[d + 1]))
        if high - low < min(least_words, int(test.size[i])):
            continue
        t = int(test.first[i]) + low - p
        equal = h[low:high] == test.h[t : t + high - low]
        # Stretch of most equal words that starts and ends on one and keeps the share.
        n = np.flatnonzero(equal)
        total = int(test.size[i])
        need = min(least_words, total)
        if len(n) < need:
            continue
        if len(n) < least_share * total:
            n = longest(n, least_share)
            if len(n) < max(need, 13):
                continue
        got = (len(n), -(low + int(n[0]) - int(first[d])), int(n[-1] - n[0]) + 1, total)
        if got > best.get((d, i), (0, 0, 0, 0)):
            best[d, i] = got
    return best


def test_side(tests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per word of the test items: (id, item order, word order, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in slices(batch.column(1)):
                h = w.hashes()
                ids = batch.column(0).slice(at, to - at).take(pa.array(w.row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(h)) - w.first[w.row]), pa.array(h.view(np.int64))], names=["item_id", "k", "h"])

    kind = tests.schema[id_col].dataType.simpleString()
    named = tests.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return named.groupBy("i").agg(F.min("t").alias("t")).mapInArrow(run, f"item_id {kind}, k long, h long")


def contained(
    docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    masks=MASKS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """(doc_id, item_id, n_equal, n_item, start_word, n_span): test items found in training texts.

    ``n_equal`` words agree along the best diagonal, of ``n_item`` in the item; they lie from
    ``start_word`` on in a stretch of ``n_span`` words of the text.
    """
    spark = docs.sparkSession
    words = test_side(tests, item_id, item_text)
    docs = docs.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    kinds = docs.schema["d"].dataType.simpleString(), words.schema["item_id"].dataType.simpleString()
    schema = f"{doc_id} {kinds[0]}, item_id {kinds[1]}, n_equal long, n_item long, start_word long, n_span long"
    n_words = words.count()
    parts = 1 if n_words * len(masks) <= most_windows else -(-n_words * len(masks) // most_windows)
    # Beyond the bound the items are dealt into groups of bounded size, each a pass of its own:
    # the training side is read once for a group, and no task ever holds more than one.
    found = None
    for k in range(parts):
        mine = words if parts == 1 else words.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        got = mine.orderBy("item_id", "k").toPandas()
        ids, row = np.unique(got["item_id"].to_numpy(), return_inverse=True)
        side = spark.sparkContext.broadcast((ids, row.astype(np.int64), got["h"].to_numpy().astype(np.int64).view(np.uint64)))
        one = docs.mapInArrow(_search(side, masks, least_words, least_share), schema)
        found = one if found is None else found.unionByName(one)
    return found


def _search(side, masks, least_words, least_share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestSide(*side.value, masks) if len(side.value[0]) else None
        short = [] if test is None else np.unique(test.size[test.size <= max(m[-1] for m in masks)])
        whole = []
        for n in short:  # items no longer than a mask: all of their words are one window
            at = test.first[:-1][test.size == n]
            s, ok = windows(test.h, test.row, list(range(n)))
            whole.append((int(n), dict(zip(ok.tolist(), s.tolist(), strict=True)), at))
        for batch in batches:
            for at, to, w in slices(batch.column(1)) if test is not None else ():
                h = w.hashes()
                met = [test.hits(*seeds(h, w.row, None, m, k)) for k, m in enumerate(masks)]
                keys = [test.diagonals(w, *(np.concatenate(x) for x in zip(*met, strict=True)))]
                for n, s, starts in whole:
                    mine, ok = windows(h, w.row, list(range(n)))
                    for x in starts.tolist():
                        a = ok[mine == np.uint64(s[x])]
                        keys.append(np.stack([w.row[a], np.full(len(a), test.row[x]), a]))
                keys = np.unique(np.concatenate(keys, axis=1), axis=1)
                if not keys.shape[1]:
                    continue
                best = verified(test, w, h, keys, least_words, least_share)
                if best:
                    rows = [(d, i, *v) for (d, i), v in best.items()]
                    ids = batch.column(0).slice(at, to - at).take(pa.array([r[0] for r in rows]))
                    num = lambda f: pa.array([f(r) for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(test.ids[[r[1] for r in rows]]), num(lambda r: r[2]), num(lambda r: r[5]), num(lambda r: -r[3]), num(lambda r: r[4])],
                        names=["d", "item_id", "n_equal", "n_item", "start_word", "n_span"],
                    )

    return run


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
