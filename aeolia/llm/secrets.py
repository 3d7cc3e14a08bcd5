"""Secret scans with a linear-chain conditional random field.

Fixed patterns give the spans that always count. A conditional random field then tags every
word as begin, inside or outside of a secret from its shape, its neighbours and traits of the
whole text, and Viterbi decoding adds spans that no pattern names. It is trained on a bounded
sample of texts (``MOST_HIT`` with a pattern's span, ``MOST_PLAIN`` without, by a hash of the
id), the patterns' spans being the tags; the patterns' own words are not traits.

Null and empty texts have no spans. Spans are code points, end exclusive; equal spans of
different kinds are all listed, by start and then kind. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import table
from aeolia.llm.words import Words, slices

KINDS = ("assign", "access", "hex", "tagged")
MOST_HIT, MOST_PLAIN = 800, 800
# Fixed patterns and bounds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TRIM = "\"'`()[]{}<>,;:"
O, B, I = range(3)  # noqa: E741


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    low, out = text.lower(), []
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# Traits of a byte, summed over each word.
_CLASSES = np.zeros((7, 256), np.int32)
_CLASSES[0, 48:58] = 1
_CLASSES[1, 65:91] = 1
_CLASSES[2, 97:123] = 1
_CLASSES[3, [ord(c) for c in "+/_-"]] = 1
_CLASSES[4, [ord(c) for c in "=:"]] = 1
_CLASSES[5, 128:] = 1
_CLASSES[6, [*range(48, 58), *range(97, 103)]] = 1
_TRAITS = 25
TRAITS = 3 * _TRAITS + 4


def word_traits(w: Words) -> np.ndarray:
    """A row of 0 and 1 for each word, from its own shape alone."""
    size = w.end - w.start
    count = []
    for c in _CLASSES:
        total = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(c[w.data], dtype=np.int32, out=total[1:])
        count.append(total[w.end] - total[w.start])
    digit, upper, lower, joint, sign, wide, hexa = count
    other = size - digit - upper - lower - joint - sign - wide
    first_upper = (w.data[w.start] >= 65) & (w.data[w.start] <= 90)
    last = w.data[w.end - 1]
    # How often the kind of character changes between letters and digits says how random a word looks.
    kind = np.where(_CLASSES[0][w.data] == 1, 1, np.where((_CLASSES[1] + _CLASSES[2])[w.data] == 1, 2, 0))
    flips = np.zeros(len(w.data) + 1, np.int32)
    np.cumsum((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0), dtype=np.int32, out=flips[2:] if len(w.data) else flips[:0])
    flip = flips[w.end] - flips[np.minimum(w.start + 1, w.end)]
    cols = [
        np.ones(len(size), bool), size <= 3, (size > 3) & (size < 8), (size >= 8) & (size < 16), (size >= 16) & (size < 24), size >= 24, size >= 40,
        digit > 0, digit == size, 2 * digit > size, upper > 0, upper == size, (upper > 0) & (lower > 0) & (digit > 0), (lower > 0) & (digit > 0), (upper > 0) & (digit > 0),
        first_upper & (upper == 1), joint > 0, sign > 0, (last == 61) | (last == 58), wide > 0, other > 0, hexa == size, flip >= 3, flip >= 6, (size == 1) & (sign == 1),
    ]
    return np.stack(cols, axis=1)


def traits(w: Words) -> np.ndarray:
    """Own shape, both neighbours' shapes, and traits of the text each word stands in."""
    own = word_traits(w)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = w.row[1:] == w.row[:-1]
    before[1:] = own[:-1] & same[:, None]
    after[:-1] = own[1:] & same[:, None]
    first = w.first
    n = np.maximum(1, np.diff(first))
    share = np.add.reduceat(np.vstack([own[:, [7, 17, 20]], np.zeros((1, 3), bool)]).astype(np.int64), np.minimum(first[:-1], len(own)), axis=0)
    share = np.where(np.diff(first)[:, None] > 0, share, 0) / n[:, None]
    text = np.column_stack([share > 0.1, n < 100])
    return np.hstack([own, before, after, text[w.row]])


def fit_crf(x: np.ndarray, tags: np.ndarray, mask: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge by gradient steps (Adam), on sequences padded to one length.

    x: (sequences, length, traits); tags and mask: (sequences, length). Returns the words'
    weights (traits, 3) and those of the transitions (3, 3).
    """
    s, n, k = x.shape
    weights, moves = np.zeros((k, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(a) for a in (weights, weights, moves, moves)]
    gold = np.eye(3)[tags] * mask[..., None]
    pair = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("sta,stb->ab", gold[:, :-1] * pair[..., None], gold[:, 1:])
    flat = x.reshape(s * n, k).astype(np.float32)
    for step in range(1, rounds + 1):
        e = (flat @ weights.astype(np.float32)).reshape(s, n, 3).astype(float)
        m = moves.copy()
        m[O, I] = -1e4
        f, b = np.zeros((s, n, 3)), np.zeros((s, n, 3))
        f[:, 0] = e[:, 0] + np.array([0, 0, -1e4])
        for t in range(1, n):
            f[:, t] = np.where(mask[:, t, None], e[:, t] + np.logaddexp.reduce(f[:, t - 1, :, None] + m, axis=1), f[:, t - 1])
        for t in range(n - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(m + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2), b[:, t + 1])
        z = np.logaddexp.reduce(f[:, -1], axis=1)
        p = np.exp(f + b - z[:, None, None]) * mask[..., None]
        two = np.exp(f[:, :-1, :, None] + m + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[..., None, None]
        grads = (flat.T @ (gold - p).reshape(s * n, 3) / s - 1e-4 * weights, (gold_moves - two.sum(axis=(0, 1))) / s - 1e-4 * moves)
        for j, (a, g) in enumerate(zip((weights, moves), grads, strict=True)):
            moments[2 * j] = 0.9 * moments[2 * j] + 0.1 * g
            moments[2 * j + 1] = 0.99 * moments[2 * j + 1] + 0.01 * g * g
            a += 0.15 * (moments[2 * j] / (1 - 0.9**step)) / (np.sqrt(moments[2 * j + 1] / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def viterbi(e: np.ndarray, row: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of all words, each text a sequence of its own.

    Where 'outside' is ahead of the other tags by more than all moves can give, every best
    path passes it; only the stretches between such words are decoded, many at a time.
    """
    m = moves.copy()
    m[O, I] = -1e6
    gap = 2 * (moves.max() - moves.min())
    sure = e[:, O] - e[:, [B, I]].max(axis=1) > gap
    tags = np.zeros(len(e), np.int8)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    new = np.r_[True, (np.diff(open_) > 1) | (row[open_[1:]] != row[open_[:-1]])]
    begin = open_[new]
    size = np.diff(np.r_[np.flatnonzero(new), len(open_)])
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    is_first = np.r_[True, row[1:] != row[:-1]][begin]
    end = begin + size
    has_next = (end < len(e)) & (row[np.minimum(end, len(e) - 1)] == row[begin])
    best = e[begin] + np.where(is_first[:, None], np.array([0, 0, -1e6]), m[O])
    came = []
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))
        step = best[:n, :, None] + m
        came.append(step.argmax(axis=1))
        best[:n] = step.max(axis=1) + e[begin[:n] + t]
    tag = (best + np.where(has_next[:, None], m[:, O], 0)).argmax(axis=1)
    tags[end - 1] = tag
    for t in range(int(size[0]) - 1, 0, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        tag[:n] = came[t - 1][np.arange(n), tag[:n]]
        tags[begin[:n] + t - 1] = tag[:n]
    return tags


def _tagged_words(text: str) -> tuple[Words, np.ndarray]:
    """Words of one text and the tags that the patterns give them."""
    raw = text.encode()
    _, _, w = next(slices(pa.array([text], pa.string()), lower=False, most=len(raw) + 1))
    tags, at = np.zeros(len(w.row), np.int64), np.cumsum((w.data & 0xC0) != 0x80) if len(w.data) else np.zeros(0, int)
    for start, _, end in patterns(text):
        low, high = np.searchsorted(at, start + 1), np.searchsorted(at, end)
        touched = np.flatnonzero((w.start <= high) & (w.end > low))
        if len(touched):
            tags[touched] = np.where(tags[touched] == B, B, I)
            if tags[touched[0]] != B and not (tags[touched] == B).any():
                tags[touched[0]] = B
    return w, tags


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_hit: int = MOST_HIT, most_plain: int = MOST_PLAIN, length: int = 16):
    """Weights from the sample; None if no text has a span."""
    text = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    # The sample is found by a JVM expression; the exact patterns then tag it.
    hit = F.expr("t rlike '(?i:password|passwd|secret|token|api_?key)[\"'']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}'")
    ranked = text.select("d", F.xxhash64("d", "t").alias("h"), hit.alias("hit"))
    ids = [ranked.where(F.col("hit") == k).orderBy("h").limit(n) for k, n in ((True, most_hit), (False, most_plain))]
    few = F.broadcast(ids[0].unionByName(ids[1]).select("d").distinct())  # at most most_hit + most_plain ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                w, tags = _tagged_words(t)
                x = traits(w)
                hits = np.flatnonzero(tags == B)
                spots = {0, *(max(0, int(k) - length // 2) for k in hits[:8])}
                rows += [(x[a : a + length].astype(np.uint8).tobytes(), tags[a : a + length].astype(np.uint8).tobytes()) for a in sorted(spots) if a < len(tags)]
            yield pd.DataFrame(rows, columns=["x", "tags"])

    got = text.join(few, "d").select("t").distinct().mapInPandas(cut, "x binary, tags binary").orderBy(F.xxhash64("x")).limit(4 * (most_hit + most_plain)).collect()
    tags = np.zeros((len(got), length), np.int64)
    x, mask = np.zeros((len(got), length, TRAITS), np.uint8), np.zeros((len(got), length), bool)
    for k, r in enumerate(got):
        n = len(r.tags)
        tags[k, :n], mask[k, :n] = np.frombuffer(bytes(r.tags), np.uint8), True
        x[k, :n] = np.frombuffer(bytes(r.x), np.uint8).reshape(n, TRAITS)
    return fit_crf(x, tags, mask) if (tags == B).any() else None


def added(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """A tagged stretch without its quotes and brackets; None if a pattern's span meets it."""
    part = text[start:end]
    start += len(part) - len(part.lstrip(_TRIM))
    end -= len(part) - len(part.rstrip(_TRIM + ".!?"))
    return None if end <= start or any(a < end and start < b for a, _, b in spans) else (start, 3, end)


def spans_of(batch_text: pa.Array, model) -> Iterator[list[tuple[int, int, int]]]:
    """The sorted spans of each text of a column."""
    for at, to, w in slices(batch_text, lower=False):
        texts = batch_text.slice(at, to - at).to_pylist()
        out = [patterns(t or "") for t in texts]
        if model is not None and len(w.row):
            tags = viterbi(traits(w).astype(np.float32) @ model[0].astype(np.float32), w.row, model[1])
            begin = np.flatnonzero(tags == B)
            for k in begin.tolist():
                stop = k
                while stop + 1 < len(tags) and tags[stop + 1] == I and w.row[stop + 1] == w.row[k]:
                    stop += 1
                r = int(w.row[k])
                low = w.offsets[r]
                points = lambda n: int(np.count_nonzero((w.data[low:n] & 0xC0) != 0x80))  # noqa: E731, B023
                if new := added(texts[r], points(w.start[k]), points(w.end[stop]), out[r]):
                    out[r].append(new)
        yield from (sorted(x) for x in out)


def _text(spans, kinds=None) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if kinds is None or k < kinds)


def scan(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_tagged, base_spans, spans) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(spans_of(batch.column(1), model))
            count = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *count, pa.array([_text(x, 3) for x in found], pa.string()), pa.array([_text(x) for x in found], pa.string())],
                names=["d", *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
            )

    schema = f"d {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_spans string, spans string"
    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("d", id_col)


def redact(docs: DataFrame, model, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each span replaced by ``mark``; the character count follows the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(names, batch.columns, strict=True))
            texts = []
            for text, spans in zip(cols[text_col].to_pylist(), spans_of(cols[text_col], model), strict=True):
                done, out = 0, []
                for a, _, b in spans:
                    if b > done:
                        out += [text[done:a], mark] if a >= done else []
                        done = b
                texts.append("".join([*out, text[done:]]) if spans else text)
            cols[text_col] = pa.array(texts, cols[text_col].type)
            if chars_col in cols:
                cols[chars_col] = pa.array([n if t is None else len(t) for n, t in zip(cols[chars_col].to_pylist(), texts, strict=True)], cols[chars_col].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_tagged")
