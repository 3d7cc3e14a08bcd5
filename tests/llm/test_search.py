"""Ranked search against a plain ranking of all documents, and against SQL."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolia.llm import search
from tests.comparing import of_duckdb, of_spark, tables

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    df = collections.Counter(t for _, c, _ in counts for t in c)
    n, words, out = len(counts), sum(x[2] for x in counts), []
    for i, text in set(items):
        asked = collections.Counter(terms(text))
        found = []
        for d, c, size in counts:
            m = 25 + 75 * size * n // words
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


DOCS = [
    (1, "alpha beta gamma"), (2, "Alpha  BETA-gamma"), (3, None), (4, ""), (5, "... !"), (6, "alpha " * 5000), (7, "été naïve über-alpha1 2x"), (8, "ÉTÉ 😀😀 alpha1"),
    (9, "beta beta beta gamma"), (9, "beta beta beta gamma"), (None, "beta beta beta gamma"), (10, "delta" * 3000 + " beta"), (11, "alpha\x00beta\x7fgamma_alpha"),
] + [(100 + k, f"alpha word{k % 7} beta{k}") for k in range(60)]
ITEMS = [(1, "alpha beta"), (2, "gamma gamma alpha1"), (3, None), (4, "..."), (5, "nothing here matches qqq"), (6, "Été ÉTÉ 😀😀"), (7, "word3 word3 alpha beta17"), (7, "gamma delta"), (1, "alpha beta"), (None, "beta")]


@pytest.mark.parametrize(("k", "most_terms"), [(10, 500_000), (3, 4), (1, 2)])
def test_same_as_a_ranking_of_all(spark, k, most_terms):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"t": F.lit(1), "d": F.lit("x"), "item": F.lit(2), "score": F.lit(0)}).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit(0))
    got = search.search(docs, items, k=k, most_terms=most_terms).collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs.where("false"), items).count() == search.search(docs, items.where("false")).count() == 0


def test_small_blocks_and_limits_lose_nothing(monkeypatch):
    """Many blocks of random postings: the limit must cut accumulators and keep the best rows."""
    rng = np.random.default_rng(5)
    size, vocabulary, k = 4000, 40, 10
    weights = np.sort(rng.integers(1, 9000, vocabulary))[::-1].copy()
    share = 0.5 * np.exp(-weights / 2500.0)
    has = rng.random((size, vocabulary)) < share
    rows, held = np.nonzero(has)
    tf, n = rng.integers(1, 6, len(rows)), rng.integers(20, 400, size)
    block = search.Block(n, rows, held, tf, weights, size, int(n.sum()))
    cut = 0
    for _ in range(30):
        asked = np.unique(rng.integers(0, vocabulary, 12))
        repeats = rng.integers(1, 3, len(asked))
        whole = np.zeros(size, np.int64)
        for t, r in zip(asked, repeats, strict=True):
            at = slice(block.at[t], block.at[t + 1])
            whole[block.rows[at]] += r * block.adds[at]
        at, scores, made = block.scores(asked, repeats, k, 1)
        assert (whole[at] == scores).all()
        kth = np.sort(whole)[-k]
        assert set(np.flatnonzero(whole >= kth)) <= set(at)
        cut += made < (block.at[asked + 1] - block.at[asked]).sum()
    assert cut > 20


def test_same_as_sql(spark):
    assert of_spark(search.op12_search(spark, FOLDER)) == of_duckdb(tables(FOLDER), search.OP12_SQL)
