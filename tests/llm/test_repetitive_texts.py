"""Decontamination of texts and items of few words, against all diagonals compared word by word."""

import random
import time

import numpy as np
import pytest

from aeolia.llm import decontam


def rows(spark, docs, items):
    d, t = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_equal, r.n_item, r.start_word, r.n_span) for r in decontam.contained(d, t).collect()}


def seeded(text, item):
    """Whether some window of the item and of the text agree under a mask on this diagonal."""
    out = set()
    for mask in decontam.MASKS:
        for i in range(len(item) - mask[-1]):
            for d in range(len(text) - mask[-1]):
                if all(item[i + k] == text[d + k] for k in mask):
                    out.add(d - i)
    return sorted(out)


def brute(text, item):
    best = (0, 0, 0)
    for p in seeded(text, item):
        low, high = max(p, 0), min(p + len(item), len(text))
        n = np.array([k for k in range(low, high) if text[k] == item[k - p]])
        need = min(decontam.LEAST_WORDS, len(item))
        if len(n) < need:
            continue
        if len(n) < decontam.LEAST_SHARE * len(item):
            kept = [(j - i + 1, n[i] - n[j], -j, i, j) for j in range(len(n)) for i in range(j + 1) if j - i + 1 >= decontam.LEAST_SHARE * (n[j] - n[i] + 1) - 1e-9]
            _, _, _, i, j = max(kept)
            n = n[i : j + 1]
            if len(n) < max(need, 13):
                continue
        best = max(best, (len(n), -int(n[0]), int(n[-1] - n[0]) + 1))
    return (best[0], len(item), -best[1], best[2]) if best[0] else None


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_few_words_against_all_diagonals(monkeypatch, most):
    """In this process, so that the limit holds: dense and listed hits give the same."""
    monkeypatch.setattr(decontam, "MOST_PAIRS", most)
    import pyarrow as pa

    rng = random.Random(3)
    words = lambda n, k: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    docs = [words(rng.randint(1, 90), rng.choice((1, 2, 3, 8))) for _ in range(40)]
    items = [words(rng.randint(13, 30), rng.choice((1, 2, 3, 8))) for _ in range(12)]
    docs += [words(10, 8) + i + words(9, 8) for i in items] + [[w if rng.random() > 0.15 else "x" for w in i] for i in items]

    class Side:
        value = None

    from aeolia.llm.words import words as split

    w = split(pa.array([" ".join(i) for i in items]))
    Side.value = (np.arange(len(items)), w.row, w.hashes())
    run = decontam._search(Side, decontam.MASKS, decontam.LEAST_WORDS, decontam.LEAST_SHARE)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([" ".join(d) for d in docs])], names=["d", "t"])
    got = {(r["d"], r["item_id"]): (r["n_equal"], r["n_item"], r["start_word"], r["n_span"]) for b in run(iter([batch])) for r in b.to_pylist()}
    want = {(d, i): v for d, text in enumerate(docs) for i, item in enumerate(items) if (v := brute(text, item))}
    assert got == want and len(want) > 60


def test_one_word_repeated_takes_seconds(spark):
    began = time.time()
    got = rows(spark, ["a " * 20000, "a b " * 10000, "b " * 5000, ("a " * 12 + "z ") * 1500], ["a " * 3000, "a b " * 1500, "c " * 3000])
    assert time.time() - began < 60
    assert got[0, 0] == (3000, 3000, 0, 3000) and got[1, 1] == (3000, 3000, 0, 3000) and got[3, 0][0] > 2700 and not {k for k in got if k[1] == 2 or k[0] == 2}


def test_items_that_repeat_an_id(spark):
    texts = ["one two three four five six seven eight nine", "zeta eta theta iota kappa lambda mu nu xi"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(5, texts[1]), (5, texts[0]), (5, None), (5, texts[0])], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contained(docs, items).collect()] == [(0, 5)]
