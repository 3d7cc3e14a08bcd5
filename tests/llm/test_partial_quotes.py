"""Parts of test items with changed words."""

import numpy as np

from aeolia.llm import decontam


def test_longest_stretch_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n = np.flatnonzero(rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.8, 0.9]))
        if not len(n):
            continue
        pairs = [(j - i + 1, -int(n[j] - n[i]), -i, j) for i in range(len(n)) for j in range(i, len(n)) if 10 * (j - i + 1) >= 8 * (n[j] - n[i] + 1)]
        _, _, i, j = max(pairs)
        assert decontam.longest(n, 0.8).tolist() == n[-i : j + 1].tolist()


def test_partial_quotes_are_contained(spark):
    item = [f"t{k}" for k in range(60)]
    changed = {6, 11}  # 6 equal, 1 changed, 4 equal, 1 changed, 3 equal: 13 of 15
    quote = ["x" if k in changed else w for k, w in enumerate(item[:15])]
    docs = spark.createDataFrame([(1, "a b " + " ".join(quote) + " c d e"), (2, " ".join(quote[:14]))], "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontam.contained(docs, tests).collect()
    assert [(r.doc_id, r.n_equal, r.n_item, r.start_word, r.n_span) for r in got] == [(1, 13, 60, 2, 15)]
