"""Passages cut anywhere against a plain version, and all later occurrences of 50 words found."""

import random
import re

import pytest
from pyspark.sql import functions as F

from aeolia.llm import passages, stretches
from aeolia.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def windows(docs, n):
    """(id, first word, start, end, text) of every n words on end, in order; a document once."""
    for d, t in sorted({(d, t) for d, t in docs if d is not None and t}):
        at = list(WORD.finditer(low(t)))
        for p in range(len(at) - n + 1):
            yield d, p, at[p].start(), at[p + n - 1].end(), " ".join(m[0] for m in at[p : p + n])


def later(docs, n):
    seen = set()
    for d, _, start, end, text in windows(docs, n):
        if text in seen:
            yield d, start, end
        seen.add(text)


def made(seed=3):
    rng = random.Random(seed)
    text = lambda n: [f"{rng.choice(['é', 'W', 'x', '😀'])}{rng.randrange(10**6)}{rng.choice(['', '.', ','])}" for _ in range(n)]
    shared = text(51)
    docs = [(k, rng.choice([" ", "\n", " \t"]).join([*text(rng.randrange(60)), *(shared if k % 3 else shared[:39]), *text(rng.randrange(60))]).swapcase()) for k in range(12)]
    docs += [(20, None), (21, ""), (22, " \n "), (23, "no. " * 300), (24, "no. " * 300), (24, "no. " * 300), (None, " ".join(shared)), (25, " ".join(shared[5:46])), (26, " ".join(text(45)))]
    return docs


def found(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"u": F.lit(1), "start": F.lit(0)}).repartition(3)
    return sorted(map(tuple, passages.passages(df, **options).collect()))


@pytest.mark.parametrize("most", [100_000, 1])
def test_whole_and_right(spark, most):
    docs = made()
    got = found(spark, docs, most_frequent_units=most)
    spans = {}
    for d, start, end, _, n_words, kept, _ in got:
        text = next(t for k, t in docs if k == d)[start:end]
        assert len(WORD.findall(text)) == n_words >= 40 and kept <= d
        spans.setdefault(d, []).append((start, end))
    # Every later occurrence of 50 words shares at least 40 of them with a stretch ...
    for d, start, end in later(docs, 50):
        text = next(t for k, t in docs if k == d)
        assert any(len(WORD.findall(text[max(a, start) : min(b, end)])) >= 40 for a, b in spans[d])
    # ... and documents in which no 40 words stand earlier have none.
    assert set(spans) <= {d for d, _, _ in later(docs, 40)}
    assert 1 not in spans and {2, 4, 5, 7, 8, 10, 11, 23, 24} <= set(spans)


def test_every_unit_taken(spark):
    """With a choice of one, stretches are the later occurrences of 40 words, joined."""
    docs = made(5)
    got = [x[:3] for x in found(spark, docs, choice=1)]
    want = {}
    words = {(d, start): p for d, p, start, _, _ in windows(docs, 40)}
    for d, start, end in later(docs, 40):
        rows = want.setdefault(d, [])
        if rows and words[d, start] == rows[-1][2] + 1:
            rows[-1] = (rows[-1][0], end, words[d, start])
        else:
            rows.append((start, end, words[d, start]))
    assert got == sorted((d, a, b) for d, x in want.items() for a, b, _ in x)


def test_sentences_cut_at_both_ends(spark):
    """What sentences lose: a passage of 55 words in two long sentences, neither of them whole."""
    shared = " ".join(f"s{k}{'.' if k == 27 else ''}" for k in range(55))
    docs = spark.createDataFrame([(1, f"One begins {shared} and ends."), (2, f"Another one starts {shared} but goes on.")], "doc_id long, text string")
    assert stretches.stretches(docs).count() == 0
    assert [r.doc_id for r in passages.passages(docs).collect()] == [2]


def test_given_texts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id for r in passages.op7_passages(spark, "/root/testdata/sf0.001").collect()}
    assert {d for d, _, _ in later(rows, 50)} <= got <= {d for d, _, _ in later(rows, 40)}
