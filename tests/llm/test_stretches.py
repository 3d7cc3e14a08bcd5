"""Repeated stretches against SQL, against a plain version on odd rows, and after removal."""

import re

import pytest
from pyspark.sql import functions as F

from aeolia.llm import stretches
from tests.comparing import of_duckdb, of_spark, tables

S = [" ".join(f"w{k}x{j}" for j in range(15)) + "." for k in range(8)]
DOCS = [
    (1, f"Intro one. {S[0]} {S[1]} {S[2]} End one."), (2, f"Intro two. {S[0]} {S[1]}\n{S[2].upper()} End two."), (3, None), (4, ""), (5, " \n . ! ?\n"),
    (6, f"{S[3]} {S[4]} {S[5]} {S[3]} {S[4]} {S[5]}"), (7, f"{S[0]} something else here. {S[1]} {S[2]}"), (8, "same words " * 30), (8, "same words " * 30), (9, "same words " * 30),
    (None, f"{S[0]} {S[1]} {S[2]}"), (10, f"😀 é {S[6]}\r\n{S[7]} x"), (11, f"y. {S[6]}\n{S[7]}"), (12, "no. " * 5000), (13, "no. " * 5000),
]


def brute(docs, least):
    seen, out = {}, []
    rows = sorted({(d, t) for d, t in docs if d is not None and t})
    for d, t in rows:
        run = None
        for m in re.finditer(r"[^\n.!?]*(?:[.!?]+|\n)|[^\n.!?]+", t):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", m[0].lower()) if w]
            if not words:
                continue
            plain = " ".join(words)
            if plain in seen:
                run = run or [d, m.start(), 0, 0, 0, *seen[plain]]
                run[2], run[3], run[4] = m.end(), run[3] + 1, run[4] + len(words)
            else:
                seen[plain] = (d, m.start())
                out += [run] if run else []
                run = None
        out += [run] if run else []
    return sorted(tuple(x) for x in out if x[4] >= least)


@pytest.mark.parametrize(("least", "most"), [(40, 100_000), (1, 100_000), (1, 2), (30, 1)])
def test_odd_rows(spark, least, most):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"u": F.lit(1), "d": F.lit("x"), "start": F.lit(0), "f": F.lit(None).cast("int")}).repartition(3)
    got = sorted(map(tuple, stretches.stretches(docs, least_words=least, most_frequent_units=most).collect()))
    assert got == brute(DOCS, least)
    assert stretches.stretches(docs.where("false")).count() == 0


def test_removed(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("start", F.lit(7))
    got = [(r.doc_id, r.text) for r in stretches.removed(docs).collect()]
    assert len(got) == len(DOCS)
    kept = dict((d, t) for d, t in got if d is not None)
    assert kept[1] == DOCS[0][1] and kept[2] == "Intro two. End two.".replace(". E", ". E") and kept[3] is None and kept[4] == ""
    assert [t for d, t in got if d is None] == [DOCS[10][1]]
    assert kept[6] == f"{S[3]} {S[4]} {S[5]}" and kept[9] == "" and kept[8] == "same words " * 30
    assert stretches.stretches(stretches.removed(docs)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_as_sql(spark, folder):
    assert of_spark(stretches.op7_stretches(spark, folder)) == of_duckdb(tables(folder), stretches.OP7_STRETCHES_SQL)
