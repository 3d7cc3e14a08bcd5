"""Account numbers, whatever word follows."""

import pytest

from aeolia.llm import personal


@pytest.mark.parametrize("number", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606"])
def test_account_numbers_before_capitals(spark, number):
    after = [" und", " Bitte", " BIC COBADEFF", " BANK", " B", ". Die", "\n12", "", " A1 B2 C3", ", X"]
    docs = spark.createDataFrame([(k, f"IBAN {number}{x}") for k, x in enumerate(after)] + [(99, f"IBAN {number}X")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in personal.find(docs).collect()}
    assert got == {k: [(5, 5 + len(number))] for k in range(len(after))} | {99: []}
