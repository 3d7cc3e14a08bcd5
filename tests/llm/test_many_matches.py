"""Personal data in one text with very many matches."""

import time

from aeolia.llm import personal


def test_places_of_many_addresses(spark):
    n = 100_000
    text = "".join(f"ü a{k}@b.org" for k in range(n))
    began = time.time()
    spans = personal.find(spark.createDataFrame([(1, text), (2, "x a@b.de" * 255), (3, "x a@b.de y " * 256), (4, "a@b.de " * 257)], "doc_id long, text string")).collect()
    assert time.time() - began < 60
    found = {r.doc_id: [s for s in r.spans if s.kind == "email"] for r in spans}
    # Addresses stand one after another, so that each takes the next one's first letters as far as they are allowed.
    assert all(text[s.start : s.end].endswith("@b.org") for s in found[1]) and len(found[1]) == n
    assert [(s.start, s.end) for s in found[3]] == [(11 * k + 2, 11 * k + 8) for k in range(256)]
    assert [(s.start, s.end) for s in found[4]] == [(7 * k, 7 * k + 6) for k in range(257)]
