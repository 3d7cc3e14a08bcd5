"""Passages of the given texts put into others at any character, a word or a sentence end: op7_passages' operator finds each, sentences do not."""

import random
import re

from aeolia.llm import passages, stretches
from aeolia.llm.tables import table
from tests.llm.test_passages import WORD, later


def cut(rng, text, n):
    words = list(WORD.finditer(text))
    a = rng.randrange(len(words) - n + 1)
    return text[words[a].start() : words[a + n - 1].end()]


def rewrapped(rng, passage):
    return "".join(re.sub("[a-z]", lambda m: m[0].upper(), w) + rng.choice([" ", "\n", " \t"]) for w in WORD.findall(passage))


def put(rng, text, passage, kind):
    if kind == "character":  # words at its ends may run into the text's own
        at = rng.randrange(len(text) + 1)
        return text[:at] + passage + text[at:]
    at = rng.choice([m.end() for m in WORD.finditer(text) if kind != "sentence" or m[0][-1] in ".!?"] or [len(text)])
    return f"{text[:at]} {rewrapped(rng, passage) if kind == 'rewrapped' else passage} {text[at:]}"


def test_each_is_caught(spark):
    rng = random.Random(2)
    given = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").where("doc_id IS NOT NULL").collect()
    texts = {r.doc_id: r.text for r in given if r.text}
    long = [t for t in texts.values() if len(WORD.findall(t)) >= 130]
    planted, hosts = {}, rng.sample(sorted(texts), len(texts) // 2 // 8 * 8)
    for k in range(len(hosts) // 2):
        kind = ["word", "sentence", "character", "rewrapped"][k % 4]
        passage, pair = cut(rng, rng.choice(long), rng.randrange(52, 121)), hosts[2 * k : 2 * k + 2]
        for host in pair:
            texts[host] = put(rng, texts[host], passage, kind)
        planted[max(pair)] = kind
    assert len(planted) >= 8

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).cache()
    got = {r.doc_id for r in passages.passages(docs).collect()}
    assert set(planted) <= got <= {d for d, _, _ in later(texts.items(), 40)}
    # By sentences, as the SQL of op7_stretches has them, some go by.
    assert not set(planted) <= {r.doc_id for r in stretches.stretches(docs).collect()}
