"""Each operator against a brute-force version or a round trip, on whole small tables and odd rows."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from aeolia.llm import decontam, licences, maxent, near, personal, pieces, quality, secrets, toxicity, units
from aeolia.llm.entry import ORACLES, QUERIES
from tests.comparing import of_duckdb, of_spark, tables

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (-1, None), (-2, ""), (-3, " \n\t "), (-4, "one"), (-5, "one two"), (-6, "a b c a b c a b c"), (-7, "x\ny\nx\n \n \n"), (-8, "é 😀 ▁ ▁▁ \x00 end "),
    (-9, "word " * 30000), (-10, "same text of four"), (-10, "same text of four"), (-11, "1" * 20000), (-12, "a@b." * 2000), (-13, "aa" * 20000),
]


def ascii_words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


@pytest.fixture(scope="module")
def rows(spark):
    """All documents of the smallest table and the odd rows, with a column that no operator expects."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(d, t, None if d % 2 else "en") for d, t in ODD], "doc_id long, text string, lang string")
    return docs.unionByName(odd).withColumns({"t": F.lit(1), "d": F.lit("x"), "id": F.lit(2.5), "n": F.lit(None).cast("int")}).cache()


@pytest.fixture(scope="module")
def texts(rows):
    return [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def nothing(rows):
    return rows.where("false")


def test_quality_counts(rows, texts, nothing):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c, seen = collections.Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                seen |= {i, i + 1, i + 2}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(seen), len(w) < 50 or 100 * len(seen) > 50 * len(w)

    got = quality.quality(rows).collect()
    want = collections.Counter((d, *brute(t)) for d, t in texts)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(nothing).count() == 0


def test_quality_distance(spark):
    df = spark.createDataFrame([([1, 3], [2, 2]), ([1, 0], [0, 1]), ([0, 0], [1, 1])], "a array<long>, b array<long>")
    got = [r[0] for r in df.withColumns({"x": quality.histogram_total("a"), "y": quality.histogram_total("b")}).select(quality.distance("a", "b", "x", "y")).collect()]
    p, q = (0.25, 0.75), (0.5, 0.5)
    js = sum(0.5 * x * math.log2(2 * x / (x + y)) + 0.5 * y * math.log2(2 * y / (x + y)) for x, y in zip(p, q))
    assert got[0] == pytest.approx(math.sqrt(js)) and got[1] == pytest.approx(1.0) and got[2] is None


def test_personal_spans(rows, texts, nothing, monkeypatch):
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    def brute(t):
        out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []
        out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if len(t) < 15000 and all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)

    more = [(-100, "a@b.c@d.e a@b.c_d@e.f é 300.1.1.1 😀 10.0.0.1 1.2.3.4.5.6.7.8"), (-101, "4587 1215-1940 0672 +1 (255) 555-8013 +12345678901234567"), (-102, "0001.2.3.4 0000255.1.1.1 99999999999.1.1.1"), (-103, "IBAN DE89 3704 0044 0532 0130 00. DE89370400440532013001 tel 030 1234567")]
    both = rows.select("doc_id", "text").unionByName(rows.sparkSession.createDataFrame(more, "doc_id long, text string"))
    monkeypatch.setattr(personal, "table", lambda *_: both)
    got = collections.Counter((r.doc_id, r.base_sha256) for r in personal.op4_personal(None, "").collect())
    assert got == collections.Counter((d, hashlib.sha256(brute(t or "").encode()).hexdigest()) for d, t in [*texts, *more])
    spans = {r.doc_id: r.spans for r in personal.op4_personal(None, "").where("doc_id = -103").collect()}
    assert "iban:5:32" in spans[-103] and spans[-103].count("iban") == 1 and "local" in spans[-103]
    assert personal.find(nothing).count() == 0


def test_toxicity_learns_and_scores(spark):
    words = [f"w{k}" for k in range(60)]
    made = []
    for k in range(240):
        base = [words[(k * 7 + 3 * j * j) % 60] for j in range(40)]
        toxic = k % 3 == 0
        if toxic:
            base[5], base[20] = "blorg", "zilch" + "abcdefgh"[k % 8] * 2
        made.append((k, " ".join(base), int(toxic)))
    docs = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in made if d % 5], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    assert "blorg" in grammar.forms and any(s.startswith("zilc") for s in grammar.stems)
    got = {r.doc_id: r for r in toxicity.score(docs, grammar).collect()}
    assert all(got[d].predicted == y for d, _, y in made if d % 5 == 0)
    odd = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(ODD, "doc_id long, text string"), grammar).collect()}
    assert all(0 <= r.score < 0.5 for r in odd.values()) and odd[-1].score == odd[-2].score
    assert toxicity.fit(docs, labels.where("false")).bias == -math.inf


def test_toxicity_clause_outputs():
    machine = toxicity.Transducer(toxicity.Grammar({"blorg": 1.0}, {}))
    name = dict(zip(toxicity.OUTPUTS, range(6)))
    assert machine.outputs("a blorg here")[name["plain"]] == 1.0
    assert machine.outputs("you are a blorg")[name["targeted"]] == 1.0
    assert machine.outputs("this is not a blorg")[name["negated"]] == 1.0
    assert machine.outputs("one said a blorg came")[name["reported"]] == 1.0
    assert machine.outputs("they will kill you. kill the lights")[name["threat"]] == 1.0
    assert not machine.outputs("ablorg").any()


def test_decontamination_finds_substituted_passages(spark):
    item = [f"t{k}" for k in range(24)]
    changed = lambda ks: " ".join("x" if k in ks else w for k, w in enumerate(item))
    docs = [(1, "z z " + changed([]) + " q"), (2, changed([5, 15])), (3, changed([2, 9, 14, 20])), (4, changed(range(0, 24, 2))), (5, None), (6, ""), (7, "u " + " ".join(item[:20])), (8, "p short item"), (1, "z z " + changed([]))]
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "short item"), (3, None), (4, "")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, 1), (1, 1), (2, 1), (3, 1), (7, 1), (8, 2)]
    for most in (decontam.MOST_WINDOWS, 20):
        got = decontam.contained(df, tests, most_windows=most)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want
    assert decontam.contained(df.where("false"), tests).count() == 0 and decontam.contained(df, tests.where("false")).count() == 0


def test_decontamination_of_the_given_tables(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet").select(k, "text").collect() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    join = lambda t: " " + " ".join(ascii_words(t)) + " "
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if join(i.text) in join(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.op3_decontam(spark, FOLDER).collect()}
    assert exact and exact <= got and len(got) <= len(exact) + 3


def test_language_model_counts_and_gain(rows, texts, monkeypatch):
    monkeypatch.setattr(maxent, "table", lambda *_: rows)
    monkeypatch.setattr(maxent, "MOST_FREQUENT", 1500)
    lists = [(d, [*ascii_words(t), "\0end"]) for d, t in texts]
    c = collections.Counter(w for d, ws in lists if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in lists}
    got = maxent.op5_maxent(rows.sparkSession, "").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score <= 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_sums_to_one():
    import numpy as np

    rng = np.random.default_rng(1)
    w = maxent.Weights.start(np.ones(maxent.K), np.ones(maxent.VOCABULARY))
    w.outer[:] = rng.normal(size=w.outer.shape)
    w.inner[:] = rng.normal(size=w.inner.shape)
    place = np.r_[np.arange(maxent.VOCABULARY), np.full(maxent.REST_CLASSES, -1)]
    rest = np.r_[np.zeros(maxent.VOCABULARY, int), np.arange(maxent.REST_CLASSES)]
    cls, outer, inner = maxent.features(place, rest, np.arange(len(place)))  # every token first in a text of its own
    assert np.exp(maxent.log_probability(w, cls, place, outer, inner)).sum() == pytest.approx(1.0, rel=1e-4)


def near_brute(texts, k, percent):
    sets = {}
    for d, t in texts:
        w = ascii_words(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and (p := find(a)) != (q := find(b)):
                comp[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, texts, nothing, k, percent):
    base = [f"v{j}" for j in range(120)]
    made = [(1000 + j, " ".join(base[:j] + ["new%d" % j] + base[j + 1 :])) for j in range(0, 100, 3)]  # a chain of near copies
    made += [(2000 + j, " ".join(base[: 120 - 2 * j])) for j in range(12)] + [(3000, " ".join(base)), (3001, " ".join(base))]
    both = [(d, t) for d, t in texts if len(t or "") < 50000] + made
    want = near_brute(both, k, percent)
    got = near.jaccard_components(spark.createDataFrame(both, "doc_id long, text string"), k, percent).collect()
    assert len(got) == len(both) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_jaccard_of_nothing(nothing):
    assert near.jaccard_components(nothing, 3, 90).count() == 0


def test_units_and_licences_same_as_sql(spark):
    con = tables(FOLDER)
    for name in ORACLES:
        assert of_spark(QUERIES[name](spark, FOLDER)) == of_duckdb(con, ORACLES[name]), name


def test_units_keep_the_first(spark, nothing):
    long = "One  two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(2, f"short\n{long}\nend"), (1, f"{long.lower()}\n{long}"), (3, None), (None, long), (4, "short\nshort")], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end, r.kept_id, r.kept_start) for r in units.repeats(docs, least_words=10).collect()}
    assert got == {(2, 6, 6 + len(long), 1, 0), (1, len(long) + 1, 2 * len(long) + 1, 1, 0)}
    assert units.repeats(nothing).count() == 0


def test_licence_rules(spark, nothing):
    header = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
    docs = spark.createDataFrame([(1, header), (2, "x\nReleased under the MIT License.\nAll rights reserved."), (3, None), (4, "no licence sentence, only the word license"), (5, "All RIGHTS reserved")], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    assert got == {1: "apache-2.0", 2: "mit,rights-reserved", 3: "", 4: "", 5: "rights-reserved"}
    assert licences.scan(nothing).count() == 0


def test_secret_patterns_and_tags(rows, texts, nothing):
    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))

    more = rows.sparkSession.createDataFrame([(-200 - k, f"é the word Password = 'q{k}w2e3r4t5y6' and é AKIAABCDEFGH{k:04d}MNOP {k:024x} end") for k in range(40)], "doc_id long, text string")
    both = rows.select("doc_id", "text").unionByName(more)
    model = secrets.train(both)
    got = secrets.scan(both, model).collect()
    want = collections.Counter((d, brute(t or "")) for d, t in [*texts, *[(r.doc_id, r.text) for r in more.collect()]])
    assert collections.Counter((r.doc_id, r.base_spans) for r in got) == want
    assert model is not None and secrets.train(nothing) is None and secrets.scan(nothing, model).count() == 0
    clean = secrets.redact(both, model)
    assert clean.columns == both.columns and clean.where("text LIKE '%AKIAABCDEFGH%'").count() == 0


def test_viterbi_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    moves = rng.normal(size=(3, 3))
    for _ in range(30):
        size = rng.integers(1, 7)
        e = rng.normal(size=(size, 3)) * 2 + np.array([rng.choice([0, 8]), 0, 0])
        score = lambda p: sum(e[k, y] for k, y in enumerate(p)) + sum(moves[a, b] if (a, b) != (0, 2) else -1e6 for a, b in zip(p, p[1:])) + (-1e6 if p[0] == 2 else 0)  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=int(size)), key=score)
        assert tuple(secrets.viterbi(e, np.zeros(size, int), moves)) == best


def test_pieces_same_as_the_library(rows, texts, nothing):
    made = pieces._processor(pieces.public_tokenizers.path(pieces.MODEL))
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode(rows, digests=True).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = [(d, made.encode(t or "")) for d, t in texts]
    assert got == collections.Counter((d, len(i), sha(",".join(map(str, i))), sha(made.decode(i))) for d, i in ids)
    assert pieces.encode(nothing).count() == 0
