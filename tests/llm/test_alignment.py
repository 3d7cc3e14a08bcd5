"""Alignment against a version that encodes whole texts and knows only the tokens' bytes."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aeolia.llm import alignment

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (-1, None), (-2, ""), (-3, " "), (-4, "  "), (-5, " \n\t  x"), (-6, "one"), (-6, "one"), (None, "one two"), (-7, "tab\tand \n new  lines\n\n end "), (-8, "é 😀 日本語 \x00 ё"), (-9, "has ▁ in it"),
    (-10, "<|endoftext|> <s> </s> <unk>"), (-11, "1" * 20000), (-12, "word " * 3000), (-13, "aa" * 8000), (-14, "ሴ ꙮ𝔘 ńĳ x  y​ z"), (-15, "don't  we'll\r\nit's"), (-16, "\x1c a \x85 b　 c"), (-17, "👩‍👩‍👧 x" * 50),
]


def brute(texts):
    first, second = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    first.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in own)}

    def b_bytes(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    rows, held = [], collections.Counter()
    for d, t in texts:
        a = first.encode(" " + (t or ""), add_special_tokens=False).ids
        b = second.encode(t or "", num_threads=1)
        bytes_a, bytes_b = [bytes(byte[c] for c in first.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        spelt = (" " + (t or "")).encode()
        groups = []
        if t and b"".join(bytes_a) == spelt == b"".join(bytes_b):
            i = j = x = y = 0
            xs, ys = [], []
            while i < len(a):
                if x <= y:
                    x, i = x + len(bytes_a[i]), xs.append(a[i]) or i + 1
                while y < x:
                    y, j = y + len(bytes_b[j]), ys.append(b[j]) or j + 1
                if x == y:
                    groups.append((xs, ys))
                    xs, ys = [], []
        links = collections.Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(links.keys())
        rows.append((d, groups, links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for d, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


@pytest.mark.parametrize("most", [500_000, 100])
def test_same_as_brute_force(spark, most):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = docs.unionByName(odd).withColumns({"row": F.lit("x"), "id": F.lit(1.5), "pair": F.lit(None).cast("int"), "n": F.lit(2)}).repartition(4).cache()
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = alignment.alignment(docs, most_frequent_pairs=most).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute(texts))
    assert alignment.alignment(docs.where("false"), most_frequent_pairs=most).count() == 0


def test_groups_are_given_as_text_and_tables_begin_anew(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_CHARS", 10)
    made = alignment.Pieces(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(2):
        parts = alignment.cut("Straßen überqueren, 日本語!")
        made.add([parts])
        assert len(made.known) == len(set(parts))
        text = ";".join(made.texts[made.known[p]] for p in parts)
        assert [bytes().join(made.bytes_a[int(i)] for g in text.split(";") for i in g.split("|")[0].split(",")).decode()] == [" Straßen überqueren, 日本語!"]
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = alignment.aligned(docs).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and len(row["pairs"]) == len(row["links"]) == 2


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    found = []
    for most in (4096, 0):
        monkeypatch.setattr(alignment.Pieces, "MOST_LINKS", most)
        made = alignment.Pieces(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
        parts = [p for _, t in ODD if t for p in alignment.cut(t)]
        made.add([parts])
        links = []
        for p in parts:
            k = made.known[p]
            at = slice(made.at[k], made.at[k + 1])
            own = collections.Counter()
            for pair, n in zip(made.pairs[at].tolist(), made.times[at].tolist(), strict=True):
                own[pair] += n
            assert own.total() == made.numbers[k][3]
            links.append(own)
        found.append(links)
    assert found[0] == found[1]
