"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes.

Tokenizer A is a byte-level BPE and encodes a space and the text; tokenizer B is a SentencePiece model, which
puts that space in front by itself. Where tokens of both end at one byte, a group ends; all A and B tokens
of a group are linked. The libraries give coarse cuts: A character offsets, B byte spans. Tokens
that share a character, and byte-fallback tokens, are cut further by the lengths of their decoded bytes.

No token of either vocabulary crosses from a character that is no white space to a space, or to a line break with a
character after it, so a text is cut there, and each distinct piece of text is encoded once in a table of a task and
joined back by position. New pieces are put together into longer texts for the libraries, which the same
places cut apart again. A table holds ``MOST_CHARS`` characters and then begins anew.

Links are counted over the corpus by documents. The most frequent pairs (at most ``MOST_FREQUENT``) are
broadcast to the documents' rows, all others are joined to them. Of an A id the highest count
is one row, so that these are no more than the vocabulary.

Null and empty texts, and texts that the tokens' bytes do not spell (such as those with
U+2581), have no tokens: all numbers are 0 and the digest is the empty string. Special tokens'
strings are ordinary text. Rows that repeat an id are documents of their own, each with its own
row and its own count; a null id is an id like others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aeolia.llm.pieces import MARKER, MODEL
from aeolia.llm.tables import most_frequent, shared_folder, table, written

BYTE_MODEL = "byte_bpe_50k.json"
MOST_CHARS = 5_000_000
MOST_FREQUENT = 500_000
#: Pieces that are put together for one call.
TOGETHER = 128
_CUT = re.compile(r"(?<=\S)(?= |\n\S)")
_NEEDS_CUT = re.compile(r"\s |\n")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _printable() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    first, second = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    first.encode_special_tokens = True
    byte, size = _printable(), first.get_vocab_size()
    bytes_a = [bytes(byte[c] for c in first.id_to_token(i)) if all(c in byte for c in first.id_to_token(i)) else b"" for i in range(size)]
    bytes_b = []
    for i in range(second.get_piece_size()):
        piece = second.id_to_piece(i)
        if MARKER in piece.lstrip(MARKER) or "\n" in piece:
            raise ValueError(f"{b}: a piece crosses a white-space marker or a line; texts can't be cut there")
        fallback = _BYTE_PIECE.fullmatch(piece)
        bytes_b.append(bytes([int(fallback[1], 16)]) if fallback else piece.replace(MARKER, " ").encode())
    names = [f"{k}{sign}" for k in range(max(len(bytes_a), len(bytes_b))) for sign in ",|;\n"]
    return first, second, bytes_a, bytes_b, *(np.array([len(x) for x in y], np.int64) for y in (bytes_a, bytes_b)), names


def cut(text: str) -> list[str]:
    """A space and the text, cut where no token crosses."""
    whole = " " + text
    if _NEEDS_CUT.search(whole):
        return _CUT.split(whole)
    return [" " + x for x in text.split(" ")]


def _ends(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """End of each token in bytes: the coarse one where its span has the size of the token's bytes, else from the bytes."""
    exact = np.cumsum(sizes)
    return np.where((ends - begins == sizes) & (begins == exact - sizes), ends, exact)


def _flat(lists: list, kind=np.int64) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), kind)


def _spelt(parts: list[bytes], tokens: list[list[int]], spelling: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """For each piece of text whether its tokens' bytes spell it."""
    owner = np.repeat(np.arange(len(parts)), [len(t) for t in tokens])
    ids = _flat(tokens)
    same = np.bincount(owner, sizes[ids], len(parts)) == [len(p) for p in parts]
    if same.all() and b"".join([spelling[i] for i in ids.tolist()]) == b"".join(parts):
        return same
    return np.array([b"".join([spelling[i] for i in t]) == p for p, t in zip(parts, tokens, strict=True)], bool)


class Pieces:
    """A table of pieces of text: their tokens, groups and links, filled for whole batches of new pieces.

    For a piece's number: ``numbers`` (n_a, n_b, n_groups, n_links), ``texts`` (groups as text), ``spelt``, and from
    ``at`` to the next in ``pairs`` its links, in ``times`` how often each of them.
    """

    #: Groups with more links are counted by distinct ids before they are multiplied out.
    MOST_LINKS = 4096

    def __init__(self, a: str, b: str):
        self.first, self.second, self.bytes_a, self.bytes_b, self.sizes_a, self.sizes_b, self.names = _tokenizers(a, b)
        self._begin()

    def _begin(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.numbers, self.spelt, self.texts = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.at, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[list[str]]) -> None:
        if self.chars > MOST_CHARS:
            self._begin()
        new = [p for p in set().union(*texts) if p not in self.known]
        # What ends in white space would grow together with what follows; U+2581 is never spelt.
        alone = [[p] for p in new if p[-1].isspace() or MARKER in p]
        others = [p for p in new if not p[-1].isspace() and MARKER not in p]
        groups = [others[at : at + TOGETHER] for at in range(0, len(others), TOGETHER)] + alone
        found = []
        while groups:
            some, groups = groups[:256], groups[256:]
            done, again = self._some(some)
            found.append(done)
            groups += [[p] for g in again for p in g]
        self.chars += sum(map(len, new))
        if found:
            parts, numbers, spelt, said, counts, pairs, times = zip(*found, strict=True)
            self.known.update((p, k) for k, p in enumerate(chain.from_iterable(parts), len(self.spelt)))
            self.numbers, self.spelt = np.concatenate([self.numbers, *numbers]), np.concatenate([self.spelt, *spelt])
            self.texts += chain.from_iterable(said)
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(counts))])
            self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])

    def _some(self, groups: list[list[str]]) -> tuple[tuple, list[list[str]]]:
        """(pieces and all that the table holds of them), and the groups to try again piece by piece."""
        # B puts a space before its text itself, so that a group has to begin with one.
        groups = [g if g[0][0] == " " else [" x", *g] for g in groups]
        texts = ["".join(g) for g in groups]
        encodings = self.first.encode_batch(texts, add_special_tokens=False)
        protos = self.second.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
        raw = [t.encode() for t in texts]
        a = [e.ids for e in encodings]
        # The model gives nothing for an empty text, though the space before it is a piece.
        space = [(self.second.piece_to_id(MARKER), 0, 0)]
        spans_b = [[(p.id, p.begin, p.end) for p in x.pieces] or space for x in protos]
        b = [[x[0] for x in spans] for spans in spans_b]
        whole = _spelt(raw, a, self.bytes_a, self.sizes_a) & _spelt(raw, b, self.bytes_b, self.sizes_b)
        good = np.flatnonzero(whole).tolist()
        again = [g for g, ok in zip(groups, whole, strict=True) if not ok and len(g) > 1]
        unspelt = [g[0] for g, ok in zip(groups, whole, strict=True) if not ok and len(g) == 1]
        parts = [p for k in good for p in groups[k]]
        at_text = np.cumsum([0, *[len(raw[k]) for k in good]])
        starts = np.cumsum([0, *[len(p) if p.isascii() else len(p.encode()) for p in parts]])

        # Coarse cuts of A are characters; the bytes where characters start make them bytes.
        data = np.frombuffer(b"".join([raw[k] for k in good]), np.uint8)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        n_a, n_b = np.array([len(a[k]) for k in good], np.int64), np.array([len(b[k]) for k in good], np.int64)
        ids_a, ids_b = _flat([a[k] for k in good]), _flat([b[k] for k in good])
        spans = _flat([x for k in good for x in encodings[k].offsets]).reshape(-1, 2) + np.repeat(np.searchsorted(chars, at_text[:-1]), n_a)[:, None]
        ends_a = _ends(chars[spans[:, 0]], chars[spans[:, 1]], self.sizes_a[ids_a])
        # B was given the text without its first space, with which its first piece begins.
        spans = _flat([x for k in good for x in spans_b[k]]).reshape(-1, 3) + np.repeat(at_text[:-1], n_b)[:, None] + 1
        begin_b = spans[:, 1].copy()
        begin_b[np.cumsum(n_b) - n_b] -= 1
        ends_b = _ends(begin_b, spans[:, 2], self.sizes_b[ids_b])

        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        owner = np.searchsorted(starts, cuts) - 1  # the piece of each group: all pieces end in a cut
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        links = in_a * in_b

        plain = np.flatnonzero(links <= self.MOST_LINKS)
        reach = np.repeat(plain, links[plain])
        step = np.arange(len(reach)) - np.repeat(np.cumsum(links[plain]) - links[plain], links[plain])
        pairs = ids_a[from_a[reach] + step // in_b[reach]] * len(self.bytes_b) + ids_b[from_b[reach] + step % in_b[reach]]
        times, held = np.ones(len(pairs), np.int64), owner[reach]
        for g in np.flatnonzero(links > self.MOST_LINKS):
            (x, p), (y, q) = (np.unique(ids[at : at + n], return_counts=True) for ids, at, n in ((ids_a, from_a[g], in_a[g]), (ids_b, from_b[g], in_b[g])))
            pairs, times = np.append(pairs, np.add.outer(x * len(self.bytes_b), y)), np.append(times, np.multiply.outer(p, q))
            held = np.append(held, np.full(len(x) * len(y), owner[g]))
        order = np.argsort(held, kind="stable")

        numbers = np.zeros((len(parts) + len(unspelt), 4), np.int64)
        n = len(parts)
        for k, ends in enumerate((ends_a, ends_b, cuts)):
            numbers[:n, k] = np.bincount(np.searchsorted(starts, ends) - 1, minlength=n)
        np.add.at(numbers[:, 3], owner, links)
        counts = np.append(np.bincount(held, minlength=n), np.zeros(len(unspelt), np.int64))
        said = self._texts(ids_a, ids_b, group_a, group_b, in_a, in_b, owner)[:n] + [""] * len(unspelt)
        spelt = np.arange(n + len(unspelt)) < n
        return (parts + unspelt, numbers, spelt, said, counts, pairs[order], times[order]), again

    def _texts(self, ids_a, ids_b, group_a, group_b, in_a, in_b, owner) -> list[str]:
        """Groups of each piece of text, as a1,a2|b1;a3|b2."""
        if not len(owner):
            return []
        before = np.cumsum(in_a + in_b) - in_a - in_b
        last = np.append(owner[1:] != owner[:-1], True)
        at_a = before[group_a] + np.arange(len(ids_a)) - (np.cumsum(in_a) - in_a)[group_a]
        at_b = before[group_b] + in_a[group_b] + np.arange(len(ids_b)) - (np.cumsum(in_b) - in_b)[group_b]
        sign = np.zeros(len(ids_a) + len(ids_b), np.int64)  # , | ; and the end of a piece of text
        sign[before + in_a - 1] = 1
        sign[before + in_a + in_b - 1] = np.where(last, 3, 2)
        ids = np.empty(len(sign), np.int64)
        ids[at_a], ids[at_b] = ids_a, ids_b
        return "".join([self.names[k] for k in (ids * 4 + sign).tolist()]).split("\n")


def _slices(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of about ``most`` bytes of text, at most 512."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 512]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def _summed(held: Pieces, whole: np.ndarray, doc: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pairs of each document and how often each is linked in it."""
    counts = held.at[whole + 1] - held.at[whole]
    at = np.repeat(held.at[whole] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    keys = (np.repeat(doc, counts) << 44) | held.pairs[at]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.add.reduceat(held.times[at][order], first) if len(first) else np.zeros(0, np.int64)
    ends = np.cumsum(np.bincount(keys[first] >> 44, minlength=n))
    return pa.array(np.append(0, ends), pa.int32()), keys[first] & ((1 << 44) - 1), times


_ROW = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, links array<long>"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, texts: bool = True) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, links) of each document.

    ``row`` is a number of the row that lasts once the result is written; ``pairs`` are a * size of B + b, each once,
    ``links`` how often each is linked here. ``groups`` are left out without ``texts``. The vocabulary files
    must be at the same paths on all executors.
    """
    a, b = a or public_tokenizers.path(BYTE_MODEL), b or public_tokenizers.path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = Pieces(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _slices(batch):
                cuts = [cut(t) if t else [] for t in part.column(1).to_pylist()]
                held.add(cuts)
                own = [np.fromiter(map(held.known.__getitem__, c), np.int64, len(c)) for c in cuts]
                own = [x if held.spelt[x].all() else x[:0] for x in own]
                size = np.array([len(x) for x in own], np.int64)
                whole, doc = np.concatenate(own), np.repeat(np.arange(len(own)), size)
                numbers = np.zeros((len(own), 4), np.int64)
                np.add.at(numbers, doc, held.numbers[whole])
                said = [";".join([held.texts[k] for k in x.tolist()]) for x in own]
                ends, pairs, links = _summed(held, whole, doc, len(own))
                sha = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        rows, part.column(0), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(sha, pa.string()),
                        pa.array(said if texts else [None] * len(said), pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, links)),
                    ],
                    names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "links"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _ROW.replace("row long, ", f"row long, id {kind}, "))
    return out.withColumnRenamed("id", id_col)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of its A id has more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.withColumn("a", F.floor(F.col("pair") / size_b)).select("pair", "n", "a")


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, most_frequent_pairs: int = MOST_FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each document."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    size_b = sentencepiece.SentencePieceProcessor(model_file=b or public_tokenizers.path(MODEL)).get_piece_size()
    found = written(aligned(docs, id_col, text_col, a, b, texts=False).drop("groups"), folder, "aligned")
    counts = written(pair_counts(found, size_b), folder, "counts")
    # A row for each A id: bounded by the vocabulary.
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = written(counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), folder, "pairs")
    often = most_frequent(counts, "n", most_frequent_pairs)
    rare = counts.join(F.broadcast(often.select("pair")), "pair", "left_anti")
    links = found.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("links").alias("times"))))
    links = links.toDF("row", "pair", "times")
    met = links.join(F.broadcast(often), "pair")
    others = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rare, "pair")
    sums = met.unionByName(others).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = found.select("row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
