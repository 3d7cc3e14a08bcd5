"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next marker. No piece
of the vocabulary has a marker after another character, so merges never leave a chunk, and
each distinct chunk is segmented once in a task and joined back by position.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded
alike. Only the chosen columns are read; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import table

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
#: Chunks that a task keeps; when they are more, the table begins anew.
MOST_CHUNKS = 400_000
_CHUNK = re.compile(r" +[^ ]*")


@lru_cache(maxsize=2)
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    made = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(made.get_piece_size()):
        if MARKER in made.id_to_piece(i).lstrip(MARKER):
            raise ValueError(f"{path}: a piece crosses a white-space marker; chunks can't be encoded by themselves")
    return made


class ChunkTable:
    """chunk without its first marker -> its ids as text; a chunk that decodes otherwise is in ``odd``."""

    def __init__(self, path: str):
        self.made = _processor(path)
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def add(self, texts: list[list[str]]) -> None:
        if len(self.ids) > MOST_CHUNKS:
            self.ids, self.odd = {}, {}
        found = set().union(*texts)
        new = [c for c in found if c not in self.ids]
        # The processor puts the first marker in front by itself, but for the empty string.
        ids = [[self.made.piece_to_id(MARKER)] if not c else i for c, i in zip(new, self.made.encode(new, num_threads=1), strict=True)]
        self.ids.update(zip(new, [str(i)[1:-1].replace(" ", "") for i in ids], strict=True))
        self.odd.update((c, t) for c, t in zip(new, self.made.decode(ids, num_threads=1), strict=True) if c != t)

    def encoded(self, chunks: list[str]) -> tuple[int, str, str]:
        if not chunks:
            return 0, "", ""
        ids = ",".join([self.ids[c] for c in chunks])
        text = " ".join([self.odd.get(c, c) for c in chunks] if self.odd else chunks)
        return ids.count(",") + 1, ids, text


def chunked(text: str) -> list[str]:
    """Chunks of a text, each without its first marker."""
    if MARKER in text:
        text = text.replace(MARKER, " ")
    if "  " in text or text[:1] == " ":
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ") if text else []


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as text joined by commas; with ``digests`` their SHA-256 instead.

    The table of an empty input has no rows. The vocabulary file must be at the same path on
    all executors.
    """
    path = model or public_tokenizers.path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(path)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [chunked(t or "") for t in part.column(1).to_pylist()]
                chunks.add(texts)
                rows = [chunks.encoded(t) for t in texts]
                last = [[f(x[k]) for x in rows] for k in (1, 2) for f in ([sha] if digests else [str])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in rows], pa.int64()), *(pa.array(x, pa.string()) for x in last)],
                    names=["id", "n_tokens", *names],
                )

    schema = f"id {kind}, n_tokens long, {names[0]} string, {names[1]} string"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
