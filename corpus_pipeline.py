"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of documents. Null and empty texts fail the quality rules. Rows that
repeat an id are one document: what is decided for the id holds for each of them. Rows without
id can't be grouped and pass the stages that compare texts. An empty table stays empty.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.decontam import contained
from aeolia.llm.near import jaccard_components
from aeolia.llm.pieces import encode
from aeolia.llm.quality import keep_good
from aeolia.llm.secrets import redact, train
from aeolia.llm.tables import dropped, shared_folder, table, written


_used = threading.local()


def _folder(spark: SparkSession) -> str:
    """A folder for the tables that a stage writes on its way.

    A stage gets its predecessor's rows as written, so what the predecessors of this thread's run needed on
    their way is removed here.
    """
    for path in getattr(_used, "folders", []):
        dropped(spark, path)
    _used.folders = [shared_folder(spark)]
    return _used.folders[0]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids``; rows without id stay."""
    return docs.join(ids.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language's references."""
    return keep_good(docs, _folder(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies (five words, 0.8)."""
    found = jaccard_components(docs, k=5, percent=80, folder=_folder(spark))
    return _without(docs, found.where(F.col("component_id") != F.col("doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark passage."""
    _folder(spark)
    return _without(docs, contained(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return redact(docs, train(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids and the ids of each text as text, joined by commas."""
    return encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", encoding),
]
#: SQL can express neither the tagger nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, str(k))
    return docs
