"""Near-duplicate search returns every row, also those without id; shared folders are asked for on clusters."""

import pytest
from pyspark.sql import functions as F

from aeolia.llm import near, tables


def test_rows_without_id_are_returned(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, None), (None, "x y"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = sorted(map(tuple, near.jaccard_components(docs, 3, 90).collect()), key=str)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (None, 3, None), (None, 0, None), (None, 1, None), (3, 0, 3)], key=str)


class Session:
    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key.removeprefix("spark.").replace(".", "_"), default)


def test_a_cluster_needs_a_shared_folder():
    assert tables.shared_folder(Session(checkpoint_dir="file:///shared/", master="spark://x")).startswith("file:///shared/")
    assert tables.shared_folder(Session(master="local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session(master="local-cluster[2,1,1024]"))
