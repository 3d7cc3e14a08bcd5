"""Provenance: thresholds, choices and counts kept as rows next to a result."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["counts_as_json", "provenance_rows", "provenance_values"]

_SCHEMA = "output string, key string, value_json string"


def provenance_rows(spark: SparkSession, output: str, entries: dict) -> DataFrame:
    """One ``(output, key, value_json)`` row per entry of a small mapping."""
    rows = [
        (output, key, json.dumps(value, sort_keys=True, default=str))
        for key, value in sorted(entries.items())
    ]
    return spark.createDataFrame(rows, _SCHEMA)


def counts_as_json(counts: DataFrame, key: str, count: str, output: str = "value_json") -> DataFrame:
    """Fold a short ``(key, count)`` report into one JSON object, keys sorted, zeros left out.

    The report has one row per checked variable, so folding it into one row is bounded
    by the vocabulary and not by the data.
    """
    kept = counts.filter(F.col(count) > 0)
    entries = F.sort_array(F.collect_list(F.struct(key, count)))
    return kept.agg(F.to_json(F.map_from_entries(entries)).alias(output))


def provenance_values(rows: DataFrame, output: str) -> dict:
    """The entries of one output as Python values; a mapping of a few facts, not of data."""
    own = rows.filter(F.col("output") == output).select("key", "value_json").collect()
    return {key: json.loads(text) for key, text in own}
