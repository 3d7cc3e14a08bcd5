"""Common value ranges of several result fields, for one scale across panels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["exact_percentile", "order_statistics", "pooled", "shared_limits", "symmetric_limits"]

# Parts of a range that are counted at a time; the driver sees no more rows than this for each rank.
_PARTS = 16_384


def pooled(fields: list[tuple[DataFrame, str]]) -> DataFrame:
    """All finite values of several (table, column) fields in one column ``value``."""
    parts = [table.select(F.col(c).cast("double").alias("value")) for table, c in fields]
    return reduce(DataFrame.union, parts).filter(F.abs("value") < float("inf"))


def _spread(values: DataFrame, column: str) -> tuple[int, float | None, float | None]:
    """How many values there are, the least and the largest."""
    row = values.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    return row["n"], row["low"], row["high"]


def order_statistics(
    values: DataFrame, column: str, ranks: list[int], span: tuple[float, float] | None = None
) -> list[float]:
    """The values at some ranks (from 0) of all values in order.  Runs a few small jobs.

    Each job counts the values of a range in equal parts, with the least and largest of each part, and goes
    on with the part that holds the rank until that part has one value.  No value is moved or
    put in order, so neither many values nor many equal ones land in one task; a range shrinks by the number
    of parts each time, so two or three jobs do for values that are spread evenly.  ``span``, the least and
    the largest value, saves a job where they are known.
    """
    v = F.col(column)
    low, high = span or _spread(values, column)[1:]
    brackets = {rank: (low, high, 0) for rank in ranks}
    while True:
        asked = sorted({b for b in brackets.values() if b[0] != b[1]})
        if not asked:
            return [brackets[rank][0] for rank in ranks]
        which, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (low, high, _) in enumerate(asked):
            # Scaled down where the width of the range is no finite number.
            scale = 1.0 if high - low < float("inf") else 0.25
            place = (v * scale - low * scale) / (high * scale - low * scale) * _PARTS
            inside = v.between(low, high)
            which = F.when(inside, k).otherwise(which)
            part = F.when(inside, F.least(F.floor(place), F.lit(_PARTS - 1)).cast("int")).otherwise(part)
        parts = (
            values.select(v.alias("v"), which.alias("which"), part.alias("part")).filter("which IS NOT NULL")
            .groupBy("which", "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()
        )
        for rank, bracket in brackets.items():
            if bracket[0] == bracket[1]:
                continue
            before = bracket[2]
            for row in sorted((r for r in parts if r["which"] == asked.index(bracket)), key=lambda r: r["part"]):
                if rank < before + row["n"]:
                    brackets[rank] = (row["low"], row["high"], before)
                    break
                before += row["n"]


def _percentile(values: DataFrame, column: str, percentile: float, n: int, low: float, high: float) -> float:
    rank = (n - 1) * (percentile / 100.0)
    below, above = math.floor(rank), math.ceil(rank)
    lower, upper = order_statistics(values.filter(F.col(column).isNotNull()), column, [below, above], (low, high))
    return lower + (upper - lower) * (rank - below)


def exact_percentile(values: DataFrame, column: str, percentile: float) -> DataFrame:
    """The exact percentile with linear interpolation, as a one-row table ``percentile``; NULL of no values."""
    n, low, high = _spread(values, column)
    result = _percentile(values, column, percentile, n, low, high) if n else None
    return values.sparkSession.range(1).select(F.lit(result).cast("double").alias("percentile"))


def _limits(values: DataFrame, percentile: float | None) -> tuple[float, float]:
    """The least value, and a high percentile or the largest one."""
    n, low, high = _spread(values, "value")
    if not n:
        raise ValueError("no finite values to take limits from")
    return low, high if percentile is None else _percentile(values, "value", percentile, n, low, high)


def _row(values: DataFrame, low: float, high: float) -> DataFrame:
    return values.sparkSession.range(1).select(F.lit(low).alias("vmin"), F.lit(high).alias("vmax"))


def shared_limits(
    fields: list[tuple[DataFrame, str]], percentile: float | None = 99.0,
    minimum_at_zero: bool = False,
) -> DataFrame:
    """One row ``(vmin, vmax)``: smallest value or zero, and a high percentile of all values."""
    values = pooled(fields)
    low, top = _limits(values, percentile)
    low = 0.0 if minimum_at_zero else low
    return _row(values, low, top if top > low else low + 1.0)


def symmetric_limits(
    fields: list[tuple[DataFrame, str]], percentile: float | None = 99.0
) -> DataFrame:
    """One row ``(vmin, vmax)`` centred on zero, from a percentile of the magnitudes."""
    sizes = pooled(fields).select(F.abs("value").alias("value"))
    _, top = _limits(sizes, percentile)
    size = top if top > 0 else 1.0
    return _row(sizes, -size, size)
