"""Nearest and containing points on a coordinate axis, without a cross or range join.

An axis is the set of distinct values of one coordinate.  Looking values up on it sorts both
sets together, one whole degree per task, and takes the neighbours from the sort order; what
lies beyond a degree's edge comes from a summary of at most 361 rows.  Cost grows with the two
axes, not with their product, and tables of cells never take part, only their axes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["axis_of", "bracket", "cell_edges", "with_edges"]


def _degree(value: Column) -> Column:
    return F.floor(value)


def _one_task(order: Column):
    """A window over the degree summary: one row per whole degree, so never more than 361."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def axis_of(df: DataFrame, column: str, knot: str = "knot") -> DataFrame:
    """Distinct values with their ascending index and both neighbours."""
    values = (
        df.select(F.col(column).alias(knot)).filter(F.col(knot).isNotNull()).distinct()
        .withColumn("_deg", _degree(F.col(knot)))
    )
    summary = values.groupBy("_deg").agg(
        F.count("*").alias("_n"), F.min(knot).alias("_lo"), F.max(knot).alias("_hi")
    )
    over = _one_task(F.col("_deg"))
    summary = summary.select(
        "_deg",
        (F.sum("_n").over(over) - F.col("_n")).alias("_before"),
        F.lag("_hi").over(over).alias("_outer_prev"),
        F.lead("_lo").over(over).alias("_outer_next"),
    )
    inside = Window.partitionBy("_deg").orderBy(knot)
    return values.join(summary, "_deg").select(
        knot,
        (F.col("_before") + F.row_number().over(inside) - 1).alias("index"),
        F.coalesce(F.lag(knot).over(inside), F.col("_outer_prev")).alias("prev"),
        F.coalesce(F.lead(knot).over(inside), F.col("_outer_next")).alias("next"),
    )


def cell_edges(knot: Column, prev: Column, following: Column) -> tuple[Column, Column]:
    """Edges halfway to the neighbours; the outermost ones mirror the inner ones."""
    alone = F.raise_error(F.lit("an axis needs at least two centres to have edges")).cast("double")
    below, above = (prev + knot) * 0.5, (knot + following) * 0.5
    low = F.coalesce(below, knot - (above - knot), alone)
    high = F.coalesce(above, knot + (knot - below), alone)
    return low, high


def with_edges(axis: DataFrame) -> DataFrame:
    """Add ``low``, ``high`` and ``is_last`` to an axis."""
    low, high = cell_edges(F.col("knot"), F.col("prev"), F.col("next"))
    return axis.select(
        "knot", "index", low.alias("low"), high.alias("high"), F.col("next").isNull().alias("is_last")
    )


def bracket(points: DataFrame, column: str, knots: DataFrame, at: str) -> DataFrame:
    """For each distinct point the knots around it, as structs ``below`` and ``above``.

    ``below`` is the knot row with the largest ``at`` not above the point, ``above`` the one
    with the smallest ``at`` above it; either is NULL beyond the ends.
    """
    payload = F.struct(at, *[c for c in knots.columns if c != at])
    marks = knots.select(F.col(at).alias("_v"), payload.alias("_knot"))
    wanted = (
        points.select(F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
        .distinct().withColumn("_knot", F.lit(None).cast(marks.schema["_knot"].dataType))
    )
    both = marks.unionByName(wanted).withColumn("_deg", _degree(F.col("_v"))).withColumn(
        "_point", F.col("_knot").isNull()
    )
    summary = both.groupBy("_deg").agg(F.min("_knot").alias("_lo"), F.max("_knot").alias("_hi"))
    earlier = _one_task(F.col("_deg")).rowsBetween(Window.unboundedPreceding, -1)
    later = _one_task(F.col("_deg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        "_deg",
        F.last("_hi", ignorenulls=True).over(earlier).alias("_outer_below"),
        F.last("_lo", ignorenulls=True).over(later).alias("_outer_above"),
    )
    # At equal values the knot precedes the point going up and follows it going down, so it
    # is below the point and not above it.
    up = Window.partitionBy("_deg").orderBy("_v", "_point").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    down = Window.partitionBy("_deg").orderBy(F.desc("_v"), F.desc("_point")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        both.join(summary, "_deg")
        .select(
            F.col("_v").alias(column), "_point",
            F.coalesce(F.last("_knot", ignorenulls=True).over(up), F.col("_outer_below")).alias("below"),
            F.coalesce(F.last("_knot", ignorenulls=True).over(down), F.col("_outer_above")).alias("above"),
        )
        .filter("_point").drop("_point")
    )
