"""Looking along time without putting a whole record into one task.

A window over a cell holds that cell's full record in one task, and one cell may hold a
third of all rows.  The operators here cut each record into blocks of fixed length and
shuffle by ``(cell, block)``.  What crosses a block edge is carried in one of two ways:

* :func:`shifted` and the run operators copy the rows within a known reach of an edge into
  the neighbouring block (a halo), so one shuffle is enough;
* :func:`with_previous` needs the previous row however far back it is, so it adds the last
  row of each block to the next block that has rows.

Both are exact.  The number of blocks per cell is bounded by the length of the record in
time, not by the number of rows.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolia.fixed_values import CELL, TIME
from aeolia.functions.basics import epoch_seconds

__all__ = [
    "BLOCK_HOURS", "block_of", "cell_columns", "infer_timestep_hours", "median_timestep_seconds",
    "shifted", "time_steps", "timestep_report", "with_halo", "with_previous",
]

# About a season of hourly steps: halos of a few days stay a small share of the rows.
BLOCK_HOURS = 2160


def cell_columns(df: DataFrame, cell=CELL) -> list[str]:
    """The cell key columns that the table has; a plain series may have just one of them."""
    keys = [name for name in cell if name in df.columns]
    if cell and not keys:
        raise ValueError(f"the table has none of the key columns {list(cell)}")
    return keys


def block_seconds(block_hours: float, reach_seconds: float = 0) -> int:
    """Block length, never shorter than eight times the halo it needs."""
    return int(max(block_hours * 3600, 8 * reach_seconds))


def block_of(seconds: Column, length: int) -> Column:
    return F.floor(seconds / F.lit(length))


def with_halo(
    df: DataFrame, length: int, reach_back: int, reach_ahead: int, time: str = TIME
) -> DataFrame:
    """Add ``_t`` (epoch seconds), and ``_blk`` once per block that needs the row.

    A block needs the rows up to ``reach_back`` seconds before its start and up to
    ``reach_ahead`` seconds after its end.  Filter with :func:`own_block` afterwards.
    """
    timed = df.withColumn("_t", epoch_seconds(F.col(time)))
    first = block_of(F.col("_t") - F.lit(reach_ahead), length)
    last = block_of(F.col("_t") + F.lit(reach_back), length)
    if reach_back == 0 and reach_ahead == 0:
        return timed.withColumn("_blk", block_of(F.col("_t"), length))
    return timed.withColumn("_blk", F.explode(F.sequence(first, last)))


def own_block(length: int) -> Column:
    """Keeps each row once, in the block it lies in."""
    return F.col("_blk") == block_of(F.col("_t"), length)


def shifted(
    df: DataFrame, columns: dict[str, str], steps: int, timestep_hours: float, *,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Add the value a whole number of steps earlier under a new name.

    ``columns`` maps source to new name.  The value is looked up by time, so a missing row
    gives NULL and does not shift its neighbours.
    """
    reach = int(round(steps * timestep_hours * 3600))
    length = block_seconds(block_hours, reach)
    window = (
        Window.partitionBy(*cell_columns(df, cell), "_blk").orderBy("_t").rangeBetween(-reach, -reach)
    )
    return (
        with_halo(df, length, reach, 0, time)
        .withColumns({new: F.last(old).over(window) for old, new in columns.items()})
        .filter(own_block(length))
        .drop("_t", "_blk")
    )


def with_previous(
    df: DataFrame, columns: dict[str, str], *,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
    keep_from=None, keep_until=None,
) -> DataFrame:
    """Add the value of the previous row of the cell, however far back, under a new name.

    ``columns`` maps source to new name and may include the time column.  With
    ``keep_from`` and ``keep_until`` (time stamps) only the blocks that overlap that span are
    returned; rows before it are still used as predecessors.
    """
    keys = cell_columns(df, cell)
    length = block_seconds(block_hours)
    blocked = df.withColumn("_blk", block_of(epoch_seconds(F.col(time)), length))
    needed = list(dict.fromkeys([*columns, time]))

    # The last row of each block.  max_by combines before the shuffle, so a block's rows
    # never travel for this.
    tails = blocked.groupBy(*keys, "_blk").agg(
        *[F.max_by(c, time).alias(c) for c in needed if c != time], F.max(time).alias(time)
    )
    following = F.lead("_blk").over(Window.partitionBy(*keys).orderBy("_blk"))
    carried = (
        tails.withColumn("_blk", following).filter(F.col("_blk").isNotNull())
        .withColumn("_carried", F.lit(True))
    )
    rows = blocked
    if keep_from is not None:
        rows = rows.filter(F.col(time) >= _block_edge(keep_from, length, 0))
    if keep_until is not None:
        rows = rows.filter(F.col(time) < _block_edge(keep_until, length, 1))

    window = Window.partitionBy(*keys, "_blk").orderBy(time)
    return (
        rows.withColumn("_carried", F.lit(False))
        .unionByName(carried, allowMissingColumns=True)
        .withColumns({new: F.lag(old).over(window) for old, new in columns.items()})
        .filter(~F.col("_carried"))
        .drop("_carried", "_blk")
    )


def _block_edge(stamp, length: int, after: int) -> Column:
    """Start of the block of a time stamp, or of the block after it, as a constant."""
    epoch = datetime(1970, 1, 1)
    block = math.floor((stamp - epoch).total_seconds() / length) + after
    return F.lit(epoch + timedelta(seconds=block * length)).cast("timestamp_ntz")


def time_steps(
    df: DataFrame, *, by=("product",), time: str = TIME, block_hours: float = BLOCK_HOURS
) -> DataFrame:
    """The distinct time stamps with the spacing to the one before, in seconds."""
    keys = cell_columns(df, by)
    axis = df.select(*keys, time).distinct()
    linked = with_previous(axis, {time: "_prev"}, cell=keys, time=time, block_hours=block_hours)
    spacing = epoch_seconds(F.col(time)) - epoch_seconds(F.col("_prev"))
    return linked.select(*keys, time, spacing.alias("spacing_seconds"))


def timestep_report(df: DataFrame, *, by=("product",), time: str = TIME) -> DataFrame:
    """Per product: number of steps, smallest, largest and median spacing in hours."""
    keys = cell_columns(df, by)
    hours = F.col("spacing_seconds") / 3600.0
    return time_steps(df, by=by, time=time).groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        F.min(hours).alias("min_hours"),
        F.max(hours).alias("max_hours"),
        # Few different spacings exist, so the exact percentile keeps few counters.
        F.percentile("spacing_seconds", 0.5).alias("median_seconds"),
    )


def infer_timestep_hours(df: DataFrame, *, time: str = TIME) -> float:
    """The one spacing of a regular time axis, in hours.  Runs a Spark job.

    Each product has an axis of its own; products of different spacing have no one answer.
    """
    if time not in df.columns:
        raise ValueError(f"no {time!r} column to infer the time step from")
    rows = timestep_report(df, time=time).collect()  # a row for each product
    if not rows or max(r["n_steps"] for r in rows) < 2:
        raise ValueError("at least two time steps are needed to infer the spacing")
    row = rows[0]
    if len({r["median_seconds"] for r in rows}) > 1:
        found = {r["product"]: r["median_seconds"] / 3600 for r in rows}
        raise ValueError(f"products differ in time step, in hours: {found}; pass the step, or one product at a time")
    row = next((r for r in rows if not math.isclose(r["min_hours"], r["max_hours"], rel_tol=1e-5)), row)
    if not math.isclose(row["min_hours"], row["max_hours"], rel_tol=1e-5):
        found = (
            time_steps(df, time=time).select("spacing_seconds").distinct()
            .orderBy("spacing_seconds").limit(10).dropna().collect()
        )
        raise ValueError(
            "irregular time axis; spacings in hours include "
            f"{[r['spacing_seconds'] / 3600 for r in found]}"
        )
    return float(row["min_hours"])


def median_timestep_seconds(df: DataFrame, *, time: str = TIME) -> float:
    """Median spacing in seconds, regular or not.  Runs a Spark job."""
    row = timestep_report(df, by=(), time=time).first()
    if row["n_steps"] < 2:
        raise ValueError("at least two time steps are needed to infer the spacing")
    return float(row["median_seconds"])


def step_hours(df: DataFrame, timestep_hours: float | None, time: str = TIME) -> float:
    return infer_timestep_hours(df, time=time) if timestep_hours is None else float(timestep_hours)
