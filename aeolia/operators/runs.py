"""Runs of a condition along time: episodes, their number and their length.

A run is a stretch of consecutive steps, so a missing row ends it just as a false one does.
Because of that only the rows where the condition holds need to be shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolia.fixed_values import CELL, DUNKELFLAUTE_MIN_HOURS, TIME
from aeolia.functions.basics import holds
from aeolia.operators.timeline import (
    BLOCK_HOURS, block_seconds, cell_columns, own_block, step_hours, with_halo,
)

__all__ = ["event_statistics", "min_steps", "run_totals", "statistic_columns", "sustained", "sustained_rows"]


def min_steps(min_duration_hours: float, timestep_hours: float) -> int:
    return math.ceil(min_duration_hours / timestep_hours)


def sustained(
    df: DataFrame, condition: Column, output: str = "sustained",
    min_duration_hours: float = DUNKELFLAUTE_MIN_HOURS, *, timestep_hours: float | None = None,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Add a boolean column: the condition holds here and in a long enough run.

    Whether a step lies in a run of n steps is settled by the n - 1 steps on either side of
    it, so a halo of that reach makes each block complete.
    """
    dt = step_hours(df, timestep_hours, time)
    need = min_steps(min_duration_hours, dt)
    flagged = df.withColumn("_on", holds(condition))
    if need <= 1:
        return flagged.withColumn(output, F.col("_on")).drop("_on")
    dt_s = int(round(dt * 3600))
    reach = (need - 1) * dt_s
    length = block_seconds(block_hours, reach)
    keys = cell_columns(df, cell)
    rows = _run_ids(with_halo(flagged, length, reach, reach, time), keys, dt_s)
    # Asked in the order of time only, so that a task sorts its rows once: a step lies in a long enough
    # run if one of the steps up to it, no further back than the reach, begins need steps of one run.
    along = Window.partitionBy(*keys, "_blk").orderBy("_t")
    begins = F.col("_on") & holds(F.lead("_run", need - 1).over(along) == F.col("_run"))
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_begins", F.when(begins, F.col("_t")))
        .withColumn("_begun", F.max("_begins").over(so_far))
        .filter(own_block(length))
        .withColumn(output, F.col("_on") & holds(F.col("_begun") >= F.col("_t") - reach))
        .drop("_on", "_run", "_begins", "_begun", "_t", "_blk")
    )


def sustained_rows(
    df: DataFrame, condition: Column, min_duration_hours: float = DUNKELFLAUTE_MIN_HOURS, *,
    timestep_hours: float, cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Only the rows inside long enough runs; rows outside are dropped before the shuffle."""
    return sustained(
        df.filter(condition), F.lit(True), "_kept", min_duration_hours,
        timestep_hours=timestep_hours, cell=cell, time=time, block_hours=block_hours,
    ).filter("_kept").drop("_kept")


def _run_ids(blocked: DataFrame, keys: list[str], dt_s: int) -> DataFrame:
    """``_run``: equal within a run, since time and the count of true steps rise together."""
    so_far = Window.partitionBy(*keys, "_blk").orderBy("_t").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return blocked.withColumn("_run", F.col("_t") - F.count_if("_on").over(so_far) * F.lit(dt_s))


def run_totals(
    df: DataFrame, condition: Column, durations: list[int] | None = None, *,
    timestep_hours: float, cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Per cell: runs, steps in runs and longest run.  Cells without any run are absent.

    ``durations`` gives minimum lengths in steps; each adds ``runs_<n>`` and ``steps_<n>``.
    Without it the columns are ``runs``, ``steps`` and ``longest``.

    The rows are shuffled once by cell and block.  A block is reduced to at most three rows:
    the run touching its start, the runs inside it taken together, and the run touching its
    end.  Only these travel to the per-cell stage, where runs that cross edges are joined.
    """
    keys = cell_columns(df, cell)
    dt_s = int(round(timestep_hours * 3600))
    length = block_seconds(block_hours)
    wanted = durations or [1]

    on = df.filter(condition).select(*keys, time).withColumn("_on", F.lit(True))
    islands = (
        _run_ids(with_halo(on, length, 0, 0, time), keys, dt_s)
        .groupBy(*keys, "_blk", "_run")
        .agg(F.count("*").alias("_n"), F.min("_t").alias("_from"), F.max("_t").alias("_to"))
    )
    opens = F.col("_from") - dt_s < F.col("_blk") * F.lit(length)
    closes = F.col("_to") + dt_s >= (F.col("_blk") + 1) * F.lit(length)
    pieces = (
        islands.withColumn("_slot", F.when(opens, 0).when(closes, 2).otherwise(1))
        .groupBy(*keys, "_blk", "_slot")
        .agg(
            F.sum("_n").alias("_n"), F.max("_n").alias("_longest"),
            F.min("_from").alias("_from"), F.max("_to").alias("_to"),
            *[F.count_if(F.col("_n") >= k).alias(f"_runs_{k}") for k in wanted],
            *[F.sum(F.when(F.col("_n") >= k, F.col("_n")).otherwise(0)).alias(f"_steps_{k}")
              for k in wanted],
        )
    )

    along = Window.partitionBy(*keys).orderBy("_blk", "_slot")
    joins_on = holds(F.lag("_to").over(along) + dt_s == F.col("_from"))
    chains = (
        pieces.withColumn("_new", F.when(joins_on, 0).otherwise(1))
        .withColumn("_chain", F.sum("_new").over(along))
        .groupBy(*keys, "_chain")
        .agg(
            F.bool_or(F.col("_slot") == 1).alias("_inner"),
            F.sum("_n").alias("_n"), F.max("_longest").alias("_longest"),
            *[F.sum(f"_{what}_{k}").alias(f"_{what}_{k}")
              for what in ("runs", "steps") for k in wanted],
        )
    )
    inner = F.col("_inner")
    columns = []
    for k in wanted:
        tail = "" if durations is None else f"_{k}"
        whole = F.col("_n") >= k
        columns += [
            F.sum(F.when(inner, F.col(f"_runs_{k}")).otherwise(whole.cast("bigint")))
            .alias(f"runs{tail}"),
            F.sum(F.when(inner, F.col(f"_steps_{k}")).when(whole, F.col("_n")).otherwise(0))
            .alias(f"steps{tail}"),
        ]
    longest = F.max(F.when(inner, F.col("_longest")).otherwise(F.col("_n"))).alias("longest")
    return chains.groupBy(*keys).agg(*columns, longest)


def event_statistics(
    df: DataFrame, condition: Column, *, min_duration_hours: float | None = None,
    timestep_hours: float | None = None, prefix: str = "", record: DataFrame | None = None,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Per cell: event_count, total_hours, frequency and longest_event_hours.

    With ``min_duration_hours`` shorter runs do not count.  ``frequency`` divides by the
    rows of the record, missing values included; ``record`` overrides it with a table of
    ``record_steps`` per cell.
    """
    dt = step_hours(df, timestep_hours, time)
    keys = cell_columns(df, cell)
    need = max(1, min_steps(min_duration_hours, dt)) if min_duration_hours is not None else 1
    totals = run_totals(
        df, condition, [need], timestep_hours=dt, cell=cell, time=time, block_hours=block_hours
    ).withColumn("longest", F.when(F.col("longest") >= need, F.col("longest")))
    if record is None:
        record = df.groupBy(*keys).agg(F.count("*").alias("record_steps"))
    return finish_statistics(record, totals, keys, f"runs_{need}", f"steps_{need}", dt, prefix)


def finish_statistics(
    record: DataFrame, totals: DataFrame, keys: list[str], runs: str, steps: str, dt: float,
    prefix: str = "",
) -> DataFrame:
    """Join run totals to the record lengths; cells without runs get zeros."""
    joined = record.join(totals, keys, "left") if keys else record.join(totals, how="left")
    return joined.select(*keys, *statistic_columns(runs, steps, "longest", dt, prefix))


def statistic_columns(runs: str, steps: str, longest: str, dt: float, prefix: str = "") -> list[Column]:
    """The statistics of a row of run totals that has ``record_steps``; missing totals are zeros."""
    count, on, most = (F.coalesce(F.col(c), F.lit(0)) for c in (runs, steps, longest))
    return [
        count.cast("bigint").alias(f"{prefix}event_count"),
        (on * dt).alias(f"{prefix}total_hours"),
        (on / F.col("record_steps")).alias(f"{prefix}frequency"),
        (most * dt).alias(f"{prefix}longest_event_hours"),
    ]
