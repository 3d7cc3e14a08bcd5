"""Accumulated fluxes to per-step values and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolia.fixed_values import (
    ACCUMULATION_KINDS,
    CELL,
    INSTANTANEOUS,
    INSTANTANEOUS_MEAN_LIMIT,
    PERIOD,
    PERIOD_MIN_DECREASING,
    RUNNING,
    RUNNING_MAX_DECREASING,
    TIME,
)
from aeolia.operators.timeline import BLOCK_HOURS, median_timestep_seconds, with_previous

__all__ = ["accumulation_kinds", "infer_accumulation_kind", "to_rate", "to_rates"]


def _increment(
    value: Column, previous: Column, is_first: Column, time: Column,
    reset_hours: float | None, reset_offset: int,
) -> Column:
    """What a running total gained in this step; after a restart that is the total itself."""
    gained = value - previous
    if reset_hours is None:
        restarted = gained < 0
    else:
        # pmod keeps hour 0 with offset 1 at 23, where % would give -1.
        restarted = F.pmod(F.hour(time) - reset_offset, F.lit(int(reset_hours))) == 0
    return F.when(is_first | F.coalesce(restarted, F.lit(False)), value).otherwise(gained)


def to_rates(
    df: DataFrame, kinds: dict[str, str], *, timestep_seconds: float | None = None,
    per_second=(), reset_hours: float | None = None, reset_offset: int = 0,
    clip_negative: bool = True, null_as_zero: bool = False, units: dict | None = None,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
    keep_from=None, keep_until=None,
) -> DataFrame:
    """Undo accumulation in several columns at once, with a single pass along time.

    ``kinds`` maps a column to instantaneous, period or running.  Columns in ``per_second``
    are divided by the step length afterwards.  ``null_as_zero`` makes clipping turn missing
    values into zero.
    """
    for name, kind in kinds.items():
        if kind not in ACCUMULATION_KINDS:
            raise ValueError(f"unknown accumulation {kind!r}; use one of {ACCUMULATION_KINDS}")
        if df.schema[name].metadata.get("accumulation_converted"):
            raise ValueError(f"{name!r} is already converted; a second pass would divide again")
    accumulated = {name: kind for name, kind in kinds.items() if kind != INSTANTANEOUS}
    if timestep_seconds is None and any(name in per_second for name in accumulated):
        timestep_seconds = median_timestep_seconds(df, time=time)

    running = [name for name, kind in accumulated.items() if kind == RUNNING]
    result = df
    if running:
        result = with_previous(
            df, {**{name: f"_prev_{name}" for name in running}, time: "_prev_time"},
            cell=cell, time=time, block_hours=block_hours,
            keep_from=keep_from, keep_until=keep_until,
        )
    values = {}
    for name, kind in accumulated.items():
        value = F.col(name)
        if kind == RUNNING:
            value = _increment(
                value, F.col(f"_prev_{name}"), F.col("_prev_time").isNull(), F.col(time),
                reset_hours, reset_offset,
            )
        if name in per_second:
            value = value / F.lit(float(timestep_seconds))
        if clip_negative:
            zeroed = (value < 0) | value.isNull() if null_as_zero else value < 0
            value = F.when(zeroed, 0.0).otherwise(value)
        values[name] = value
    result = result.withColumns(values) if values else result
    for name, kind in kinds.items():
        facts = {
            **df.schema[name].metadata, "accumulation_converted": True, "accumulation_kind": kind,
        }
        if kind != INSTANTANEOUS:
            facts["per_second"] = name in per_second
            if timestep_seconds is not None:
                facts["timestep_seconds"] = float(timestep_seconds)
        if units and name in units:
            facts["units"] = units[name]
        result = result.withMetadata(name, facts)
    return result.drop("_prev_time", *[f"_prev_{name}" for name in running])


def to_rate(df: DataFrame, column: str, kind: str, *, per_second: bool = True, **options) -> DataFrame:
    """:func:`to_rates` for one column."""
    return to_rates(df, {column: kind}, per_second=(column,) if per_second else (), **options)


def _leading(df: DataFrame, keys: list[str], time: str, sample_steps: int) -> DataFrame:
    """Rows of the first time steps of each product."""
    steps = df.select(*keys, time).distinct()
    ranked = steps.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(time)))
    # Spark prunes ranks within each task before the shuffle, so few steps travel.
    last = ranked.filter(F.col("_rank") <= sample_steps).groupBy(*keys).agg(F.max(time).alias("_last"))
    return (
        # A row for each product: joined by product, all rows of one would meet in a task.
        df.join(F.broadcast(last), keys) if keys else df.withColumn("_last", last.scalar())
    ).filter(F.col(time) <= F.col("_last"))


def accumulation_kinds(
    df: DataFrame, column: str, *, sample_steps: int | None = None, by=("product",), time: str = TIME
) -> DataFrame:
    """Per product, how the flux seems to be accumulated, judged from all its time steps.

    ``sample_steps`` judges by that many leading steps only.

    Columns: sample_mean, n_steps, decreasing_share and kind; kind is NULL where the sample
    does not tell (constant, too short, or a share between the bounds).
    """
    keys = [name for name in by if name in df.columns]
    leading = df if sample_steps is None else _leading(df, keys, time, sample_steps)
    series = leading.groupBy(*keys, time).agg(
        F.avg(column).alias("_mean"), F.sum(column).alias("_sum"), F.count(column).alias("_n")
    )
    # One row per product and step from here on.
    change = F.col("_mean") - F.lag("_mean").over(Window.partitionBy(*keys).orderBy(time))
    judged = series.withColumn("_change", change).groupBy(*keys).agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("sample_mean"),
        F.count("*").alias("n_steps"),
        F.try_divide(
            F.count_if(F.col("_change") < 0), F.count_if(F.col("_change") != 0)
        ).alias("decreasing_share"),
    )
    share = F.col("decreasing_share")
    kind = (
        F.when(F.col("sample_mean") < INSTANTANEOUS_MEAN_LIMIT, INSTANTANEOUS)
        .when(F.col("n_steps") < 3, None)
        .when(share <= RUNNING_MAX_DECREASING, RUNNING)
        .when(share >= PERIOD_MIN_DECREASING, PERIOD)
    )
    return judged.withColumn("kind", kind)


def infer_accumulation_kind(df: DataFrame, column: str, **options) -> str:
    """The kind for a table of one product; an unclear sample is an error.  Runs a Spark job."""
    row = accumulation_kinds(df, column, by=(), **options).first()
    if row["kind"] is None:
        reason = (
            "fewer than three steps" if row["n_steps"] < 3
            else "the sample is constant in time" if row["decreasing_share"] is None
            else f"{row['decreasing_share']:.0%} of the changes are decreases"
        )
        raise ValueError(f"cannot tell how {column!r} is accumulated: {reason}; declare the kind")
    return row["kind"]
