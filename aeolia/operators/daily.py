"""Daily statistics and what is counted or summed over days.

Both stages are algebraic aggregates: rows meet before the first shuffle, which moves one
row per cell and day at most, and days meet before the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolia.fixed_values import ALPINE_STORM_THRESHOLDS, CDD_BASE, CELL, HDD_BASE, HOT_DAY_THRESHOLD, TIME
from aeolia.functions.units import convert_temperature
from aeolia.operators.timeline import cell_columns

__all__ = [
    "cooling_degree_days", "daily", "daily_mean_temperature", "degree_days", "exceedance_days",
    "heating_degree_days", "hot_days", "storm_days",
]

_REDUCTIONS = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}
# Period totals are labelled with the last day of the period.
_PERIODS = {
    "month": lambda day: F.last_day(day),
    "year": lambda day: F.make_date(F.year(day), F.lit(12), F.lit(31)),
}
_PERIODS["1ME"], _PERIODS["1YE"] = _PERIODS["month"], _PERIODS["year"]


def daily(
    df: DataFrame, statistics: dict[str, Column], *, cell=CELL, time: str = TIME
) -> DataFrame:
    """One row per cell and calendar day with the named aggregates."""
    if time not in df.columns:
        raise ValueError(f"the table has no {time!r} column")
    return df.groupBy(*cell_columns(df, cell), F.to_date(time).alias("day")).agg(
        *[value.alias(name) for name, value in statistics.items()]
    )


def reduction(name: str, column) -> Column:
    if name not in _REDUCTIONS:
        raise ValueError(f"unknown daily reduction {name!r}; use one of {sorted(_REDUCTIONS)}")
    return _REDUCTIONS[name](column)


def daily_mean_temperature(
    df: DataFrame, column: str = "temperature_2m", *, assume: str | None = None,
    cell=CELL, time: str = TIME,
) -> DataFrame:
    """Daily means in degrees Celsius, in the column's own name."""
    celsius = convert_temperature(df, column, assume)
    return daily(celsius, {column: F.avg(column)}, cell=cell, time=time)


def heating(base: float, mean: Column) -> Column:
    """Sum of the daily shortfall below a base; days without a mean add nothing."""
    return F.coalesce(F.sum(F.when(mean < base, base - mean).otherwise(0.0)), F.lit(0.0))


def cooling(base: float, mean: Column) -> Column:
    """Sum of the daily excess above a base."""
    return F.coalesce(F.sum(F.when(mean > base, mean - base).otherwise(0.0)), F.lit(0.0))


def _accumulate(
    df: DataFrame, column: str, sums: dict[str, Column], freq: str | None, already_daily: bool,
    assume: str | None, cell, time: str,
) -> DataFrame:
    if freq is not None and freq not in _PERIODS:
        raise ValueError(f"unknown period {freq!r}; use one of {sorted(_PERIODS)}")
    if already_daily:
        days = convert_temperature(df, column, assume).withColumn("day", F.to_date(time))
    else:
        days = daily_mean_temperature(df, column, assume=assume, cell=cell, time=time)
    keys: list = cell_columns(days, cell)
    if freq is not None:
        keys = [*keys, _PERIODS[freq](F.col("day")).alias("period")]
    return days.groupBy(*keys).agg(*[value.alias(name) for name, value in sums.items()])


def heating_degree_days(
    df: DataFrame, column: str = "temperature_2m", base: float = HDD_BASE, *,
    freq: str | None = None, already_daily: bool = False, assume: str | None = None,
    cell=CELL, time: str = TIME,
) -> DataFrame:
    """``hdd`` per cell, or per cell and month or year with ``freq``."""
    sums = {"hdd": heating(base, F.col(column))}
    return _accumulate(df, column, sums, freq, already_daily, assume, cell, time)


def cooling_degree_days(
    df: DataFrame, column: str = "temperature_2m", base: float = CDD_BASE, *,
    freq: str | None = None, already_daily: bool = False, assume: str | None = None,
    cell=CELL, time: str = TIME,
) -> DataFrame:
    """``cdd`` per cell, or per cell and period."""
    sums = {"cdd": cooling(base, F.col(column))}
    return _accumulate(df, column, sums, freq, already_daily, assume, cell, time)


def degree_days(
    df: DataFrame, column: str = "temperature_2m", *, hdd_base: float = HDD_BASE,
    cdd_base: float = CDD_BASE, freq: str | None = None, assume: str | None = None,
    cell=CELL, time: str = TIME,
) -> DataFrame:
    """``hdd`` and ``cdd`` from one set of daily means."""
    sums = {"hdd": heating(hdd_base, F.col(column)), "cdd": cooling(cdd_base, F.col(column))}
    return _accumulate(df, column, sums, freq, False, assume, cell, time)


def exceedance_days(
    df: DataFrame, column: str, threshold: float, *, statistic: str = "max",
    below: bool = False, output: str = "exceedance_days", cell=CELL, time: str = TIME,
) -> DataFrame:
    """Days whose statistic reaches a threshold, or stays below it."""
    if statistic not in ("max", "min", "mean"):
        raise ValueError(f"unknown daily reduction {statistic!r}; use 'max', 'min' or 'mean'")
    days = daily(df, {"_stat": reduction(statistic, column)}, cell=cell, time=time)
    hit = F.col("_stat") < threshold if below else F.col("_stat") >= threshold
    return days.groupBy(*cell_columns(days, cell)).agg(F.count_if(hit).alias(output))


def hot_days(
    df: DataFrame, column: str = "temperature_2m", threshold: float = HOT_DAY_THRESHOLD, *,
    assume: str | None = None, cell=CELL, time: str = TIME,
) -> DataFrame:
    """Days whose maximum temperature reaches a threshold in degrees Celsius."""
    celsius = convert_temperature(df, column, assume)
    return exceedance_days(celsius, column, threshold, output="hot_days", cell=cell, time=time)


def storm_days(
    df: DataFrame, column: str = "wind_speed_10m",
    threshold: float = ALPINE_STORM_THRESHOLDS["severe_storm"], reduction: str = "any", *,
    cell=CELL, time: str = TIME,
) -> DataFrame:
    """Days on which any step (or the daily mean) of the mean wind reaches a threshold."""
    if reduction not in ("any", "daily_mean"):
        raise ValueError(f"unknown reduction {reduction!r}; use 'any' or 'daily_mean'")
    statistic = "max" if reduction == "any" else "mean"
    return exceedance_days(
        df, column, threshold, statistic=statistic, output="storm_days", cell=cell, time=time
    )
