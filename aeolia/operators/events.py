"""Dunkelflaute episodes and compound events.

Each detector returns two lazy tables: ``mask``, the rows with their conditions, and
``stats``, the event statistics per cell.  ``stats`` does not depend on ``mask``; it
shuffles only the rows where the condition holds.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolia.fixed_values import (
    CELL,
    COLD_DUNKELFLAUTE_TEMPERATURE,
    DUNKELFLAUTE_MIN_HOURS,
    DUNKELFLAUTE_SOLAR_CF,
    DUNKELFLAUTE_WIND_CF,
    FOEHN_WARMING,
    FOEHN_WIND,
    HEAT_DROUGHT_PRECIPITATION,
    HEAT_DROUGHT_TEMPERATURE,
    HELLSTURM_SOLAR,
    HELLSTURM_WIND,
    RAIN_ON_SNOW_MIN_DEPTH,
    RAIN_ON_SNOW_PRECIPITATION,
    RAIN_ON_SNOW_RANGE,
    RAW_SOLAR_THRESHOLD,
    RAW_WIND_THRESHOLD,
    TIME,
)
from aeolia.functions.basics import holds
from aeolia.operators.daily import daily
from aeolia.operators.runs import (
    event_statistics, min_steps, run_totals, statistic_columns, sustained, sustained_rows,
)
from aeolia.operators.storms import ramp_magnitude
from aeolia.operators.timeline import BLOCK_HOURS, cell_columns, step_hours

__all__ = [
    "Events", "combine_conditions", "detect", "detect_from_raw", "domain_mean", "foehn_like",
    "heat_drought", "hellsturm", "rain_on_snow", "sensitivity_sweep",
]


class Events(NamedTuple):
    mask: DataFrame
    stats: DataFrame


def _episodes(
    df: DataFrame, shortfall: Column, temperature: str | None, cold_threshold: float,
    min_duration_hours: float, timestep_hours: float | None, cell, time: str,
    block_hours: float,
) -> Events:
    dt = step_hours(df, timestep_hours, time)
    keys = cell_columns(df, cell)
    place = {"cell": cell, "time": time, "block_hours": block_hours}

    mask = sustained(
        df.withColumn("shortfall", holds(shortfall)), F.col("shortfall"), "dunkelflaute",
        min_duration_hours, timestep_hours=dt, **place,
    )
    if temperature is None:
        stats = event_statistics(
            df, shortfall, min_duration_hours=min_duration_hours, timestep_hours=dt, **place
        )
        return Events(mask, stats)

    # Cold is asked of the episode's steps, so a cold spell may be shorter than an episode.
    cold = holds(F.col(temperature) < cold_threshold)
    mask = mask.withColumn("cold_dunkelflaute", F.col("dunkelflaute") & cold)
    # The steps of episodes are found once; all of them, and the cold ones, are runs of two kinds.
    inside = sustained_rows(df, shortfall, min_duration_hours, timestep_hours=dt, **place)
    kinds = F.explode(F.array_compact(F.array(F.lit("all"), F.when(cold, "cold")))).alias("_kind")
    totals = run_totals(
        inside.select(*keys, time, kinds), F.lit(True), timestep_hours=dt, cell=(*keys, "_kind"),
        time=time, block_hours=block_hours,
    )
    wide = totals.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_kind") == kind, F.col(name))).alias(f"{kind}_{name}")
        for kind in ("all", "cold") for name in ("runs", "steps", "longest")
    ])
    record = df.groupBy(*keys).agg(F.count("*").alias("record_steps"))
    joined = record.join(wide, keys, "left") if keys else record.join(wide, how="left")
    stats = joined.select(
        *keys, *statistic_columns("all_runs", "all_steps", "all_longest", dt),
        *statistic_columns("cold_runs", "cold_steps", "cold_longest", dt, "cold_"),
    )
    return Events(mask, stats)


def detect(
    df: DataFrame, wind_cf: str = "wind_capacity_factor", solar_cf: str = "solar_capacity_factor",
    temperature: str | None = None, *, wind_threshold: float = DUNKELFLAUTE_WIND_CF,
    solar_threshold: float = DUNKELFLAUTE_SOLAR_CF,
    cold_threshold: float = COLD_DUNKELFLAUTE_TEMPERATURE,
    min_duration_hours: float = DUNKELFLAUTE_MIN_HOURS, timestep_hours: float | None = None,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> Events:
    """Dunkelflaute by capacity factors: both low, without a break, for long enough."""
    low = (F.col(wind_cf) < wind_threshold) & (F.col(solar_cf) < solar_threshold)
    return _episodes(
        df, low, temperature, cold_threshold, min_duration_hours, timestep_hours, cell, time,
        block_hours,
    )


def detect_from_raw(
    df: DataFrame, wind: str = "wind_speed_10m", irradiance: str = "solar_radiation",
    temperature: str | None = None, *, wind_threshold: float = RAW_WIND_THRESHOLD,
    solar_threshold: float = RAW_SOLAR_THRESHOLD, **options,
) -> Events:
    """Dunkelflaute by wind speed and irradiance; options as for :func:`detect`."""
    return detect(
        df, wind, irradiance, temperature, wind_threshold=wind_threshold,
        solar_threshold=solar_threshold, **options,
    )


def sensitivity_sweep(
    df: DataFrame, wind: str, solar: str, wind_thresholds: list[float], durations: list[float], *,
    solar_threshold: float, timestep_hours: float | None = None, by=("product",),
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Events and hours for every wind threshold and minimum duration.

    Durations cost nothing extra: the runs are found once per threshold and counted by
    length.  A row is copied once per threshold it lies under, and rows above the loosest
    threshold are dropped at the scan.
    """
    dt = step_hours(df, timestep_hours, time)
    keys = cell_columns(df, cell)
    lengths = {hours: max(1, min_steps(hours, dt)) for hours in durations}
    low = df.filter((F.col(wind) < max(wind_thresholds)) & (F.col(solar) < solar_threshold))
    met = F.filter(
        F.array(*[F.lit(float(t)) for t in wind_thresholds]), lambda t: F.col(wind) < t
    )
    copies = low.select(*keys, time, F.explode(met).alias("wind_threshold"))
    totals = run_totals(
        copies, F.lit(True), sorted(set(lengths.values())), timestep_hours=dt,
        cell=(*keys, "wind_threshold"), time=time, block_hours=block_hours,
    )
    groups = [name for name in by if name in keys]
    per_duration = F.explode(
        F.array(*[
            F.struct(
                F.lit(float(hours)).alias("min_duration_hours"),
                F.col(f"runs_{n}").alias("events"), (F.col(f"steps_{n}") * dt).alias("hours"),
            )
            for hours, n in lengths.items()
        ])
    )
    found = (
        totals.select(*groups, "wind_threshold", per_duration.alias("d"))
        .groupBy(*groups, "wind_threshold", "d.min_duration_hours")
        .agg(F.sum("d.events").alias("events"), F.sum("d.hours").alias("hours"))
    )
    # Every combination has a row; one that no step lies under has no events.
    every = df.select(*groups).distinct() if groups else df.sparkSession.range(1).drop("id")
    for name, values in (("wind_threshold", wind_thresholds), ("min_duration_hours", durations)):
        every = every.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return every.join(found, [*groups, "wind_threshold", "min_duration_hours"], "left").fillna(
        0, ["events", "hours"]
    )


def domain_mean(df: DataFrame, *columns: str, time: str = TIME) -> DataFrame:
    """Unweighted mean over all cells per product and time step, before any threshold."""
    keys = [name for name in ("product",) if name in df.columns]
    means = df.groupBy(*keys, time).agg(*[F.avg(c).alias(c) for c in columns])
    return means if keys else means.withColumn("product", F.lit("domain"))


def _scope(df: DataFrame, aggregate: bool, columns: list[str], cell, time: str):
    """The rows and cell key to detect on: each cell, or the domain mean."""
    return (domain_mean(df, *columns, time=time), ("product",)) if aggregate else (df, cell)


def combine_conditions(
    df: DataFrame, name: str, conditions: dict[str, Column], *,
    min_duration_hours: float | None = None, timestep_hours: float | None = None,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
    record: DataFrame | None = None,
) -> Events:
    """All conditions at once, optionally sustained; every component stays in the mask."""
    if not conditions:
        raise ValueError("at least one condition is needed")
    dt = step_hours(df, timestep_hours, time)
    place = {"timestep_hours": dt, "cell": cell, "time": time, "block_hours": block_hours}
    both = reduce(lambda left, right: left & right, conditions.values())
    flagged = df.withColumns({key: holds(value) for key, value in conditions.items()})
    together = reduce(lambda left, right: left & right, [F.col(key) for key in conditions])
    if min_duration_hours is None:
        mask = flagged.withColumn(name, together)
    else:
        mask = sustained(flagged, together, name, min_duration_hours, **place)
    stats = event_statistics(
        df, both, min_duration_hours=min_duration_hours, record=record, **place
    )
    return Events(mask, stats)


def hellsturm(
    df: DataFrame, wind: str = "wind_speed_10m", irradiance: str = "solar_radiation", *,
    wind_threshold: float = HELLSTURM_WIND, solar_threshold: float = HELLSTURM_SOLAR,
    aggregate: bool = False, cell=CELL, time: str = TIME, **options,
) -> Events:
    """Strong wind and strong sun at once."""
    rows, scope = _scope(df, aggregate, [wind, irradiance], cell, time)
    conditions = {
        "high_wind": F.col(wind) > wind_threshold,
        "high_solar": F.col(irradiance) > solar_threshold,
    }
    return combine_conditions(rows, "hellsturm", conditions, cell=scope, time=time, **options)


def heat_drought(
    df: DataFrame, temperature: str = "temperature_2m", precipitation: str = "precipitation", *,
    temperature_threshold: float = HEAT_DROUGHT_TEMPERATURE,
    precipitation_threshold: float = HEAT_DROUGHT_PRECIPITATION,
    min_duration_days: float | None = None, aggregate: bool = False,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> Events:
    """Hot, dry days: daily mean temperature and daily precipitation total.

    Days without rows end a spell and count to the record, as an empty day would.
    """
    rows, scope = _scope(df, aggregate, [temperature, precipitation], cell, time)
    days = daily(
        rows,
        {
            temperature: F.avg(temperature),
            precipitation: F.coalesce(F.sum(precipitation), F.lit(0.0)),
        },
        cell=scope, time=time,
    ).withColumn("day", F.col("day").cast("timestamp_ntz"))
    record = days.groupBy(*cell_columns(days, scope)).agg(
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("record_steps")
    )
    conditions = {
        "hot": F.col(temperature) > temperature_threshold,
        "dry": F.col(precipitation) < precipitation_threshold,
    }
    return combine_conditions(
        days, "heat_drought", conditions, timestep_hours=24.0, cell=scope, time="day",
        min_duration_hours=None if min_duration_days is None else 24 * min_duration_days,
        block_hours=max(block_hours, 24.0), record=record,
    )


def rain_on_snow(
    df: DataFrame, temperature: str = "temperature_2m", precipitation: str = "precipitation",
    snow_depth: str | None = None, *, temperature_range=RAIN_ON_SNOW_RANGE,
    precipitation_threshold: float = RAIN_ON_SNOW_PRECIPITATION,
    min_snow_depth_m: float = RAIN_ON_SNOW_MIN_DEPTH, aggregate: bool = False,
    cell=CELL, time: str = TIME, **options,
) -> Events:
    """Rain a little above freezing, on a snowpack where a depth is given.

    Both ends of the temperature range are left out.
    """
    low, high = temperature_range
    columns = [temperature, precipitation, *([snow_depth] if snow_depth else [])]
    rows, scope = _scope(df, aggregate, columns, cell, time)
    conditions = {
        "above_freezing": F.col(temperature) > low,
        "near_freezing": F.col(temperature) < high,
        "wet": F.col(precipitation) > precipitation_threshold,
    }
    if snow_depth is not None:
        conditions["snow_present"] = F.col(snow_depth) >= min_snow_depth_m
    return combine_conditions(rows, "rain_on_snow", conditions, cell=scope, time=time, **options)


def foehn_like(
    df: DataFrame, temperature: str = "temperature_2m", wind: str = "wind_speed_10m", *,
    wind_threshold: float = FOEHN_WIND, warming_threshold: float = FOEHN_WARMING,
    window_hours: float = 3.0, aggregate: bool = False, timestep_hours: float | None = None,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> Events:
    """Strong wind with quick warming: a screening, no proof of a foehn."""
    rows, scope = _scope(df, aggregate, [temperature, wind], cell, time)
    dt = step_hours(rows, timestep_hours, time)
    warmed = ramp_magnitude(
        rows, temperature, window_hours, timestep_hours=dt, output="warming",
        cell=scope, time=time, block_hours=block_hours,
    )
    conditions = {
        "strong_wind": F.col(wind) > wind_threshold,
        "rapid_warming": F.col("warming") > warming_threshold,
    }
    keys = cell_columns(rows, scope)
    # Counted on the rows before the shift, which the record does not need.
    record = rows.groupBy(*keys).agg(F.count("*").alias("record_steps"))
    return combine_conditions(
        warmed, "foehn_like", conditions, timestep_hours=dt, cell=scope, time=time,
        block_hours=block_hours, record=record,
    )
