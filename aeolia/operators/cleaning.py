"""Duplicates, subsets, derived wind speed and quality control."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from aeolia.fixed_values import ALPINE_BOUNDS, BENJAMIN_BOUNDS, CELL, PHYSICAL_RANGES, TIME
from aeolia.functions.basics import holds, parse_time
from aeolia.functions.units import wind_speed_from_components
from aeolia.operators.naming import find_variable
from aeolia.operators.timeline import cell_columns

__all__ = [
    "ALPINE_DOMAIN", "BENJAMIN_DOMAIN", "BoundingBox", "apply_quality_control",
    "control_member", "derive_wind_speeds", "duplicate_times", "normalise_longitude",
    "quality_counts", "remove_duplicate_times", "require_rows", "subset_spatial",
    "subset_temporal",
]


@dataclass(frozen=True)
class BoundingBox:
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float
    name: str = "domain"

    def __post_init__(self):
        if self.lon_min >= self.lon_max or self.lat_min >= self.lat_max:
            raise ValueError(f"the lower bounds must be below the upper ones: {self}")
        if self.lat_min < -90 or self.lat_max > 90:
            raise ValueError(f"latitudes lie between -90 and 90: {self}")

    def contains(self, latitude: Column, longitude: Column) -> Column:
        return latitude.between(self.lat_min, self.lat_max) & longitude.between(
            self.lon_min, self.lon_max
        )


ALPINE_DOMAIN = BoundingBox(*ALPINE_BOUNDS, name="Alpine domain")
BENJAMIN_DOMAIN = BoundingBox(*BENJAMIN_BOUNDS, name="Storm Benjamin domain")


def remove_duplicate_times(
    df: DataFrame, order: str | Column = "ingest_seq", *, cell=CELL, time: str = TIME,
    copies: str | None = None,
) -> DataFrame:
    """Keep the first row, by ingest order, of each time stamp of a cell.

    ``copies`` names a column for how many rows a time stamp had.

    An aggregate and not a window: copies meet before the shuffle, so a time stamp with a
    third of all rows stays one row per task on the wire.
    """
    keys = [*cell_columns(df, cell), time]
    order_column = F.col(order) if isinstance(order, str) else order
    others = [name for name in df.columns if name not in keys]
    first = df.withColumn("_order", order_column).groupBy(*keys).agg(
        *[F.min_by(f"`{name}`", "_order").alias(name) for name in others],
        *([F.count("*").alias(copies)] if copies else []),
    )
    kept = first.select(*df.columns, *([copies] if copies else []))
    for name in others:
        if df.schema[name].metadata:
            kept = kept.withMetadata(name, df.schema[name].metadata)
    return kept


def duplicate_times(df: DataFrame, *, cell=CELL, time: str = TIME) -> DataFrame:
    """Per cell: how many repeated time stamps :func:`remove_duplicate_times` removes."""
    keys = cell_columns(df, cell)
    copies = df.groupBy(*keys, time).agg(F.count("*").alias("_copies"))
    return copies.groupBy(*keys).agg(
        F.sum(F.col("_copies") - 1).alias("duplicate_times_removed")
    )


def require_rows(subset: DataFrame, before: DataFrame, columns: list[str], what: str) -> DataFrame:
    """Raise if a subset is empty, naming what the data does span.  Runs a small Spark job."""
    if subset.isEmpty():
        span = before.agg(
            *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
        ).first()
        raise ValueError(f"{what} selects no data; the data spans {span.asDict()}")
    return subset


def subset_spatial(
    df: DataFrame, box: BoundingBox = ALPINE_DOMAIN, *, check: bool = False,
    latitude: str = "latitude", longitude: str = "longitude",
) -> DataFrame:
    """Rows inside a box, edges included.  ``check`` makes an empty result an error."""
    inside = df.filter(box.contains(F.col(latitude), F.col(longitude)))
    return require_rows(inside, df, [latitude, longitude], box.name) if check else inside


def time_filter(start, end, time: Column) -> Column | None:
    """Both ends included; an end without a clock time covers its whole day."""
    bounds = []
    if start is not None:
        bounds.append(time >= F.lit(parse_time(start)[0]).cast("timestamp_ntz"))
    if end is not None:
        stamp, whole_day = parse_time(end)
        if whole_day:
            bounds.append(time < F.lit(stamp + timedelta(days=1)).cast("timestamp_ntz"))
        else:
            bounds.append(time <= F.lit(stamp).cast("timestamp_ntz"))
    if len(bounds) == 2:
        return bounds[0] & bounds[1]
    return bounds[0] if bounds else None


def subset_temporal(
    df: DataFrame, start=None, end=None, *, check: bool = False, time: str = TIME
) -> DataFrame:
    """Rows of a time range; either end may be open."""
    if start is not None and end is not None and parse_time(start)[0] > parse_time(end)[0]:
        raise ValueError(f"the range starts after it ends: {start} to {end}")
    condition = time_filter(start, end, F.col(time))
    if condition is None:
        return df
    inside = df.filter(condition)
    return require_rows(inside, df, [time], f"{start} to {end}") if check else inside


def normalise_longitude(
    df: DataFrame, to_180: bool = True, *, longitude: str = "longitude"
) -> DataFrame:
    """Longitudes in -180..180 or 0..360.

    A record that lies in the range already stays as it is; otherwise the whole axis is
    converted, so that 180 in a 0..360 record becomes -180.
    """
    lon = F.col(longitude)
    if to_180:
        beyond = df.agg(F.max(lon)).scalar() > 180
        value = F.when(beyond, F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).otherwise(lon)
    else:
        below = df.agg(F.min(lon)).scalar() < 0
        value = F.when(below, F.pmod(lon, F.lit(360.0))).otherwise(lon)
    return df.withColumn(longitude, value)


def control_member(df: DataFrame, member: str = "number", by=("product",)) -> DataFrame:
    """The control member 0 where a product has it, else its first (lowest) member."""
    if member not in df.columns:
        return df
    keys = [name for name in by if name in df.columns]
    chosen = df.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col(member) == 0, 0)), F.min(member)).alias("_member")
    )
    if not keys:
        return df.filter(F.col(member) == chosen.scalar())
    # A row for each product: joined by product, all rows of one would meet in a task.
    return df.join(F.broadcast(chosen), keys).filter(F.col(member) == F.col("_member")).drop("_member")


def derive_wind_speeds(
    df: DataFrame, heights=("10m", "100m"), overwrite: bool = False
) -> DataFrame:
    """Add scalar wind speed per height; a speed that the product has itself stays."""
    result = df
    for height in heights:
        speed = f"wind_speed_{height}"
        if find_variable(result, speed) is not None and not overwrite:
            continue
        u, v = (find_variable(result, f"{axis}_wind_{height}") for axis in "uv")
        if u is not None and v is not None:
            result = result.withColumn(
                speed, wind_speed_from_components(F.col(u), F.col(v))
            ).withMetadata(speed, {"units": "m/s", "long_name": f"{height} wind speed"})
    return result


def _checked(df: DataFrame, ranges: dict) -> dict[str, tuple[str, Column]]:
    """canonical -> (column, is the value out of range)"""
    found = {}
    for canonical, (low, high) in ranges.items():
        name = find_variable(df, canonical)
        if name is not None:
            found[canonical] = (name, holds((F.col(name) < low) | (F.col(name) > high)))
    return found


def apply_quality_control(
    df: DataFrame, ranges: dict = PHYSICAL_RANGES, action: str = "mask",
    observation: Observation | None = None, more: dict[str, Column] | None = None,
) -> DataFrame:
    """Turn values outside their plausible range into NULL, or only count them.

    The counts per variable come out of ``observation`` when the plan runs, without a job of
    their own; ``more`` adds aggregates of the same rows to it.
    """
    if action not in ("mask", "report"):
        raise ValueError(f"unknown action {action!r}; use 'mask' or 'report'")
    checks = _checked(df, ranges)
    result = df
    if observation is not None and (checks or more):
        counts = {**(more or {}), **{c: F.count_if(bad) for c, (_, bad) in checks.items()}}
        result = result.observe(observation, *[value.alias(name) for name, value in counts.items()])
    if action == "mask" and checks:
        masked = result.withColumns(
            {name: F.when(~bad, F.col(name)) for name, bad in checks.values()}
        )
        for name, _ in checks.values():
            if df.schema[name].metadata:
                masked = masked.withMetadata(name, df.schema[name].metadata)
        return masked
    return result


def quality_counts(df: DataFrame, ranges: dict = PHYSICAL_RANGES, by=("product",)) -> DataFrame:
    """Out-of-range values as ``(product, variable, offending)`` rows, zeros included."""
    checks = _checked(df, ranges)
    keys = [name for name in by if name in df.columns]
    wide = df.groupBy(*keys).agg(*[F.count_if(bad).alias(c) for c, (_, bad) in checks.items()])
    return wide.unpivot(keys, list(checks), "variable", "offending")
