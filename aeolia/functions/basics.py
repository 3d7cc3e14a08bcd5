"""Small column helpers shared by all operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeolia.fixed_values import COORDINATE_ALIASES

__all__ = [
    "cell_key", "clamp", "epoch_seconds", "holds", "nan_to_null", "season", "time_from_epoch",
]

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970 of a zone-free time stamp, whatever the session zone."""
    return (time.cast("timestamp_ntz") - F.expr(_EPOCH)).cast("interval second").cast("bigint")


def time_from_epoch(seconds: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds)


def holds(condition: Column) -> Column:
    """A condition that is false, not missing, where an input is missing."""
    return F.coalesce(condition, F.lit(False))


def clamp(value: Column, low: float, high: float) -> Column:
    """Clip to a range, keeping missing values (``greatest``/``least`` skip NULL)."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; Spark sorts NaN above all numbers.

    Coordinates stay as they are, so that bounds on them reach the scan; NaN lies in no box.
    """
    axes = {*COORDINATE_ALIASES["latitude"], *COORDINATE_ALIASES["longitude"]}
    floats = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in axes
    ]
    return df.withColumns(
        {
            name: F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`")).cast("double")
            for name in floats
        }
    )


def cell_key(latitude: Column, longitude: Column) -> Column:
    """One BIGINT per grid point, from coordinates rounded to a millionth of a degree.

    Coordinates are doubles and may differ in the last bit between tables, so joins use
    this key instead.
    """
    lat = F.round((latitude + 90.0) * 1e6).cast("bigint")
    lon = F.round((longitude + 180.0) * 1e6).cast("bigint")
    return lat * F.lit(1_000_000_000).cast("bigint") + lon


def season(time: Column) -> Column:
    """Meteorological season of the calendar month."""
    month = F.month(time)
    return (
        F.when(month.isin(12, 1, 2), "DJF")
        .when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(6, 7, 8), "JJA")
        .otherwise("SON")
    )


def parse_time(text: str | datetime) -> tuple[datetime, bool]:
    """A time bound and whether it names a whole day."""
    if isinstance(text, datetime):
        return text, False
    stamp = text.strip()
    return datetime.fromisoformat(stamp), len(stamp) == 10
