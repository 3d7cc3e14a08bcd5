"""Annual and seasonal totals of precipitation and derived quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolia.fixed_values import CELL, HOURS_PER_YEAR, TIME
from aeolia.functions.basics import season
from aeolia.operators.timeline import cell_columns, step_hours

__all__ = ["annual_precipitation", "seasonal_totals"]


def annual_precipitation(
    df: DataFrame, column: str = "precipitation", *, timestep_hours: float | None = None,
    cell=CELL, time: str = TIME,
) -> DataFrame:
    """Record total scaled to a year by the length of the record in hours."""
    dt = step_hours(df, timestep_hours, time)
    total = F.coalesce(F.sum(column), F.lit(0.0))
    return df.groupBy(*cell_columns(df, cell)).agg(
        (total * (HOURS_PER_YEAR / (F.count("*") * dt))).alias("annual_precipitation")
    )


def seasonal_totals(df: DataFrame, *columns: str, cell=CELL, time: str = TIME) -> DataFrame:
    """Totals per calendar season; December counts to the same label whatever its year."""
    return df.groupBy(*cell_columns(df, cell), season(F.col(time)).alias("season")).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]
    )
