"""Hydropower screening: snow and rain, runoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeolia.fixed_values import RUNOFF_COEFFICIENT, SNOW_RAIN_TRANSITION
from aeolia.functions.basics import clamp

__all__ = ["runoff_from_precipitation", "snow_fraction", "snow_rain_partition"]


def snow_fraction(temperature: Column, transition=SNOW_RAIN_TRANSITION) -> Column:
    """1 at or below the lower bound, 0 at or above the upper, linear between."""
    low, high = transition
    if low > high:
        raise ValueError(f"the transition must rise from snow to rain: {transition}")
    if low == high:
        # A missing temperature compares false, so it counts as rain.
        return F.when(temperature <= low, 1.0).otherwise(0.0)
    return clamp((high - temperature) / (high - low), 0.0, 1.0)


def snow_rain_partition(
    precipitation: Column, temperature: Column, transition=SNOW_RAIN_TRANSITION
) -> dict[str, Column]:
    """Snowfall, rainfall and snow fraction, for ``DataFrame.withColumns``."""
    fraction = snow_fraction(temperature, transition)
    snow = precipitation * fraction
    return {"snowfall": snow, "rainfall": precipitation - snow, "snow_fraction": fraction}


def runoff_from_precipitation(
    precipitation: Column, coefficient: float = RUNOFF_COEFFICIENT
) -> Column:
    if not 0.0 <= coefficient <= 1.0:
        raise ValueError(f"the runoff coefficient is a share between 0 and 1: {coefficient}")
    return precipitation * coefficient
