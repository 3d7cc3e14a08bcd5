"""Verification metrics as aggregate expressions over model and observation columns.

All of them are algebraic aggregates, so Spark combines them before the shuffle and one
station with a third of all pairs costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "bias", "correlation", "kling_gupta_efficiency", "mean_absolute_error",
    "root_mean_square_error", "standard_deviation_ratio", "valid_pair", "verification_metrics",
]


def valid_pair(observed: Column, modelled: Column) -> Column:
    """Both sides present and finite."""
    return F.coalesce(
        (F.abs(observed) < float("inf")) & (F.abs(modelled) < float("inf")), F.lit(False)
    )


def bias(observed: Column, modelled: Column) -> Column:
    return F.avg(modelled - observed)


def root_mean_square_error(observed: Column, modelled: Column) -> Column:
    error = modelled - observed
    return F.sqrt(F.avg(error * error))


def mean_absolute_error(observed: Column, modelled: Column) -> Column:
    return F.avg(F.abs(modelled - observed))


def _spread_known(*columns: Column) -> Column:
    enough = F.count("*") >= 2
    for column in columns:
        enough = enough & (F.stddev_pop(column) > 0)
    return enough


def correlation(observed: Column, modelled: Column) -> Column:
    """Pearson; missing for fewer than two pairs or a constant side."""
    spread = F.stddev_pop(observed) * F.stddev_pop(modelled)
    return F.when(
        _spread_known(observed, modelled),
        F.try_divide(F.covar_pop(observed, modelled), spread),
    )


def standard_deviation_ratio(observed: Column, modelled: Column) -> Column:
    return F.when(
        _spread_known(observed), F.try_divide(F.stddev_pop(modelled), F.stddev_pop(observed))
    )


def kling_gupta_efficiency(observed: Column, modelled: Column) -> Column:
    """``1 - sqrt((r-1)^2 + (alpha-1)^2 + (beta-1)^2)``; missing where r or beta is."""
    r = correlation(observed, modelled)
    alpha = standard_deviation_ratio(observed, modelled)
    beta = F.try_divide(F.avg(modelled), F.avg(observed))
    return 1.0 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))


def verification_metrics(observed: Column, modelled: Column) -> list[Column]:
    """The standard set in reporting order, for ``agg`` over valid pairs."""
    return [
        F.count("*").cast("double").alias("n_pairs"),
        bias(observed, modelled).alias("bias"),
        root_mean_square_error(observed, modelled).alias("rmse"),
        mean_absolute_error(observed, modelled).alias("mae"),
        correlation(observed, modelled).alias("correlation"),
        F.avg(observed).alias("obs_mean"),
        F.avg(modelled).alias("model_mean"),
        F.stddev_pop(observed).alias("obs_std"),
        F.stddev_pop(modelled).alias("model_std"),
        standard_deviation_ratio(observed, modelled).alias("std_ratio"),
    ]
