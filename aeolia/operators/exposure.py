"""Population on a model grid, and exposure to conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolia.fixed_values import CELL, TIME
from aeolia.functions.basics import cell_key
from aeolia.operators.axes import axis_of, bracket, with_edges
from aeolia.operators.timeline import step_hours

__all__ = [
    "NEAREST_WARNING", "aggregate_population_to_grid", "person_days", "population_totals",
    "population_weighted_mean",
]

NEAREST_WARNING = "nearest sampling moves people about; only for comparing with old results"


def _people(population: DataFrame, latitude: str, longitude: str, value: str) -> DataFrame:
    """One row per source cell; missing and NaN counts are nobody."""
    counted = F.when(F.isnan(value), 0.0).otherwise(F.coalesce(F.col(value), F.lit(0.0)))
    return population.groupBy(
        F.col(latitude).cast("double").alias("_lat"), F.col(longitude).cast("double").alias("_lon")
    ).agg(F.sum(counted).alias("_people"))


def _target_cells(target: DataFrame, latitude: str, longitude: str) -> DataFrame:
    return target.select(
        F.col(latitude).cast("double").alias("latitude"),
        F.col(longitude).cast("double").alias("longitude"),
    ).distinct()


def _containing(people: DataFrame, source: str, cells: DataFrame, target: str) -> DataFrame:
    """Source coordinate to the target centre whose cell holds it; the last cell is closed."""
    found = bracket(people, source, with_edges(axis_of(cells, target)), "low")
    inside = (F.col(source) < F.col("below.high")) | (
        F.col("below.is_last") & (F.col(source) == F.col("below.high"))
    )
    return found.filter(inside).select(source, F.col("below.knot").alias(target))


def _nearest(cells: DataFrame, target: str, people: DataFrame, source: str) -> DataFrame:
    """Target coordinate to the nearest source coordinate; none outside the source's span."""
    found = bracket(cells, target, axis_of(people, source), "knot")
    below, above = F.col("below.knot"), F.col("above.knot")
    share = F.try_divide(F.col(target) - below, above - below)
    nearest = F.when(F.col(target) == below, below).when(share <= 0.5, below).when(share > 0.5, above)
    return found.select(target, nearest.alias(source)).filter(F.col(source).isNotNull())


def aggregate_population_to_grid(
    population: DataFrame, target: DataFrame, method: str = "sum", *,
    value: str = "population", latitude: str = "latitude", longitude: str = "longitude",
) -> DataFrame:
    """Population counts ``(latitude, longitude, population)`` on the cells of a target table.

    ``sum`` gives every source cell in full to the target cell that holds its centre.
    ``nearest_normalised`` samples the nearest source cell and rescales to the total.
    Only the axes are looked up; the cells join them on equal coordinates, and Spark picks a
    broadcast only while an axis is below its size threshold.
    """
    people = _people(population, latitude, longitude, value)
    cells = _target_cells(target, latitude, longitude)
    if method == "sum":
        landed = (
            people.join(_containing(people, "_lat", cells, "latitude"), "_lat")
            .join(_containing(people, "_lon", cells, "longitude"), "_lon")
            .groupBy("latitude", "longitude").agg(F.sum("_people").alias("_people"))
        )
        counted = cells.join(landed, ["latitude", "longitude"], "left")
        return counted.select(
            "latitude", "longitude", F.coalesce("_people", F.lit(0.0)).alias("population")
        )
    if method == "nearest_normalised":
        sampled = (
            cells.join(_nearest(cells, "latitude", people, "_lat"), "latitude", "left")
            .join(_nearest(cells, "longitude", people, "_lon"), "longitude", "left")
            .join(people, ["_lat", "_lon"], "left")
            .select("latitude", "longitude", F.coalesce("_people", F.lit(0.0)).alias("population"))
        )
        source_total = people.agg(F.sum("_people")).scalar()
        sampled_total = sampled.agg(F.sum("population")).scalar()
        scale = F.when(sampled_total > 0, source_total / sampled_total).otherwise(1.0)
        return sampled.withColumn("population", F.col("population") * scale).withMetadata(
            "population", {"warning": NEAREST_WARNING}
        )
    raise ValueError(f"unknown method {method!r}; use 'sum' or 'nearest_normalised'")


def population_totals(
    population: DataFrame, regridded: DataFrame, *, value: str = "population"
) -> DataFrame:
    """Source and regridded totals side by side; they differ by what lies outside the grid."""
    def total(table: DataFrame, column: str, output: str) -> DataFrame:
        kept = F.when(~F.isnan(column), F.col(column))
        return table.agg(F.coalesce(F.sum(kept), F.lit(0.0)).alias(output))

    source = total(population, value, "source_total")
    return source.withColumn(
        "regridded_total", total(regridded, "population", "regridded_total").scalar()
    )


def _with_population(df: DataFrame, population: DataFrame, latitude: str, longitude: str) -> DataFrame:
    people = population.select(
        cell_key(F.col("latitude"), F.col("longitude")).alias("_cell"),
        F.col("population").alias("_people"),
    )
    return df.withColumn("_cell", cell_key(F.col(latitude), F.col(longitude))).join(people, "_cell")


def population_weighted_mean(
    df: DataFrame, column: str, population: DataFrame, *, by=("product", TIME),
    renormalise: bool = False, latitude: str = "latitude", longitude: str = "longitude",
) -> DataFrame:
    """Mean of a field weighted by the people in each cell, per product and time step.

    The weights are divided by all people, so missing values pull the mean down;
    ``renormalise`` divides by the people of the cells that have a value.
    """
    keys = [name for name in by if name in df.columns]
    joined = _with_population(df, population, latitude, longitude)
    weighted = F.coalesce(F.sum(F.col(column) * F.col("_people")), F.lit(0.0))
    if renormalise:
        total = F.sum(F.when(F.col(column).isNotNull(), F.col("_people")))
        value = F.try_divide(weighted, total)
    else:
        everyone = population.agg(F.sum("population")).scalar()
        value = weighted / F.when(everyone > 0, everyone).otherwise(
            F.raise_error(F.lit("the total population is zero; its mean is undefined")).cast("double")
        )
    return joined.groupBy(*keys).agg(value.alias(f"{column}_population_weighted"))


def person_days(
    df: DataFrame, condition: Column, population: DataFrame, *,
    hours_per_step: float | None = None, by=("product",), time: str = TIME,
    latitude: str = "latitude", longitude: str = "longitude",
) -> DataFrame:
    """People times days spent in a condition, summed over cells and steps.

    Steps are counted per cell first, so the join sees one row per cell.
    """
    dt = step_hours(df, hours_per_step, time)
    keys = [name for name in by if name in df.columns]
    cells = df.groupBy(*keys, latitude, longitude).agg(F.count_if(condition).alias("_steps"))
    exposed = _with_population(cells, population, latitude, longitude)
    total = F.coalesce(F.sum(F.col("_steps") * F.col("_people")), F.lit(0.0))
    return exposed.groupBy(*keys).agg((total * (dt / 24.0)).alias("person_days"))
