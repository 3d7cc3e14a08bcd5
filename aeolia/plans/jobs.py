"""The study's jobs, each one plan over standardised tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.fixed_values import CDD_BASE, CELL, HDD_BASE, HOT_DAY_THRESHOLD, TIME
from aeolia.functions.units import wind_speed_from_components
from aeolia.functions.wind import extrapolate_to_hub_height
from aeolia.operators.cleaning import BoundingBox, control_member
from aeolia.operators.daily import cooling, daily, heating
from aeolia.operators.storms import forecast_maxima
from aeolia.operators.timeline import cell_columns
from aeolia.operators.verification import elevation_band_metrics, station_metrics
from aeolia.plans.standardise import open_product_observed
from aeolia.sources.tables import combine, read_paired_stations, write_bucketed, write_product

__all__ = [
    "ProductSource", "reanalysis_comparison", "standardise_all", "station_verification",
    "storm_case_study", "winter_projection",
]

# Definitions of the study's comparisons.
COMPARISON_STORM_DAY_THRESHOLD = 17.5
PROJECTION_STORM_HOUR_THRESHOLD = 15.0


def reanalysis_comparison(
    df: DataFrame, *, hot_day_threshold: float = HOT_DAY_THRESHOLD, cdd_base: float = CDD_BASE,
    storm_threshold: float = COMPARISON_STORM_DAY_THRESHOLD, temperature: str = "temperature_2m",
    wind: str = "wind_speed_10m", cell=CELL, time: str = TIME,
) -> DataFrame:
    """Hot days, cooling degree days and storm days per cell of any number of products.

    One daily table serves all three.
    """
    days = daily(
        df,
        {"t_max": F.max(temperature), "t_mean": F.avg(temperature), "u_max": F.max(wind)},
        cell=cell, time=time,
    )
    return days.groupBy(*cell_columns(days, cell)).agg(
        F.count_if(F.col("t_max") >= hot_day_threshold).alias("hot_days"),
        cooling(cdd_base, F.col("t_mean")).alias("cdd"),
        F.count_if(F.col("u_max") >= storm_threshold).alias("storm_days"),
    )


def storm_case_study(*forecasts: DataFrame, cell=CELL) -> DataFrame:
    """Largest gust and wind per cell of several forecast products.

    Each keeps its control member; a product without a gust field gets NULL gusts.
    """
    runs = []
    for forecast in forecasts:
        run = control_member(forecast)
        if "wind_speed_10m" not in run.columns:
            run = run.withColumn(
                "wind_speed_10m",
                wind_speed_from_components(F.col("u_wind_10m"), F.col("v_wind_10m")),
            )
        kept = [*cell_columns(run, cell), "wind_speed_10m", "wind_gust_10m"]
        runs.append(run.select(*[name for name in kept if name in run.columns]))
    return forecast_maxima(combine(*runs), cell=cell)


def winter_projection(
    df: DataFrame, *, hdd_base: float = HDD_BASE,
    storm_threshold: float = PROJECTION_STORM_HOUR_THRESHOLD, timestep_hours: float = 1.0,
    temperature: str = "temperature_2m", cell=CELL, time: str = TIME,
) -> DataFrame:
    """Heating degree days and hours of strong wind at 100 m per cell.

    The native 100 m wind is used where a row has one, else the 10 m wind is carried up;
    ``hub_wind_source`` says whether a cell has any native value.  Hours are counted per day,
    so both share one shuffle.
    """
    native = F.col("wind_speed_100m") if "wind_speed_100m" in df.columns else F.lit(None).cast("double")
    hub = native
    if "wind_speed_10m" in df.columns:
        hub = F.coalesce(native, extrapolate_to_hub_height(F.col("wind_speed_10m")))
    days = daily(
        df,
        {
            "t_mean": F.avg(temperature), "strong": F.count_if(hub >= storm_threshold),
            "has_native": F.bool_or(native.isNotNull()),
        },
        cell=cell, time=time,
    )
    return days.groupBy(*cell_columns(days, cell)).agg(
        heating(hdd_base, F.col("t_mean")).alias("hdd"),
        (F.sum("strong") * timestep_hours).alias("storm_hours"),
        F.when(F.bool_or("has_native"), "native").otherwise("extrapolated").alias("hub_wind_source"),
    )


def station_verification(
    merged: DataFrame, metadata: DataFrame, variables: dict[str, tuple[str, str]], *,
    metadata_id: str = "synnr", minimum_pairs: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Metrics per station and per elevation band, for all variables in one pass."""
    stacked = read_paired_stations(merged, variables)
    per_station = station_metrics(
        stacked, by=("variable",), minimum_pairs=minimum_pairs, metadata=metadata,
        metadata_id=metadata_id,
    )
    return per_station, elevation_band_metrics(per_station, by=("variable",))


@dataclass(frozen=True)
class ProductSource:
    """Where one product of a batch is, and how to read it."""

    product: str
    paths: tuple[str, ...]
    format: str = "parquet"
    choices: dict = field(default_factory=dict)


def standardise_all(
    spark: SparkSession, sources: list[ProductSource], output: str, *,
    domain: BoundingBox | None = None, start=None, end=None, table: str | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Standardise and write every product, one job each; returns their provenance rows.

    All products go into one place, parted by product and year, of which a job replaces its
    own parts only: a second batch renews its products and leaves the others.  With ``table`` that
    place is a table of this name with ``buckets`` of cells, which operators along time read without
    a shuffle.  The rows and faults that the provenance names are counted by the writing job.
    """
    notes = []
    for source in sources:
        made = open_product_observed(
            spark, list(source.paths), source.product, format=source.format, domain=domain,
            start=start, end=end, **source.choices,
        )
        rows = made.table.drop("ingest_seq")
        if table is None:
            write_product(rows, output, mode="overwrite")
        else:
            write_bucketed(rows, table, output, buckets=buckets)
        notes.append(made.provenance(source.product))
    return combine(*notes)
