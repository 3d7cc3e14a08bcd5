"""Gridded fields against stations: matching, extraction, metrics by station and height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.fixed_values import (
    ELEVATION_BANDS,
    ENVIRONMENTAL_LAPSE_RATE,
    KM_PER_DEGREE,
    METRIC_NAMES,
    TIME,
)
from aeolia.functions.basics import cell_key
from aeolia.functions.metrics import valid_pair, verification_metrics
from aeolia.operators.axes import axis_of, bracket

__all__ = [
    "elevation_band_metrics", "extract_at_stations", "lapse_rate_adjustment",
    "match_stations_to_grid", "pair_with_observations", "station_exclusions", "station_metadata",
    "station_metrics",
]


def _nearest_on_axis(
    stations: DataFrame, column: str, grid: DataFrame, axis: str, descending: bool, prefix: str
) -> DataFrame:
    """Station coordinate to the nearest grid coordinate and its index along the axis.

    On a tie the first index wins: the lower value of an ascending axis, the higher one of a
    descending axis.  Off the grid the edge is nearest.
    """
    axis_table = axis_of(grid, axis)
    if descending:
        last = axis_table.agg(F.max("index")).scalar()
        axis_table = axis_table.withColumn("index", last - F.col("index"))
    found = bracket(stations, column, axis_table, "knot")
    to_below = F.abs(F.col("below.knot") - F.col(column))
    to_above = F.abs(F.col("above.knot") - F.col(column))
    first = to_above <= to_below if descending else to_above < to_below
    take_above = F.col("below").isNull() | (F.col("above").isNotNull() & first)
    chosen = F.when(take_above, F.col("above")).otherwise(F.col("below"))
    return found.select(
        column, chosen["index"].alias(f"{prefix}_index"), chosen["knot"].alias(f"grid_{prefix}")
    )


def match_stations_to_grid(
    grid: DataFrame, stations: DataFrame, *, lat_column: str = "lat", lon_column: str = "lon",
    elevation_column: str | None = "alt", elevation_variable: str | None = None,
    latitude: str = "latitude", longitude: str = "longitude",
    lat_descending: bool = False, lon_descending: bool = False,
) -> DataFrame:
    """Add the nearest grid point to each station, each axis on its own.

    A station without a position stays, with no grid point.

    ``grid`` needs one row per grid cell; pass the static cell table rather than the facts.
    With a model orography column, its height there and the height difference are added.
    """
    for name in (lat_column, lon_column):
        if name not in stations.columns:
            raise ValueError(f"the station table has no {name!r}: {stations.columns}")
    placed = stations.withColumns(
        {lat_column: F.col(lat_column).cast("double"), lon_column: F.col(lon_column).cast("double")}
    )
    matched = placed.join(
        _nearest_on_axis(placed, lat_column, grid, latitude, lat_descending, "lat"), lat_column, "left"
    ).join(
        _nearest_on_axis(placed, lon_column, grid, longitude, lon_descending, "lon"), lon_column, "left"
    )
    lat, lon = F.col(lat_column), F.col(lon_column)
    dy = (F.col("grid_lat") - lat) * KM_PER_DEGREE
    dx = (F.col("grid_lon") - lon) * KM_PER_DEGREE * F.cos(F.radians((lat + F.col("grid_lat")) * 0.5))
    added = ["lat_index", "lon_index", "grid_lat", "grid_lon", "distance_km"]
    matched = matched.withColumn("distance_km", F.sqrt(dx * dx + dy * dy))
    if elevation_variable is not None and elevation_column is not None:
        if elevation_column not in stations.columns:
            raise ValueError(f"the station table has no {elevation_column!r}: {stations.columns}")
        heights = grid.groupBy(
            cell_key(F.col(latitude), F.col(longitude)).alias("_cell")
        ).agg(F.max(elevation_variable).alias("grid_elevation"))
        matched = (
            matched.withColumn("_cell", cell_key(F.col("grid_lat"), F.col("grid_lon")))
            .join(heights, "_cell", "left").drop("_cell")
            .withColumn("elevation_difference", F.col("grid_elevation") - F.col(elevation_column))
        )
        added += ["grid_elevation", "elevation_difference"]
    return matched.select(*stations.columns, *added)


def extract_at_stations(
    df: DataFrame, column: str, matched: DataFrame, *, station_id: str = "synnr",
    time: str = TIME, latitude: str = "latitude", longitude: str = "longitude",
) -> DataFrame:
    """``(station_id, time, value)`` of a field at the matched grid points.

    The station side is joined by cell key.  Spark broadcasts it while it is below its size
    threshold and shuffles beyond, where adaptive execution splits a hot cell.
    """
    missing = {"grid_lat", "grid_lon", station_id} - set(matched.columns)
    if missing:
        raise ValueError(f"{sorted(missing)} missing; match the stations to the grid first")
    sites = matched.select(
        F.col(station_id).alias("station_id"),
        cell_key(F.col("grid_lat"), F.col("grid_lon")).alias("_cell"),
    )
    return (
        df.select(
            cell_key(F.col(latitude), F.col(longitude)).alias("_cell"),
            F.col(time).alias("time"), F.col(column).alias("value"),
        )
        .join(sites, "_cell")
        .select("station_id", "time", "value")
    )


def pair_with_observations(
    modelled: DataFrame, observed: DataFrame, *, station_id: str = "station_id", time: str = TIME
) -> DataFrame:
    """Model values and observations of the same station and time, as ``modelled``, ``observed``."""
    left = modelled.select(station_id, time, F.col("value").alias("modelled"))
    right = observed.select(station_id, time, F.col("value").alias("observed"))
    return left.join(right, [station_id, time]).select(station_id, time, "observed", "modelled")


def lapse_rate_adjustment(
    modelled: Column, elevation_difference: Column, lapse_rate: float = ENVIRONMENTAL_LAPSE_RATE
) -> Column:
    """Model temperature moved to the station's height."""
    return modelled + elevation_difference * lapse_rate


def station_metadata(
    df: DataFrame, columns: dict[str, str], *, station_id: str = "station_id"
) -> DataFrame:
    """One row of metadata per station out of a merged table; ``columns`` maps old to new name.

    Where a station's rows disagree the smallest row of values is taken, so the result does
    not depend on the order of rows.
    """
    first = df.groupBy(station_id).agg(F.min(F.struct(*columns)).alias("_m"))
    return first.select(station_id, *[F.col(f"_m.`{c}`").alias(new) for c, new in columns.items()])


def _valid(paired: DataFrame, observed: str, modelled: str) -> DataFrame:
    return paired.filter(valid_pair(F.col(observed), F.col(modelled)))


def station_metrics(
    paired: DataFrame, *, observed: str = "observed", modelled: str = "modelled",
    station_id: str = "station_id", minimum_pairs: int = 100, by=(),
    metadata: DataFrame | None = None, metadata_id: str = "synnr",
) -> DataFrame:
    """Verification metrics of each station with enough valid pairs.

    ``by`` adds grouping columns, for several variables stacked in one table.
    """
    metrics = (
        _valid(paired, observed, modelled)
        .groupBy(*by, station_id)
        .agg(*verification_metrics(F.col(observed), F.col(modelled)))
        .filter(F.col("n_pairs") >= minimum_pairs)
        .select(*by, station_id, *METRIC_NAMES)
    )
    if metadata is not None:
        keyed = metadata.withColumn("_site", F.col(metadata_id))
        metrics = metrics.join(keyed, metrics[station_id] == keyed["_site"], "left").drop("_site")
    return metrics.orderBy(*by, station_id)


def station_exclusions(
    paired: DataFrame, *, observed: str = "observed", modelled: str = "modelled",
    station_id: str = "station_id", minimum_pairs: int = 100, by=(),
) -> DataFrame:
    """How many stations there are and how many have too few valid pairs."""
    valid = valid_pair(F.col(observed), F.col(modelled))
    pairs = paired.groupBy(*by, station_id).agg(F.count_if(valid).alias("_n"))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("stations_total"),
        F.count_if(F.col("_n") < minimum_pairs).alias("stations_excluded"),
    )


def band_of(elevation: Column, bands=ELEVATION_BANDS) -> Column:
    """Index of the band ``(low, high]`` a height lies in; the first band includes its low edge."""
    index = F.when(elevation == bands[0], 0)
    for i, (low, high) in enumerate(zip(bands, bands[1:])):
        index = index.when((elevation > low) & (elevation <= high), i)
    return index


def band_table(spark: SparkSession, bands=ELEVATION_BANDS) -> DataFrame:
    rows = [
        (i, f"{low:.0f}-{high:.0f} m") for i, (low, high) in enumerate(zip(bands, bands[1:]))
    ]
    return spark.createDataFrame(rows, "band int, elevation_band string")


def elevation_band_metrics(
    stations: DataFrame, *, elevation: str = "alt", bands=ELEVATION_BANDS,
    metrics=("bias", "rmse", "correlation"), by=(),
) -> DataFrame:
    """Station count and unweighted mean of the station metrics per elevation band.

    Bands without stations stay, with a count of zero.
    """
    if elevation not in stations.columns:
        raise ValueError(f"the statistics have no {elevation!r}; add the station metadata")
    banded = stations.withColumn("band", band_of(F.col(elevation), bands))
    means = banded.filter(F.col("band").isNotNull()).groupBy(*by, "band").agg(
        F.count("*").alias("n_stations"), *[F.avg(m).alias(m) for m in metrics]
    )
    every_band = band_table(stations.sparkSession, bands)
    if by:
        groups = stations.select(*by).distinct()
        index = F.explode(F.sequence(F.lit(0), F.lit(len(bands) - 2))).alias("band")
        every_band = groups.select(*by, index).join(every_band, "band")
    result = every_band.join(means, [*by, "band"], "left")
    return result.select(
        *by, "band", "elevation_band",
        F.coalesce("n_stations", F.lit(0)).cast("bigint").alias("n_stations"), *metrics,
    ).orderBy(*by, "band").drop("band")
