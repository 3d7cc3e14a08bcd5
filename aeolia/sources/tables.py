"""Readers of long-form tables and writers of results."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.fixed_values import CANONICAL_VARIABLES, CELL, TIME
from aeolia.functions.basics import cell_key, nan_to_null

__all__ = [
    "BUCKETED_CELL", "combine", "read_paired_stations", "read_population", "read_product", "write_bucketed",
    "write_csv", "write_product",
]


#: The cell keys of a table that :func:`write_bucketed` made.
BUCKETED_CELL = ("product", "cell_id", "latitude", "longitude")


def read_product(
    spark: SparkSession, paths, product: str | None = None, *, format: str = "parquet",
    schema=None, options: dict | None = None,
) -> DataFrame:
    """Read one or more paths or globs as one raw table with ``ingest_seq`` and NaN as NULL.

    ``ingest_seq`` orders rows by file path and position in the file, which Spark rows
    themselves do not have; keep-first deduplication relies on it.
    """
    listed = [str(p) for p in ([paths] if isinstance(paths, (str, Path)) else paths)]
    if not listed:
        raise FileNotFoundError("no input paths given")
    reader = spark.read.format(format).options(**(options or {}))
    if format == "parquet":
        # Files of one product may lack a variable that others have.
        reader = reader.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    try:
        raw = reader.load(listed)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such input: {listed}") from error
        raise
    ordered = nan_to_null(raw.withColumn("ingest_seq", _ingest_order(format)))
    if product is not None:
        ordered = ordered.withColumn("product", F.lit(product))
    return ordered


def _ingest_order(format: str) -> Column:
    position = (
        F.col("_metadata.row_index") if format == "parquet" else F.monotonically_increasing_id()
    )
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        position.alias("row"),
    )


def combine(*tables: DataFrame) -> DataFrame:
    """Concatenate tables by column name; a column one of them lacks is NULL there."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def read_population(
    df: DataFrame, bounds: tuple[float, float, float, float] | None = None, *,
    crs: str | None = "crs", latitude: str = "latitude", longitude: str = "longitude",
    value: str = "population",
) -> DataFrame:
    """Population counts from a table, within ``(min_lon, min_lat, max_lon, max_lat)``.

    No data means nobody.  Where the table names a reference system it has to be 4326.
    """
    counted = F.when(F.isnan(value), 0.0).otherwise(F.coalesce(F.col(value), F.lit(0.0)))
    if crs in df.columns:
        wrong = F.raise_error(F.lit("population counts must be in EPSG:4326")).cast("double")
        degrees = F.col(crs).cast("string").isin("4326", "EPSG:4326")
        counted = F.when(F.col(crs).isNull() | degrees, counted).otherwise(wrong)
    cells = df.select(
        F.col(latitude).cast("double").alias("latitude"),
        F.col(longitude).cast("double").alias("longitude"),
        counted.alias("population"),
    )
    if bounds is None:
        return cells
    west, south, east, north = bounds
    return cells.filter(
        F.col("longitude").between(west, east) & F.col("latitude").between(south, north)
    )


def read_paired_stations(
    merged: DataFrame, variables: dict[str, tuple[str, str]], *, station_id: str = "station_id"
) -> DataFrame:
    """Stack several variables of a merged station table as (variable, station, obs, model).

    ``variables`` maps a variable name to its (observed, modelled) columns.
    """
    pairs = F.explode(
        F.array(*[
            F.struct(
                F.lit(name).alias("variable"),
                F.col(observed).cast("double").alias("observed"),
                F.col(modelled).cast("double").alias("modelled"),
            )
            for name, (observed, modelled) in variables.items()
        ])
    )
    return merged.select(F.col(station_id).alias("station_id"), pairs.alias("p")).select(
        "station_id", "p.variable", "p.observed", "p.modelled"
    )


def write_product(df: DataFrame, path: str, *, time: str = TIME, mode: str = "errorifexists") -> None:
    """Write facts by product and year, each file ordered by cell and time.

    The rebalance hint lets adaptive execution split a product-year with a large share of
    the rows over many files and join small ones.  ``overwrite`` replaces only the products
    and years that ``df`` has.
    """
    keys = [name for name in CELL if name in df.columns]
    dated = df.withColumn("year", F.year(time))
    folders = [name for name in ("product", "year") if name in dated.columns]
    (
        dated.hint("rebalance", *folders)
        .sortWithinPartitions(*folders, *[k for k in keys if k not in folders], time)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    )


def write_bucketed(df: DataFrame, table: str, path: str, *, buckets: int = 64, time: str = TIME) -> None:
    """Write facts into a table at ``path``, by product and year, each in ``buckets`` of cells sorted by time.

    Buckets go by ``cell_id``, an integer made of the coordinates, as Spark normalises doubles before
    it groups by them and then no longer knows the buckets.  A window or aggregate over
    ``BUCKETED_CELL`` and anything more, such as the blocks of :mod:`aeolia.operators.timeline`, finds
    its rows together and needs no shuffle: give ``cell=BUCKETED_CELL`` to the operators.  The number of buckets is fixed when the table is made: all rows of a cell, over all years, are read by
    one task, so take about one bucket for each task that the cluster runs at once.  Products and years
    that ``df`` has are replaced, others stay.  All canonical variables are columns of the table.
    """
    dated = df.withColumn("year", F.year(time))
    values = [
        (F.col(v) if v in df.columns else F.lit(None)).cast("double").alias(v) for v in CANONICAL_VARIABLES
    ]
    place = [F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]
    rows = (
        dated.withColumn("cell_id", cell_key(F.col("latitude"), F.col("longitude")))
        .select("cell_id", *place, F.col(time).cast("timestamp_ntz").alias(TIME), *values, "product", "year")
        .repartition(buckets, "cell_id")
        .sortWithinPartitions("product", "year", "cell_id", TIME)
    )
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        key = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")  # insertInto reads it from the session only
        try:
            rows.write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(key, before)
        return
    (
        rows.write.partitionBy("product", "year").bucketBy(buckets, "cell_id")
        .sortBy("cell_id", TIME).option("path", path).saveAsTable(table)
    )


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write a small result table as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)
