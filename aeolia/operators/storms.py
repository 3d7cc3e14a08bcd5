"""Hours above thresholds, wind ramps and gusts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolia.fixed_values import (
    ALPINE_STORM_THRESHOLDS,
    CELL,
    ESSL_GUST_THRESHOLDS,
    MINIMUM_GUST_FACTOR,
    NATIVE_GUST_VARIABLES,
    RAMP_THRESHOLDS,
    TIME,
    WIERINGA_K,
)
from aeolia.functions.basics import epoch_seconds
from aeolia.operators.timeline import (
    BLOCK_HOURS, block_of, block_seconds, cell_columns, shifted, step_hours,
)

__all__ = [
    "classify_gust_severity", "estimate_gusts", "exceedance_hours", "forecast_maxima",
    "gust_factor", "native_gust_variable", "ramp_magnitude", "resolve_gusts", "storm_hours",
    "threshold_counts", "threshold_table", "wind_ramps",
]


def threshold_table(spark, catalogue: dict[str, float], name: str = "class") -> DataFrame:
    """A threshold catalogue as rows."""
    return spark.createDataFrame(list(catalogue.items()), f"{name} string, threshold double")


def threshold_counts(df: DataFrame, column: str, catalogue: dict[str, float], name: str = "class") -> DataFrame:
    """How many values reach each class of a catalogue: one pass, one row per class."""
    counts = df.agg(*[F.count_if(F.col(column) >= t).alias(c) for c, t in catalogue.items()])
    rows = F.array(*[F.struct(F.lit(c).alias(name), F.lit(float(t)).alias("threshold"), F.col(c).alias("n")) for c, t in catalogue.items()])
    return counts.select(F.inline(rows))


def exceedance_hours(
    df: DataFrame, column: str, threshold: float, *, below: bool = False,
    timestep_hours: float | None = None, output: str = "exceedance_hours",
    cell=CELL, time: str = TIME,
) -> DataFrame:
    """Time at or above a threshold, or below it, in hours."""
    dt = step_hours(df, timestep_hours, time)
    hit = F.col(column) < threshold if below else F.col(column) >= threshold
    return df.groupBy(*cell_columns(df, cell)).agg((F.count_if(hit) * dt).alias(output))


def storm_hours(
    df: DataFrame, column: str = "wind_speed_10m", thresholds: dict = ALPINE_STORM_THRESHOLDS, *,
    timestep_hours: float | None = None, cell=CELL, time: str = TIME,
) -> DataFrame:
    """Hours and share of the record at or above each class of mean wind, in one pass.

    A step counts for every class it reaches.  Missing values lengthen the record.
    """
    dt = step_hours(df, timestep_hours, time)
    sums = []
    for name, threshold in thresholds.items():
        steps = F.count_if(F.col(column) >= threshold)
        sums += [
            (steps * dt).alias(f"{name}_hours"),
            (steps / F.count("*")).alias(f"{name}_fraction"),
        ]
    return df.groupBy(*cell_columns(df, cell)).agg(*sums)


def window_steps(window_hours: float, timestep_hours: float) -> int:
    steps = round(window_hours / timestep_hours)
    if steps < 1 or abs(steps - window_hours / timestep_hours) > 1e-6:
        raise ValueError(f"{window_hours} h is no whole number of {timestep_hours} h steps")
    return steps


def ramp_magnitude(
    df: DataFrame, column: str = "wind_speed_10m", window_hours: float = 3.0, *,
    timestep_hours: float | None = None, output: str = "wind_ramp",
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Change across a window, ``u(t) - u(t - window)``, as a new column."""
    dt = step_hours(df, timestep_hours, time)
    earlier = shifted(
        df, {column: "_earlier"}, window_steps(window_hours, dt), dt,
        cell=cell, time=time, block_hours=block_hours,
    )
    return earlier.withColumn(output, F.col(column) - F.col("_earlier")).drop("_earlier")


def wind_ramps(
    df: DataFrame, column: str = "wind_speed_10m", window_hours: float = 3.0,
    thresholds: dict = RAMP_THRESHOLDS, *, timestep_hours: float | None = None,
    cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Steps with a rise or fall of each class, and the largest rise and fall."""
    keys = cell_columns(df, cell)
    ramps = ramp_magnitude(
        df.select(*keys, time, column), column, window_hours, timestep_hours=timestep_hours,
        cell=cell, time=time, block_hours=block_hours,
    )
    change = F.col("wind_ramp")
    counts = []
    for name, threshold in thresholds.items():
        counts += [
            F.count_if(change >= threshold).alias(f"{name}_up_count"),
            F.count_if(change <= -threshold).alias(f"{name}_down_count"),
        ]
    return ramps.groupBy(*keys).agg(
        *counts, F.max(change).alias("max_ramp_up"), F.min(change).alias("max_ramp_down")
    )


def native_gust_variable(df: DataFrame, candidates=NATIVE_GUST_VARIABLES) -> str | None:
    return next((name for name in candidates if name in df.columns), None)


def gust_estimate(wind: Column, sigma: Column, k: float = WIERINGA_K) -> Column:
    """Mean wind plus k standard deviations, never below the mean wind."""
    gust = wind + k * sigma
    return F.when(gust < wind, wind * MINIMUM_GUST_FACTOR).otherwise(gust)


def estimate_gusts(
    df: DataFrame, wind: str = "wind_speed_10m", k: float = WIERINGA_K, *,
    output: str = "gust", cell=CELL, time: str = TIME, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Add gusts estimated from each cell's mean wind and its temporal spread.

    The spread is an aggregate that combines before its shuffle.  It comes back to the rows
    by a join on cell and time block, so a cell with a third of the rows is spread over its
    blocks; the block list of a cell is bounded by the length of its record.
    """
    keys = cell_columns(df, cell)
    sigma = F.stddev_pop(wind).alias("_sigma")
    if time not in df.columns:
        return _with_gust(df.withColumn("_sigma", df.agg(sigma).scalar()), wind, k, output)
    # Rows without a time share one block, so that none is lost in the join.
    block = F.coalesce(block_of(epoch_seconds(F.col(time)), block_seconds(block_hours)), F.lit(-1))
    rows = df.withColumn("_blk", block)
    spread = (
        rows.groupBy(*keys).agg(sigma, F.collect_set("_blk").alias("_blks"))
        .select(*keys, "_sigma", F.explode("_blks").alias("_blk"))
    )
    return _with_gust(rows.join(spread, [*keys, "_blk"]), wind, k, output).drop("_blk")


def _with_gust(df: DataFrame, wind: str, k: float, output: str) -> DataFrame:
    return df.withColumns(
        {output: gust_estimate(F.col(wind), F.col("_sigma"), k), "gust_source": F.lit("estimated")}
    ).drop("_sigma")


def resolve_gusts(
    df: DataFrame, wind: str = "wind_speed_10m", k: float = WIERINGA_K, *,
    candidates=NATIVE_GUST_VARIABLES, output: str = "gust", cell=CELL, time: str = TIME,
    block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Add ``gust`` and ``gust_source``: the native field where there is one, else an estimate."""
    native = native_gust_variable(df, candidates)
    if native is not None:
        # A product that has no native gust anywhere is estimated, whatever others have.
        product = [name for name in ("product",) if name in df.columns]
        own = F.bool_or(F.col(native).isNotNull()).alias("_native")
        if wind not in df.columns:
            return df.withColumns({output: F.col(native), "gust_source": F.lit("native")})
        known = df.groupBy(*product).agg(own)
        # A row for each product: joined by product, all rows of one would meet in a task.
        told = df.join(F.broadcast(known), product) if product else df.withColumn("_native", known.scalar())
        kept = told.filter("_native").withColumns({output: F.col(native), "gust_source": F.lit("native")})
        rest = told.filter("NOT _native").drop(output) if output != native else told.filter("NOT _native")
        estimated = estimate_gusts(rest, wind, k, output=output, cell=cell, time=time, block_hours=block_hours)
        return kept.unionByName(estimated, allowMissingColumns=True).drop("_native")
    if wind not in df.columns:
        raise ValueError(
            f"neither a native gust {list(candidates)} nor {wind!r} is there: {sorted(df.columns)}"
        )
    return estimate_gusts(
        df, wind, k, output=output, cell=cell, time=time, block_hours=block_hours
    )


def gust_factor(gust: Column, wind: Column) -> Column:
    """Gust over mean wind, missing in a calm."""
    return F.when(wind > 0, gust / wind)


def classify_gust_severity(
    df: DataFrame, column: str = "gust", thresholds: dict = ESSL_GUST_THRESHOLDS, *,
    timestep_hours: float | None = None, cell=CELL, time: str = TIME,
) -> DataFrame:
    """Hours at or above each gust class, the largest gust, and where the gusts come from."""
    dt = step_hours(df, timestep_hours, time)
    source = F.max("gust_source") if "gust_source" in df.columns else F.lit("unknown")
    return df.groupBy(*cell_columns(df, cell)).agg(
        *[(F.count_if(F.col(column) >= t) * dt).alias(f"{n}_hours") for n, t in thresholds.items()],
        F.max(column).alias("max_gust"),
        source.alias("gust_source"),
    )


def forecast_maxima(
    df: DataFrame, gust: str = "wind_gust_10m", wind: str = "wind_speed_10m", *, cell=CELL
) -> DataFrame:
    """Largest gust and mean wind of each cell over all steps; no gust field gives NULL."""
    gusts = F.max(gust) if gust in df.columns else F.lit(None).cast("double")
    return df.groupBy(*cell_columns(df, cell)).agg(
        gusts.alias("max_gust"), F.max(wind).alias("max_wind")
    )
