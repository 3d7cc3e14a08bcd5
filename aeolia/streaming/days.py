"""Hours and days over thresholds from a stream of observations.

Rows that are delivered again are dropped while the watermark has not passed them; the rest goes to one
state row per cell and day, which holds counts only, so state grows with cells and open
days and not with rows. Each batch writes the days it changed under its own number, and writing a batch again
replaces it, so a run that is cut off and started again from its checkpoint gives the same days.
Sums over days are batch work on that small table.

Rows later than the watermark's delay are dropped, as they would reopen days that are closed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aeolia.fixed_values import ALPINE_STORM_THRESHOLDS, CELL, TIME
from aeolia.functions.basics import epoch_seconds, time_from_epoch
from aeolia.operators.timeline import cell_columns

__all__ = ["daily_state", "deduplicated", "latest_days", "run_daily", "run_deduplicated", "storm_summary", "timed"]

EVENT_TIME = "event_time"


def timed(stream: DataFrame, time: str = TIME, delay: str = "2 hours") -> DataFrame:
    """Add the event time, which counts a zone-free time stamp as UTC, with its watermark."""
    whole = F.timestamp_seconds(epoch_seconds(F.col(time)))
    return stream.withColumn(EVENT_TIME, whole).withWatermark(EVENT_TIME, delay)


def deduplicated(stream: DataFrame, *, more_keys=(), cell=CELL, time: str = TIME) -> DataFrame:
    """The first delivered row of each cell and time stamp (and ``more_keys``) of a :func:`timed` stream."""
    return stream.dropDuplicatesWithinWatermark([*cell_columns(stream, cell), time, *more_keys])


def daily_state(stream: DataFrame, column: str, thresholds: dict[str, float], *, cell=CELL) -> DataFrame:
    """Per cell and day: steps, valid steps, steps at or above each threshold, sum and maximum."""
    value = F.col(column)
    day = F.window(EVENT_TIME, "1 day")
    found = stream.groupBy(day.alias("_window"), *cell_columns(stream, cell)).agg(
        F.count("*").alias("steps"), F.count(value).alias("valid"), F.sum(value).alias("total"), F.max(value).alias("largest"),
        *[F.count_if(value >= t).alias(f"{name}_steps") for name, t in thresholds.items()],
    )
    start = F.to_date(time_from_epoch(F.unix_seconds(F.col("_window.start"))))
    return found.withColumn("day", start).drop("_window")


def run_daily(
    stream: DataFrame, output: str, checkpoint: str, column: str, thresholds: dict[str, float] = ALPINE_STORM_THRESHOLDS, *,
    more_keys=(), delay: str = "2 hours", cell=CELL, time: str = TIME,
) -> StreamingQuery:
    """Start a run over all that the source holds now; each batch's changed days go to a folder of ``output``."""
    rows = deduplicated(timed(stream, time, delay), more_keys=more_keys, cell=cell, time=time)
    days = daily_state(rows, column, thresholds, cell=cell)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return days.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def run_deduplicated(stream: DataFrame, output: str, checkpoint: str, *, more_keys=(), delay: str = "2 hours", cell=CELL, time: str = TIME) -> StreamingQuery:
    """Start a run that appends each row once to Parquet files in ``output``."""
    rows = deduplicated(timed(stream, time, delay), more_keys=more_keys, cell=cell, time=time).drop(EVENT_TIME)
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output, format="parquet")


def latest_days(spark: SparkSession, output: str, keys: dict[str, str], thresholds: dict[str, float] = ALPINE_STORM_THRESHOLDS) -> DataFrame:
    """The days of all batches, each as its last batch left it; ``keys`` maps key columns to their types."""
    counts = ["steps", "valid", *(f"{name}_steps" for name in thresholds)]
    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), "day date", *(f"{c} long" for c in counts), "total double, largest double, batch long"])
    try:
        rows = spark.read.schema(schema).parquet(output)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    values = [*counts, "total", "largest"]
    last = rows.groupBy(*keys, "day").agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "day", *[F.col(f"_last.{v}").alias(v) for v in values])


def storm_summary(
    days: DataFrame, keys, thresholds: dict[str, float] = ALPINE_STORM_THRESHOLDS, *, timestep_hours: float = 1.0,
    day_threshold: float = ALPINE_STORM_THRESHOLDS["severe_storm"],
) -> DataFrame:
    """Per cell: hours and share of the record in each class, and days with a step at or above ``day_threshold``."""
    steps = F.sum("steps")

    def of(name: str) -> list[Column]:
        hits = F.sum(f"{name}_steps")
        return [(hits * timestep_hours).alias(f"{name}_hours"), (hits / steps).alias(f"{name}_fraction")]

    return days.groupBy(*keys).agg(*[c for name in thresholds for c in of(name)], F.count_if(F.col("largest") >= day_threshold).alias("storm_days"))
