"""Streams against batch operators: repeated rows, late rows, files that come in parts, and a run started again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from aeolia import streaming
from aeolia.fixed_values import ALPINE_STORM_THRESHOLDS
from aeolia.operators import daily, storms

T0 = datetime(2024, 3, 1)
CELL = ("product", "cell")
SCHEMA = "product string, cell long, time timestamp_ntz, wind_speed_10m double"


def rows(hours, cells=(1, 2), shift=0.0):
    return [("a", c, T0 + timedelta(hours=h), None if (h + c) % 11 == 0 else float((h * 7 + c * 3) % 23) + shift) for c in cells for h in hours]


def write(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def summed(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_days_equal_the_batch_operators_over_a_restart(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    write(spark, folder, rows(range(0, 30)))
    streaming.run_daily(source(spark, folder), out, mark, "wind_speed_10m", cell=CELL, delay="12 hours").awaitTermination()
    # Later files bring the end, an hour left out before (late, yet within the delay) and rows seen before.
    write(spark, folder, rows(range(31, 60)))
    write(spark, folder, rows([30, 58]) + rows(range(50, 56)))
    streaming.run_daily(source(spark, folder), out, mark, "wind_speed_10m", cell=CELL, delay="12 hours").awaitTermination()
    days = streaming.latest_days(spark, out, {"product": "string", "cell": "long"})
    batch = spark.createDataFrame(rows(range(0, 60)), SCHEMA)
    got = streaming.storm_summary(days, CELL)
    hours = storms.storm_hours(batch, timestep_hours=1.0, cell=CELL)
    assert summed(got.select(hours.columns)) == summed(hours)
    assert summed(got.select(*CELL, "storm_days")) == summed(daily.storm_days(batch, cell=CELL))
    assert days.count() == 6 and summed(days.groupBy("cell").agg(F.sum("steps"))) == [(1, 60), (2, 60)]
    # Nothing new: no batch, and the days stay.
    streaming.run_daily(source(spark, folder), out, mark, "wind_speed_10m", cell=CELL, delay="12 hours").awaitTermination()
    assert summed(streaming.storm_summary(streaming.latest_days(spark, out, {"product": "string", "cell": "long"}), CELL)) == summed(got)


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    write(spark, folder, rows(range(0, 24)))
    for _ in range(2):  # a lost checkpoint: the same batch is made and written again
        streaming.run_daily(source(spark, folder), out, f"{mark}{_}", "wind_speed_10m", cell=CELL).awaitTermination()
    days = streaming.latest_days(spark, out, {"product": "string", "cell": "long"})
    assert sorted(r.steps for r in days.collect()) == [24, 24]


def test_first_delivery_stays_and_late_rows_go(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for data in (rows(range(0, 24)), rows(range(20, 30), shift=100.0), rows([40]), rows([2, 39], cells=(3,))):
        write(spark, folder, data)
        streaming.run_deduplicated(source(spark, folder), out, mark, cell=CELL, delay="6 hours").awaitTermination()
    kept = spark.read.parquet(out)
    assert kept.count() == 2 * 31 + 1  # hour 2 of cell 3 is later than the delay
    assert kept.where("cell = 3").first().time == T0 + timedelta(hours=39)
    again = kept.where(F.col("time").between(T0 + timedelta(hours=20), T0 + timedelta(hours=23)))
    assert again.where("wind_speed_10m >= 100").count() == 0


def test_no_files_no_days(spark, tmp_path):
    (tmp_path / "in").mkdir()
    streaming.run_daily(source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"), "wind_speed_10m", cell=CELL).awaitTermination()
    days = streaming.latest_days(spark, str(tmp_path / "out"), {"product": "string", "cell": "long"})
    assert days.count() == 0 and len(streaming.storm_summary(days, CELL).columns) == 2 + 2 * len(ALPINE_STORM_THRESHOLDS) + 1
