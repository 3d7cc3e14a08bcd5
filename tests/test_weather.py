"""Small cases with known answers: rows in, rows out."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aeolia.fixed_values import ELEVATION_BANDS
from aeolia.functions import solar, wind
from aeolia.operators import accumulation, cleaning, daily, events, runs, storms, timeline, verification
from aeolia.plans import jobs
from aeolia.sources.tables import combine, write_product

T0 = datetime(2021, 1, 1)


def hourly(spark, product="a", step=1, **columns):
    n = len(next(iter(columns.values())))
    data = [(product, 46.0, 8.0, T0 + timedelta(hours=step * k), *(None if c[k] is None else float(c[k]) for c in columns.values())) for k in range(n)]
    return spark.createDataFrame(data, "product string, latitude double, longitude double, time timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))


def test_heating_degree_days_of_constant_ten_degrees(spark):
    got = daily.heating_degree_days(hourly(spark, temperature_2m=[10] * 48), assume="degC").first()
    assert got.hdd == pytest.approx(10.0)


def test_degree_days_are_of_daily_means_not_of_hours(spark):
    swing = [15 + (8 if k % 24 < 12 else -8) for k in range(72)]
    assert daily.heating_degree_days(hourly(spark, temperature_2m=swing), assume="degC").first().hdd == pytest.approx(0.0)


def test_ramps(spark):
    got = storms.ramp_magnitude(hourly(spark, wind_speed_10m=[0, 1, 2, 3, 10, 11, 12, 13]), timestep_hours=1.0).orderBy("time").collect()
    assert [r.wind_ramp for r in got] == [None, None, None, 3, 9, 9, 9, 3]


def test_runs_end_at_gaps_and_short_ones_do_not_count(spark):
    flags = [int(c) for c in "111000011111000"]
    got = runs.event_statistics(hourly(spark, on=flags), F.col("on") == 1, min_duration_hours=4, timestep_hours=1.0).first()
    assert (got.event_count, got.total_hours, got.longest_event_hours) == (1, 5.0, 5.0)
    holed = hourly(spark, on=[1] * 6).where("hour(time) != 3")
    assert runs.event_statistics(holed, F.col("on") == 1, min_duration_hours=3, timestep_hours=1.0).first().total_hours == 3.0


def test_dunkelflaute_needs_forty_eight_hours(spark):
    low = [0.01] * 60 + [0.5] * 10 + [0.01] * 40
    rows = hourly(spark, wind_capacity_factor=low, solar_capacity_factor=[0.0] * 110)
    got = events.detect(rows, timestep_hours=1.0)
    assert got.stats.first().total_hours == 60.0 and got.mask.where("dunkelflaute").count() == 60


def test_sweep_has_every_combination(spark):
    rows = hourly(spark, w=[1.0] * 30, s=[0.0] * 30)
    got = events.sensitivity_sweep(rows, "w", "s", [-1.0, 2.0, 3.0], [10, 20, 40], solar_threshold=1.0, timestep_hours=1.0)
    assert got.count() == 9 and {r.events for r in got.where("wind_threshold < 0").collect()} == {0}


def test_products_of_different_steps_have_no_one_step(spark):
    both = combine(hourly(spark, wind_speed_10m=[1] * 12), hourly(spark, "b", 6, wind_speed_10m=[1] * 12))
    with pytest.raises(ValueError, match="differ in time step"):
        timeline.infer_timestep_hours(both)
    assert timeline.infer_timestep_hours(both.where("product = 'b'")) == 6.0


def test_gust_source_is_by_product(spark):
    native = hourly(spark, wind_speed_10m=[5, 6], wind_gust_10m=[9, 9])
    got = storms.resolve_gusts(combine(native, hourly(spark, "b", wind_speed_10m=[5, 7])))
    assert {(r.product, r.gust_source) for r in got.collect()} == {("a", "native"), ("b", "estimated")}
    assert got.where("gust IS NULL").count() == 0


def test_hub_wind_is_by_row(spark):
    both = combine(hourly(spark, wind_speed_100m=[20] * 3, wind_speed_10m=[1] * 3, temperature_2m=[1] * 3), hourly(spark, "b", wind_speed_10m=[20] * 3, temperature_2m=[1] * 3))
    got = {r.product: (r.storm_hours, r.hub_wind_source) for r in jobs.winter_projection(both).collect()}
    assert got == {"a": (3.0, "native"), "b": (3.0, "extrapolated")}


def test_longitude_of_a_whole_record(spark):
    full = spark.createDataFrame([(0.0,), (180.0,), (270.0,)], "longitude double")
    assert [r[0] for r in cleaning.normalise_longitude(full).orderBy("longitude").collect()] == [-180.0, -90.0, 0.0]
    half = spark.createDataFrame([(-10.0,), (180.0,)], "longitude double")
    assert [r[0] for r in cleaning.normalise_longitude(half).orderBy("longitude").collect()] == [-10.0, 180.0]


def test_capacity_factor_edges(spark):
    speeds = [2.9, 3.0, 12.0, 24.9, 25.0, None, float("nan")]
    got = spark.createDataFrame([(s,) for s in speeds], "u double").select(wind.capacity_factor(F.col("u"))).collect()
    assert [r[0] for r in got] == [0.0, 0.0, 1.0, 1.0, 0.0, None, None]


def test_fixed_tilt_is_dark_at_night_and_bounded(spark):
    rows = hourly(spark, solar_radiation=[0 if k < 6 or k > 18 else 600 for k in range(24)])
    got = solar.fixed_tilt_capacity_factor(rows).orderBy("time").collect()
    assert got[0].solar_capacity_factor == 0.0 and 0 < max(r.solar_capacity_factor for r in got) <= 1


def test_block_accumulator_needs_the_declared_reset(spark):
    true = [3600.0 * k for k in (1, 2, 3, 4, 5, 6, 7, 8)]
    # Blocks open at 01, 04, 07.
    held, total = [], 0.0
    for k, v in enumerate(true):
        total = v if k % 3 == 1 else total + v
        held.append(total)
    got = accumulation.to_rate(hourly(spark, ssrd=held), "ssrd", "running", timestep_seconds=3600.0, reset_hours=3, reset_offset=1).orderBy("time").collect()
    assert [r.ssrd for r in got][1:] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]


def test_first_of_duplicated_times_stays(spark):
    rows = hourly(spark, v=[1, 2, 3]).withColumn("ingest_seq", F.lit(0))
    twice = rows.unionByName(rows.where("v = 2").withColumn("v", F.lit(99.0)).withColumn("ingest_seq", F.lit(1)))
    assert [r.v for r in cleaning.remove_duplicate_times(twice).orderBy("time").collect()] == [1, 2, 3]


def test_station_without_position_stays(spark):
    grid = spark.createDataFrame([(46.0, 8.0), (46.5, 8.5)], "latitude double, longitude double")
    stations = spark.createDataFrame([(1, 46.1, 8.1, 100.0), (2, None, 8.0, 50.0)], "station_id long, lat double, lon double, alt double")
    got = {r.station_id: r.grid_lat for r in verification.match_stations_to_grid(grid, stations).collect()}
    assert got == {1: 46.0, 2: None}


def test_elevation_bands_with_an_empty_one(spark):
    stats = spark.createDataFrame([(1, 100.0, 1.0, 1.0, 0.9), (2, 1200.0, 2.0, 2.0, 0.8), (3, 2000.0, 3.0, 3.0, 0.7), (4, 3000.0, 4.0, 4.0, 0.6)], "station_id long, alt double, bias double, rmse double, correlation double")
    assert [r.n_stations for r in verification.elevation_band_metrics(stats).collect()] == [1, 0, 1, 1, 1] and len(ELEVATION_BANDS) == 6


def test_products_share_one_written_table(spark, tmp_path):
    root = str(tmp_path / "facts")
    write_product(hourly(spark, v=[1, 2]), root, mode="overwrite")
    write_product(hourly(spark, "b", v=[3]), root, mode="overwrite")
    write_product(hourly(spark, "b", v=[4]), root, mode="overwrite")
    got = spark.read.parquet(root)
    assert sorted((r.product, r.v) for r in got.collect()) == [("a", 1.0), ("a", 2.0), ("b", 4.0)]


def test_box_reaches_the_scan(spark, tmp_path):
    from aeolia.sources.tables import read_product

    path = str(tmp_path / "raw")
    hourly(spark, v=[1, 2]).write.parquet(path)
    boxed = cleaning.subset_spatial(read_product(spark, path, "era5"))
    plan = boxed._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "latitude" in pushed and "longitude" in pushed
