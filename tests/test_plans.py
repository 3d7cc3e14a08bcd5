"""The whole chain from raw files: plans, provenance, guards, and tables that need no shuffle."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolia.operators import cleaning, limits, naming, runs
from aeolia.plans import jobs, standardise
from aeolia.sources import provenance, registry, tables

T0 = datetime(2021, 1, 1)
BOX = cleaning.BoundingBox(7.0, 9.0, 45.0, 47.0)


def raw(spark, hours=24, lat=(46.0, 50.0), temperature=280.0):
    rows = [(T0 + timedelta(hours=h), y, 8.0, temperature, 3.0, 4.0, 3600.0 * ((h + 2) % 3 + 1)) for y in lat for h in range(hours)]
    return spark.createDataFrame(rows, "valid_time timestamp_ntz, lat double, lon double, t double, u10m double, v10m double, grad double")


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "3000")
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return [line for line in plan(df).splitlines() if "FileScan" in line]


def test_chain_from_files(spark, tmp_path):
    path = str(tmp_path / "m0")
    raw(spark).write.parquet(path)
    raw(spark, hours=3, temperature=999.0).write.parquet(str(tmp_path / "m1"))
    out = standardise.open_product(spark, [path, str(tmp_path / "m1")], "ara", domain=BOX, temperature_unit="K")
    rows = out.orderBy("time").collect()
    assert len(rows) == 24 and {round(r.temperature_2m, 2) for r in rows} == {6.85} and {r.wind_speed_10m for r in rows} == {5.0}
    # Running totals of one unit an hour: every step gains 3600 but the first, which has its own value.
    assert [r.solar_radiation for r in rows] == [3.0] + [1.0] * 23
    with pytest.raises(FileNotFoundError):
        standardise.open_product(spark, str(tmp_path / "none"), "ara")
    with pytest.raises(FileNotFoundError):
        standardise.open_product(spark, [], "ara")
    with pytest.raises(KeyError, match="era5_land"):
        standardise.open_product(spark, path, "unknown")


def test_box_and_blocks_of_time_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "m0")
    raw(spark, hours=24 * 60, lat=(46.0,)).write.parquet(path)
    out = standardise.open_product(spark, path, "ara", domain=BOX, start="2021-02-10", end="2021-02-12", temperature_unit="K", block_hours=24.0)
    assert out.count() == 72 and out.orderBy("time").first().solar_radiation == 1.0
    found = scans(out)
    assert found and all("lat" in x.split("PushedFilters")[1] and "lon" in x.split("PushedFilters")[1] for x in found)
    # Of the rows themselves only whole blocks near the range are read; their predecessors are looked up without it.
    assert any("GreaterThanOrEqual(valid_time" in x and "LessThan(valid_time" in x for x in found)


def test_a_time_range_keeps_its_first_predecessor(spark, tmp_path):
    path = str(tmp_path / "m0")
    raw(spark, hours=48, lat=(46.0,)).write.parquet(path)
    whole = standardise.open_product(spark, path, "ara", temperature_unit="K")
    part = standardise.open_product(spark, path, "ara", start="2021-01-02", temperature_unit="K", block_hours=6.0)
    assert part.select("time", "solar_radiation").exceptAll(whole.where("time >= '2021-01-02'").select("time", "solar_radiation")).count() == 0 and part.count() == 24


def test_guards_name_what_there_is(spark):
    table = raw(spark).withColumn("ingest_seq", F.lit(0))
    far = cleaning.BoundingBox(-20.0, -10.0, 45.0, 47.0, "far away")
    with pytest.raises(ValueError, match="46.0"):
        standardise.standardise(table, "ara", domain=far, temperature_unit="K", check=True)
    with pytest.raises(ValueError, match="2021"):
        standardise.standardise(table, "ara", start="2030-01-01", temperature_unit="K", check=True)
    with pytest.raises(ValueError, match="starts after it ends"):
        standardise.standardise(table, "ara", start="2021-02-01", end="2021-01-01", temperature_unit="K")
    with pytest.raises(ValueError, match="ingest_seq"):
        standardise.standardise(raw(spark), "ara")
    with pytest.raises(ValueError, match="action"):
        standardise.standardise(table, "ara", temperature_unit="K", quality_control="drop")
    for box in ((9.0, 7.0, 45.0, 47.0), (7.0, 9.0, 47.0, 45.0), (7.0, 9.0, 45.0, 95.0)):
        with pytest.raises(ValueError):
            cleaning.BoundingBox(*box)
    with pytest.raises(ValueError, match="already converted"):
        once = standardise.standardise(table, "ara", temperature_unit="K")
        standardise.standardise(once.withColumn("ingest_seq", F.lit(0)), "ara", temperature_unit="degC")


def test_population_in_another_reference_system_is_an_error(spark):
    rows = spark.createDataFrame([(46.0, 8.0, 5.0, "EPSG:4326"), (46.1, 8.0, float("nan"), "4326"), (46.2, 8.0, None, None)], "latitude double, longitude double, population double, crs string")
    assert sorted(r.population for r in tables.read_population(rows).collect()) == [0.0, 0.0, 5.0]
    with pytest.raises(Exception, match="EPSG:4326"):
        tables.read_population(rows.withColumn("crs", F.lit("EPSG:3035"))).collect()


def test_provenance_counts_in_the_pass_that_writes(spark, tmp_path):
    table = raw(spark, lat=(46.0,)).withColumn("ingest_seq", F.lit(0))
    table = table.unionByName(raw(spark, hours=3, lat=(46.0,)).withColumn("ingest_seq", F.lit(1))).withColumn("u10m", F.when(F.hour("valid_time") == 5, 500.0).otherwise(F.col("u10m")))
    made = standardise.standardise_observed(table, "ara", domain=BOX, temperature_unit="K")
    jobs_before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    made.table.write.parquet(str(tmp_path / "out"))
    jobs_after = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    found = provenance.provenance_values(made.provenance("ara"), "ara")
    assert (found["rows"], found["duplicate_rows_removed"], found["out_of_range"]) == (24, 3, {"u_wind_10m": 1, "wind_speed_10m": 1})
    assert found["renamed"]["grad"] == "solar_radiation" and found["ranges"]["temperature_2m"] == [-90.0, 60.0] and found["domain"] == [7.0, 9.0, 45.0, 47.0]
    assert found["quality_control"] == "mask" and found["period"] == [None, None] and found["timestep_hours"] == 1.0
    assert made.observation.get["rows"] == 24 and jobs_after > jobs_before
    assert "_copies" not in made.table.columns


def test_known_names_only(spark):
    table = raw(spark, hours=1).withColumn("note", F.lit("x"))
    kept = naming.rename_to_canonical(table, registry.get_product("ara").extra_aliases, keep_unknown=False)
    assert kept.columns == ["time", "latitude", "longitude", "temperature_2m", "u_wind_10m", "v_wind_10m", "solar_radiation"]


def test_a_bucketed_table_needs_no_shuffle_along_time(spark, tmp_path):
    for k, value in enumerate((280.0, 281.0)):
        raw(spark, hours=80, lat=(46.0, 46.5, 46.7), temperature=value).write.parquet(str(tmp_path / f"raw{k}"))
    raw(spark, hours=10, lat=(46.0,)).selectExpr("valid_time time", "lat latitude", "lon longitude", "t t2m", "u10m u10", "v10m v10").write.parquet(str(tmp_path / "era"))
    both = [jobs.ProductSource("ara", (str(tmp_path / "raw0"),), choices={"temperature_unit": "K"}), jobs.ProductSource("era5", (str(tmp_path / "era"),), choices={"temperature_unit": "K"})]
    try:
        notes = jobs.standardise_all(spark, both, str(tmp_path / "table"), table="facts_of_a_test", buckets=4)
        assert {(r.output, r.value_json) for r in notes.where("key = 'rows'").collect()} == {("ara", "240"), ("era5", "10")}
        # A second batch renews its product and leaves the other.
        jobs.standardise_all(spark, [jobs.ProductSource("ara", (str(tmp_path / "raw1"),), choices={"temperature_unit": "K"})], str(tmp_path / "table"), table="facts_of_a_test", buckets=4)
        table = spark.table("facts_of_a_test")
        got = {r["product"]: (r["n"], round(r["t"], 2)) for r in table.groupBy("product").agg(F.count("*").alias("n"), F.max("temperature_2m").alias("t")).collect()}
        assert got == {"ara": (240, 7.85), "era5": (10, 6.85)}
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        held = runs.sustained(table, F.col("wind_speed_10m") > 3, min_duration_hours=48, timestep_hours=1.0, cell=tables.BUCKETED_CELL)
        assert "Exchange" not in plan(held) and "Window" in plan(held)
        assert held.where("sustained").count() == 240
        plain = runs.sustained(spark.read.parquet(str(tmp_path / "table")), F.col("wind_speed_10m") > 3, min_duration_hours=48, timestep_hours=1.0)
        assert "Exchange" in plan(plain)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE IF EXISTS facts_of_a_test")


def test_csv_sink(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, 0.5), (2, None)], "station_id int, bias double"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).schema("station_id int, bias double").csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == [(1, 0.5), (2, None)]


def test_stations_and_bands_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows, alt = [], {k: float(h) for k, h in enumerate((0, 100, 600, 1600, 5000))}
    for k in alt:
        o = rng.normal(10, 5, 150)
        m = o + rng.normal(k, 1, 150)
        rows += [(k, float(a), float(b), float(a) / 2, None if j % 3 == 0 else float(b)) for j, (a, b) in enumerate(zip(o, m))]
    merged = spark.createDataFrame(rows, "station_id long, t_obs double, t_mod double, w_obs double, w_mod double")
    sites = spark.createDataFrame([(k, h) for k, h in alt.items()], "synnr long, alt double")
    per, bands = jobs.station_verification(merged, sites, {"t": ("t_obs", "t_mod"), "w": ("w_obs", "w_mod")}, minimum_pairs=100)
    got = {(r.variable, r.station_id): r for r in per.collect()}
    want = {}
    for k in alt:
        for name, pairs in (("t", [(r[1], r[2]) for r in rows if r[0] == k]), ("w", [(r[3], r[4]) for r in rows if r[0] == k and r[4] is not None])):
            o, m = np.array(pairs).T
            want[name, k] = (m - o).mean(), np.sqrt(((m - o) ** 2).mean()), np.corrcoef(o, m)[0, 1]
            r = got[name, k]
            assert r.n_pairs == len(o) and (r.bias, r.rmse, r.correlation) == pytest.approx(want[name, k], abs=1e-12)
    found = {(r.variable, r.elevation_band): r for r in bands.collect()}
    assert len(found) == 10
    for name in "tw":
        low, none = found[name, "0-500 m"], found[name, "1000-1500 m"]
        assert low.n_stations == 2 and low.rmse == pytest.approx((want[name, 0][1] + want[name, 1][1]) / 2, abs=1e-12)
        assert none.n_stations == 0 and none.bias is None


def test_nearest_population_takes_the_lower_neighbour_at_a_tie(spark):
    from aeolia.operators import exposure

    people = spark.createDataFrame([(y, x, float(10 * y + x)) for y in (0.0, 1.0, 2.0) for x in (0.0, 1.0)], "latitude double, longitude double, population double")
    cells = spark.createDataFrame([(0.5, 0.0), (1.75, 1.0), (2.5, 0.0), (-1.0, 1.0), (0.0, 0.5)], "latitude double, longitude double")
    out = exposure.aggregate_population_to_grid(people, cells, "nearest_normalised")
    got = {(r.latitude, r.longitude): r.population for r in out.collect()}
    # Sampled: 0 (tie to the lower row), 21, nobody twice (outside), 0; rescaled to all 63 people.
    assert got == {(0.5, 0.0): 0.0, (1.75, 1.0): 63.0, (2.5, 0.0): 0.0, (-1.0, 1.0): 0.0, (0.0, 0.5): 0.0}
    assert "moves people" in out.schema["population"].metadata["warning"]


@pytest.mark.parametrize("kind", ["normal", "steps", "constant", "tails", "huge", "tiny", "two"])
def test_order_statistics_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(size=5001), "steps": rng.integers(0, 5, 4000).astype(float), "constant": np.full(300, -2.5), "tails": np.exp(rng.normal(0, 60, 3000)) * rng.choice([-1, 1], 3000),
        "huge": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 5e-324]), "tiny": np.arange(50) * 5e-324, "two": np.array([1.0, np.nextafter(1.0, 2.0)]),
    }[kind]
    table = spark.createDataFrame([(float(v),) for v in values], "value double").repartition(3)
    ordered, ranks = np.sort(values), sorted({0, len(values) // 2, int(len(values) * 0.99), len(values) - 1})
    assert limits.order_statistics(table, "value", ranks) == [ordered[r] for r in ranks]
    if kind in ("normal", "steps", "constant"):
        got = limits.exact_percentile(table, "value", 99.0).first()[0]
        assert got == pytest.approx(np.percentile(values, 99), abs=1e-12)


def test_limits_of_nothing_are_an_error(spark):
    nothing = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "value double")
    with pytest.raises(Exception, match="no finite values"):
        limits.shared_limits([(nothing, "value")]).collect()
    same = spark.createDataFrame([(2.0,), (2.0,)], "value double")
    assert tuple(limits.shared_limits([(same, "value")]).first()) == (2.0, 3.0)


def test_sun_is_lifted_less_where_air_is_thin(spark):
    from aeolia.functions import solar

    rows = [(T0 + timedelta(minutes=10 * k), 46.0, 8.0, 100.0, float(h)) for k in range(144) for h in (0, 4000)]
    table = spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, solar_radiation double, height double")
    got = solar.fixed_tilt_capacity_factor(table, altitude="height", keep_stages=True)
    low, high = (got.where(f"height = {h}").orderBy("time").collect() for h in (0, 4000))
    lifts = [(a._pv_apparent - np.radians(a._pv_elevation), b._pv_apparent - np.radians(b._pv_elevation)) for a, b in zip(low, high)]
    assert max(x for x, _ in lifts) < np.radians(0.7) and all(0 <= y <= x for x, y in lifts)
    near = min(low, key=lambda r: abs(r._pv_elevation))
    assert 0.3 < np.degrees(near._pv_apparent) - near._pv_elevation < 0.65
    assert all(0 <= r.solar_capacity_factor <= 1 for r in low + high)
    with pytest.raises(ValueError, match="height"):
        solar.fixed_tilt_capacity_factor(table.drop("height"), altitude="height")


def test_cold_statistics_of_one_pass(spark):
    """Episodes and their cold spells in one job, whose rows are shuffled once for the episodes."""
    from aeolia.operators import events

    low = [0.01] * 60 + [0.5] * 10 + [0.01] * 40 + [0.5] + [0.01] * 50
    cold = [k % 20 < 5 or k > 120 for k in range(len(low))]
    rows = [("a", 46.0, 8.0, T0 + timedelta(hours=k), w, 0.0, -1.0 if c else (None if k == 3 else 4.0)) for k, (w, c) in enumerate(zip(low, cold))]
    table = spark.createDataFrame(rows, "product string, latitude double, longitude double, time timestamp_ntz, wind_capacity_factor double, solar_capacity_factor double, t double")
    table = table.unionByName(table.where("hour(time) < 3").withColumn("product", F.lit("none")))
    found = events.detect(table, temperature="t", timestep_hours=1.0)
    got = {r.product: r.asDict() for r in found.stats.collect()}
    plain = {r.product: r.asDict() for r in events.detect(table, timestep_hours=1.0).stats.collect()}
    assert all(got[p][k] == v for p in plain for k, v in plain[p].items()) and got["a"]["event_count"] == 2
    inside = [k for k in range(len(low)) if k < 60 or k > 110]
    spells = [k for k in inside if cold[k] and not (k - 1 in inside and cold[k - 1])]
    assert (got["a"]["cold_event_count"], got["a"]["cold_total_hours"]) == (len(spells), float(sum(cold[k] for k in inside)))
    assert got["a"]["cold_longest_event_hours"] == 41.0 and got["none"]["cold_event_count"] == 0 and got["none"]["frequency"] == 0
    assert found.mask.where("cold_dunkelflaute").count() == got["a"]["cold_total_hours"]


@pytest.mark.parametrize("kind", ["csv", "orc", "json"])
def test_other_formats_keep_their_first_rows(spark, tmp_path, kind):
    first, second = str(tmp_path / "m0"), str(tmp_path / "m1")
    table = raw(spark, hours=6, lat=(46.0,))
    for path, rows in ((first, table), (second, raw(spark, hours=2, lat=(46.0,), temperature=999.0))):
        rows.write.format(kind).option("header", True).save(path)
    choices = {"format": kind, "schema": table.schema, "options": {"header": True} if kind == "csv" else None}
    out = standardise.open_product(spark, [first, second], "ara", temperature_unit="K", **choices)
    assert {round(r.temperature_2m, 2) for r in out.collect()} == {6.85} and out.count() == 6


def test_a_variable_that_some_files_lack(spark, tmp_path):
    first, second = str(tmp_path / "m0"), str(tmp_path / "m1")
    raw(spark, hours=3, lat=(46.0,)).drop("u10m").write.parquet(first)
    raw(spark, hours=6, lat=(46.0,)).where("valid_time >= '2021-01-01 03:00:00'").write.parquet(second)
    rows = standardise.open_product(spark, [first, second], "ara", temperature_unit="K").orderBy("time").collect()
    assert [r.u_wind_10m for r in rows] == [None] * 3 + [3.0] * 3 and [r.wind_speed_10m for r in rows] == [None] * 3 + [5.0] * 3
    assert [r.solar_radiation for r in rows] == [3.0] + [1.0] * 5
