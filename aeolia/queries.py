"""Registered queries, one for each operator, and the SQL that states the same.

Every query reads whole views of :mod:`aeolia.fixtures`. Columns in ``rounded`` are rounded to
six decimals on both sides, as sums of floating-point values depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.fixtures import portable, view
from aeolia.functions import hydro, metrics, solar, units, wind
from aeolia.operators import accumulation, cleaning, daily, events, exposure, limits, naming, runs, storms, timeline, verification, water
from aeolia.plans import jobs
from aeolia.sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CELLS = "product, latitude, longitude"
HOUR = {"timestep_hours": 1.0}


def query(name: str, views: str, sql: str | None, rounded: str = ""):
    """Registers ``f(view, ...)``; views and rounded are names parted by blanks."""
    names, columns = views.split(), rounded.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(*(view(spark, sf_dir, v) for v in names))
            return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})

        QUERIES[name] = run
        if sql is not None:
            replaced = f"* REPLACE ({', '.join(f'round({c}, 6) + 0.0e0 AS {c}' for c in columns)})" if columns else "*"
            more, body = sql.strip()[1:].rsplit("\nSELECT", 1) if sql.strip().startswith(",") else ("", sql)
            before = ", ".join(x for x in (portable(*names), more.strip()) if x)
            ORACLES[name] = f"WITH {before + ', ' if before else ''}result AS ({'SELECT' + body if more else body})\nSELECT {replaced} FROM result"
        return f

    return add


def _per_cell(df: DataFrame, *aggregates) -> DataFrame:
    return df.groupBy("product", "latitude", "longitude").agg(*aggregates)


# --- pure column functions: a total per cell, and how many values there are ------------------
def _total(name: str, views: str, column: str, expression: str, source: str = "w"):
    """A query for a column function: its total, largest value and count per cell."""
    sql = f"SELECT {CELLS}, sum(x) AS total, max(x) AS max_value, count(x) AS n FROM (SELECT *, {expression} AS x FROM {source}) GROUP BY {CELLS}"

    def add(f):
        def run(*dfs):
            return _per_cell(f(*dfs), F.sum(column).alias("total"), F.max(column).alias("max_value"), F.count(column).alias("n"))

        query(name, views, sql, "total max_value")(run)
        return f

    return add


@_total("p5_to_celsius", "wx", "t2m", "t2m - 273.15e0", "wx")
def _(wx):
    return units.convert_temperature(wx, "t2m", "K")


@_total("p6_to_millimetres", "wx", "tp", "tp / 1000 * 1000.0e0", "wx")
def _(wx):
    return units.convert_precipitation(wx.withColumn("tp", F.col("tp") / 1000), "tp", "m")


@_total("p7_wind_speed_from_components", "w", "x", "sqrt(u_wind_10m * u_wind_10m + v_wind_10m * v_wind_10m)")
def _(w):
    return w.withColumn("x", units.wind_speed_from_components(F.col("u_wind_10m"), F.col("v_wind_10m")))


@_total("p8_derive_wind_speeds", "w", "wind_speed_10m", "sqrt(u_wind_10m * u_wind_10m + v_wind_10m * v_wind_10m)")
def _(w):
    return cleaning.derive_wind_speeds(w.drop("wind_speed_10m"))


@_total("p10_extrapolate_to_hub_height", "w", "x", "wind_speed_10m * pow(10.0e0, 0.143e0)")
def _(w):
    return w.withColumn("x", wind.extrapolate_to_hub_height(F.col("wind_speed_10m")))


_CF = "CASE WHEN {w} IS NULL THEN NULL WHEN {w} < 3 OR {w} >= 25 THEN 0.0e0 WHEN {w} >= 12 THEN 1.0e0 ELSE ({w} * {w} * {w} - 27) / (1728 - 27.0e0) END".format(w="wind_speed_10m")


@_total("p11_capacity_factor", "w", "x", _CF)
def _(w):
    return w.withColumn("x", wind.capacity_factor(F.col("wind_speed_10m")))


@_total("p12_power_output", "w", "x", f"3000 * ({_CF})")
def _(w):
    return w.withColumn("x", wind.power_output(F.col("wind_speed_10m")))


_CURVE = _CF.replace("wind_speed_10m", "(floor(wind_speed_10m * 10) / 10.0e0)")


@_total("p13_power_curve", "w", "capacity_factor", f"CASE WHEN wind_speed_10m <= 30.0e0 + 0.1e0 THEN {_CURVE} END", "(SELECT * FROM w WHERE floor(wind_speed_10m * 10) <= 300)")
def _(w):
    curve = wind.power_curve(w.sparkSession).withColumn("tenth", F.round(F.col("wind_speed") * 10).cast("long"))
    return w.withColumn("tenth", F.floor(F.col("wind_speed_10m") * 10)).join(curve, "tenth")


@_total("p14_plane_of_array_ratio", "w", "x", "least(greatest(solar_radiation / 1000.0e0, 0), 1)")
def _(w):
    return w.withColumn("x", solar.plane_of_array_ratio_capacity_factor(F.col("solar_radiation")))


@_total("p17_runoff", "w", "x", "precipitation * 0.4e0")
def _(w):
    return w.withColumn("x", hydro.runoff_from_precipitation(F.col("precipitation")))


@_total("p18_gust_factor", "w2", "x", "CASE WHEN wind_speed_10m > 0 THEN wind_gust_10m / wind_speed_10m END", "w2")
def _(w2):
    return w2.withColumn("x", storms.gust_factor(F.col("wind_gust_10m"), F.col("wind_speed_10m")))


@_total("p19_lapse_rate", "w", "x", "temperature_2m + latitude * 0.0065e0")
def _(w):
    return w.withColumn("x", verification.lapse_rate_adjustment(F.col("temperature_2m"), F.col("latitude")))


@query("p16_snow_rain_partition", "w", f"""
SELECT {CELLS}, sum(precipitation * f) AS snowfall, sum(precipitation - precipitation * f) AS rainfall, avg(f) AS snow_fraction
FROM (SELECT *, least(greatest((2 - temperature_2m) / 2.0e0, 0), 1) AS f FROM w) GROUP BY {CELLS}""", "snowfall rainfall snow_fraction")
def _(w):
    parts = w.withColumns(hydro.snow_rain_partition(F.col("precipitation"), F.col("temperature_2m")))
    return _per_cell(parts, F.sum("snowfall").alias("snowfall"), F.sum("rainfall").alias("rainfall"), F.avg("snow_fraction").alias("snow_fraction"))


@query("p9_normalise_longitude", "pairs", """
SELECT longitude, count(*) AS n FROM (SELECT ((l_orderkey * 7 % 360 + 180.0e0) % 360.0e0) - 180.0e0 AS longitude FROM pairs) GROUP BY longitude""", "longitude")
def _(pairs):
    return cleaning.normalise_longitude(pairs.select((F.col("l_orderkey") * 7 % 360).cast("double").alias("longitude"))).groupBy("longitude").agg(F.count("*").alias("n"))


# --- names and registry: joined to rows, so that the result grows with the tables ------------
@query("p1_rename_to_canonical", "wx", "SELECT product, latitude, longitude, time, t2m AS temperature_2m, tp AS precipitation FROM wx", "temperature_2m precipitation")
def _(wx):
    raw = wx.select("product", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("time").alias("valid_time"), "t2m", "tp")
    out = naming.rename_to_canonical(raw)
    return (out[0] if isinstance(out, tuple) else out).select("product", "latitude", "longitude", "time", "temperature_2m", "precipitation")


@query("p2_find_variable", "wx", "SELECT product, count(t2m) AS n, max(t2m) AS largest FROM wx GROUP BY product", "largest")
def _(wx):
    name = naming.require_variable(wx, "temperature_2m")
    return wx.groupBy("product").agg(F.count(name).alias("n"), F.max(name).alias("largest"))


@query("p3_find_coordinate", "wx", "SELECT product, min(latitude) AS low, max(latitude) AS high FROM wx GROUP BY product", "low high")
def _(wx):
    raw = wx.withColumnRenamed("latitude", "nav_lat")
    name = naming.find_coordinate(raw, "latitude")
    return raw.groupBy("product").agg(F.min(name).alias("low"), F.max(name).alias("high"))


# --- selection and cleaning -------------------------------------------------------------------
@query("f1_subset_spatial", "w", f"SELECT {CELLS}, count(*) AS n FROM w WHERE latitude BETWEEN 44 AND 47 AND longitude BETWEEN 4.2e0 AND 9 GROUP BY {CELLS}")
def _(w):
    return _per_cell(cleaning.subset_spatial(w, cleaning.BoundingBox(4.2, 9.0, 44.0, 47.0)), F.count("*").alias("n"))


@query("f2_subset_temporal", "w", f"SELECT {CELLS}, count(*) AS n, min(time) AS first_time FROM w WHERE time >= TIMESTAMP '2024-01-01' GROUP BY {CELLS}")
def _(w):
    return _per_cell(cleaning.subset_temporal(w, "2024-01-01", None), F.count("*").alias("n"), F.min("time").alias("first_time"))


@query("f3_quality_control", "w", f"""
SELECT {CELLS}, count(CASE WHEN t BETWEEN -90 AND 60 THEN t END) AS n_temperature, count(CASE WHEN s BETWEEN 0 AND 1500 THEN s END) AS n_solar
FROM (SELECT *, temperature_2m * 4 AS t, solar_radiation * 2 AS s FROM w) GROUP BY {CELLS}""")
def _(w):
    raw = w.withColumns({"temperature_2m": F.col("temperature_2m") * 4, "solar_radiation": F.col("solar_radiation") * 2})
    return _per_cell(cleaning.apply_quality_control(raw), F.count("temperature_2m").alias("n_temperature"), F.count("solar_radiation").alias("n_solar"))


@query("f4_remove_duplicate_times", "wx_dup", f"SELECT {CELLS}, count(DISTINCT time) AS n, CAST(0 AS BIGINT) AS late FROM wx_dup GROUP BY {CELLS}")
def _(wx_dup):
    return _per_cell(cleaning.remove_duplicate_times(wx_dup), F.count("*").alias("n"), F.sum("ingest_seq").cast("long").alias("late"))


@query("f4_duplicate_times", "wx_dup", f"SELECT {CELLS}, count(*) - count(DISTINCT time) AS duplicate_times_removed FROM wx_dup GROUP BY {CELLS}")
def _(wx_dup):
    return cleaning.duplicate_times(wx_dup)


@query("f5_control_member", "w", f"SELECT {CELLS}, count(*) AS n FROM w WHERE hour(time) % 3 = 0 GROUP BY {CELLS}")
def _(w):
    return _per_cell(cleaning.control_member(w.withColumn("number", F.hour("time") % 3)), F.count("*").alias("n"))


@query("f6_valid_pairs", "pairs", "SELECT station_id, count(*) AS n FROM pairs WHERE observed IS NOT NULL AND modelled IS NOT NULL GROUP BY station_id")
def _(pairs):
    return pairs.where(metrics.valid_pair(F.col("observed"), F.col("modelled"))).groupBy("station_id").agg(F.count("*").alias("n"))


@query("s2_combine", "w w2", f"SELECT {CELLS}, count(*) AS n FROM (SELECT {CELLS} FROM w UNION ALL SELECT {CELLS} FROM w2) GROUP BY {CELLS}")
def _(w, w2):
    from aeolia.sources.tables import combine

    return _per_cell(combine(w, w2), F.count("*").alias("n"))


# --- time steps, accumulation, runs ---------------------------------------------------------------
@query("w1_to_rate", "wx_block", f"SELECT {CELLS}, time, ssrd_true / 3600.0e0 AS ssrd FROM wx_block", "ssrd")
def _(wx_block):
    out = accumulation.to_rate(wx_block, "ssrd", "running", timestep_seconds=3600.0, reset_hours=3, reset_offset=1)
    return out.select("product", "latitude", "longitude", "time", "ssrd")


@query("w3_timestep_report", "w2", """
SELECT product, count(*) AS n_steps, min(d) / 3600.0e0 AS min_hours, max(d) / 3600.0e0 AS max_hours, CAST(median(d) AS DOUBLE) AS median_seconds
FROM (SELECT product, time, epoch(time) - epoch(lag(time) OVER (PARTITION BY product ORDER BY time)) AS d FROM (SELECT DISTINCT product, time FROM w2)) GROUP BY product""", "min_hours max_hours median_seconds")
def _(w2):
    return timeline.timestep_report(w2)


@query("w4_ramp_magnitude", "w", f"SELECT {CELLS}, time, wind_speed_10m - lag(wind_speed_10m, 3) OVER (PARTITION BY {CELLS} ORDER BY time) AS wind_ramp FROM w", "wind_ramp")
def _(w):
    return storms.ramp_magnitude(w, **HOUR).select("product", "latitude", "longitude", "time", "wind_ramp")


def _runs(condition: str, source: str, keys: str = CELLS) -> str:
    """Runs of consecutive hours under a condition: keys, n, first time."""
    return f"""SELECT {keys}, count(*) AS n, min(time) AS first_time FROM (
SELECT {keys}, time, time - row_number() OVER (PARTITION BY {keys} ORDER BY time) * INTERVAL '1' HOUR AS run FROM {source} WHERE {condition}) GROUP BY {keys}, run"""


def _stats(condition: str, need: int, source: str = "w", keys: str = CELLS) -> str:
    on = ", ".join(f"c.{k} = r.{k}" for k in keys.split(", ")).replace(", ", " AND ")
    cols = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""SELECT {cols}, CAST(count(r.n) AS BIGINT) AS event_count, CAST(coalesce(sum(r.n), 0) AS DOUBLE) AS total_hours,
coalesce(sum(r.n), 0) / any_value(c.steps) AS frequency, CAST(coalesce(max(r.n), 0) AS DOUBLE) AS longest_event_hours
FROM (SELECT {keys}, CAST(count(*) AS DOUBLE) AS steps FROM {source} GROUP BY {keys}) AS c
LEFT JOIN (SELECT * FROM ({_runs(condition, source, keys)}) WHERE n >= {need}) AS r ON {on} GROUP BY {cols}"""


_STATS = "total_hours frequency longest_event_hours"
_LOW = "wind_speed_10m < 3 AND solar_radiation < 100"


@query("w5_sustained", "w", f"SELECT {CELLS}, CAST(coalesce(sum(CASE WHEN n >= 6 THEN n END), 0) AS BIGINT) AS steps FROM ({_runs('wind_speed_10m < 3', 'w')}) GROUP BY {CELLS}")
def _(w):
    return _per_cell(runs.sustained(w, F.col("wind_speed_10m") < 3, min_duration_hours=6, **HOUR), F.count_if("sustained").alias("steps"))


@query("w6_run_totals", "w", f"SELECT {CELLS}, count(*) AS runs, CAST(sum(n) AS BIGINT) AS steps, max(n) AS longest FROM ({_runs('wind_speed_10m < 3', 'w')}) GROUP BY {CELLS}")
def _(w):
    return runs.run_totals(w, F.col("wind_speed_10m") < 3, **HOUR).select("product", "latitude", "longitude", *(F.col(c).cast("long").alias(c) for c in ("runs", "steps", "longest")))


@query("a16_event_statistics", "w", _stats("wind_speed_10m >= 15", 1), _STATS)
def _(w):
    return runs.event_statistics(w, F.col("wind_speed_10m") >= 15, **HOUR)


@query("w2_accumulation_kinds", "wx_block", """
, p AS (SELECT product, time, avg(ssrd) AS m, sum(ssrd) AS s, count(ssrd) AS n FROM wx_block GROUP BY product, time),
c AS (SELECT *, m - lag(m) OVER (PARTITION BY product ORDER BY time) AS d FROM p)
SELECT product, sum(s) / sum(n) AS sample_mean, count(*) AS n_steps, count(*) FILTER (d < 0) / CAST(count(*) FILTER (d <> 0) AS DOUBLE) AS decreasing_share,
CASE WHEN sum(s) / sum(n) < 1500 THEN 'instantaneous' WHEN count(*) < 3 THEN NULL WHEN count(*) FILTER (d < 0) / CAST(count(*) FILTER (d <> 0) AS DOUBLE) <= 0.15 THEN 'running'
WHEN count(*) FILTER (d < 0) / CAST(count(*) FILTER (d <> 0) AS DOUBLE) >= 0.35 THEN 'period' END AS kind FROM c GROUP BY product""", "sample_mean decreasing_share")
def _(wx_block):
    return accumulation.accumulation_kinds(wx_block, "ssrd")


# --- days -----------------------------------------------------------------------------------------------
_DAYS = f"(SELECT {CELLS}, CAST(time AS DATE) AS day, avg(temperature_2m) AS t_mean, max(temperature_2m) AS t_max, min(temperature_2m) AS t_min, max(wind_speed_10m) AS u_max, avg(wind_speed_10m) AS u_mean, sum(precipitation) AS rain FROM w GROUP BY ALL)"
_HDD, _CDD = "sum(greatest(15.0e0 - t_mean, 0))", "sum(greatest(t_mean - 18.0e0, 0))"


@query("a1_daily", "w", f"SELECT {CELLS}, CAST(day AS VARCHAR) AS day, t_mean, t_max, u_max FROM {_DAYS}", "t_mean t_max u_max")
def _(w):
    return daily.daily(w, {"t_mean": F.avg("temperature_2m"), "t_max": F.max("temperature_2m"), "u_max": F.max("wind_speed_10m")}).withColumn("day", F.col("day").cast("string"))


@query("a2_daily_mean_temperature", "w", f"SELECT {CELLS}, CAST(day AS VARCHAR) AS day, t_mean AS temperature_2m FROM {_DAYS}", "temperature_2m")
def _(w):
    return daily.daily_mean_temperature(w, assume="degC").withColumn("day", F.col("day").cast("string"))


@query("a3_heating_degree_days", "w", f"SELECT {CELLS}, {_HDD} AS hdd FROM {_DAYS} GROUP BY {CELLS}", "hdd")
def _(w):
    return daily.heating_degree_days(w, assume="degC")


@query("a3_heating_degree_days_monthly", "daily", f"SELECT {CELLS}, CAST(last_day(CAST(time AS DATE)) AS VARCHAR) AS period, sum(greatest(15.0e0 - temperature_2m, 0)) AS hdd FROM daily GROUP BY ALL", "hdd")
def _(d):
    return daily.heating_degree_days(d, freq="month", already_daily=True, assume="degC").withColumn("period", F.col("period").cast("string"))


@query("a4_cooling_degree_days", "w", f"SELECT {CELLS}, {_CDD} AS cdd FROM {_DAYS} GROUP BY {CELLS}", "cdd")
def _(w):
    return daily.cooling_degree_days(w, assume="degC")


@query("a5_degree_days", "w", f"SELECT {CELLS}, {_HDD} AS hdd, {_CDD} AS cdd FROM {_DAYS} GROUP BY {CELLS}", "hdd cdd")
def _(w):
    return daily.degree_days(w, assume="degC")


@query("a6_exceedance_days", "w", f"SELECT {CELLS}, count(*) FILTER (t_min < 10) AS exceedance_days FROM {_DAYS} GROUP BY {CELLS}")
def _(w):
    return daily.exceedance_days(w, "temperature_2m", 10.0, statistic="min", below=True)


@query("a8_hot_days", "w", f"SELECT {CELLS}, count(*) FILTER (t_max >= 30) AS hot_days FROM {_DAYS} GROUP BY {CELLS}")
def _(w):
    return daily.hot_days(w, assume="degC")


@query("a10_storm_days", "w", f"SELECT {CELLS}, count(*) FILTER (u_max >= 15) AS storm_days FROM {_DAYS} GROUP BY {CELLS}")
def _(w):
    return daily.storm_days(w)


@query("a10_storm_days_by_mean", "w", f"SELECT {CELLS}, count(*) FILTER (u_mean >= 10) AS storm_days FROM {_DAYS} GROUP BY {CELLS}")
def _(w):
    return daily.storm_days(w, threshold=10.0, reduction="daily_mean")


# --- hours, ramps, gusts -------------------------------------------------------------------------------------
@query("a7_exceedance_hours", "w", f"SELECT {CELLS}, CAST(count(*) FILTER (wind_speed_10m >= 12) AS DOUBLE) AS exceedance_hours FROM w GROUP BY {CELLS}", "exceedance_hours")
def _(w):
    return storms.exceedance_hours(w, "wind_speed_10m", 12.0, **HOUR)


_CLASSES = (("high_wind", 10.0), ("strong_wind", 12.5), ("severe_storm", 15.0), ("extreme_storm", 17.5))
_STORM = ", ".join(f"count(*) FILTER (wind_speed_10m >= {t}e0) * {{dt}} AS {n}_hours, count(*) FILTER (wind_speed_10m >= {t}e0) / CAST(count(*) AS DOUBLE) AS {n}_fraction" for n, t in _CLASSES)
_STORM_COLUMNS = " ".join(f"{n}_hours {n}_fraction" for n, _ in _CLASSES)


@query("a9_storm_hours", "w", f"SELECT {CELLS}, {_STORM.format(dt='1.0e0')} FROM w GROUP BY {CELLS}", _STORM_COLUMNS)
def _(w):
    return storms.storm_hours(w, **HOUR)


_RAMPS = (("minor", 3), ("moderate", 5), ("severe", 7), ("extreme", 10))
_RAMP = ", ".join(f"count(*) FILTER (d >= {t}) AS {n}_up_count, count(*) FILTER (d <= -{t}) AS {n}_down_count" for n, t in _RAMPS)


@query("a11_wind_ramps", "w", f"SELECT {CELLS}, {_RAMP}, max(d) AS max_ramp_up, min(d) AS max_ramp_down FROM (SELECT *, wind_speed_10m - lag(wind_speed_10m, 3) OVER (PARTITION BY {CELLS} ORDER BY time) AS d FROM w) GROUP BY {CELLS}", "max_ramp_up max_ramp_down")
def _(w):
    return storms.wind_ramps(w, **HOUR)


_GUST = "CASE WHEN g < wind_speed_10m THEN wind_speed_10m * 1.25e0 ELSE g END"
_SIGMA = f"(SELECT *, wind_speed_10m + 1.9e0 * stddev_pop(wind_speed_10m) OVER (PARTITION BY {CELLS}) AS g FROM {{}})"


@query("a13_estimate_gusts", "w", f"SELECT {CELLS}, avg({_GUST}) AS mean_gust, max({_GUST}) AS max_gust FROM {_SIGMA.format('w')} GROUP BY {CELLS}", "mean_gust max_gust")
def _(w):
    return _per_cell(storms.estimate_gusts(w), F.avg("gust").alias("mean_gust"), F.max("gust").alias("max_gust"))


@query("a14_resolve_gusts", "w2", f"""
SELECT {CELLS}, CASE WHEN product = 'synthetic' THEN 'native' ELSE 'estimated' END AS gust_source, count(x) AS n, avg(x) AS mean_gust
FROM (SELECT *, CASE WHEN product = 'synthetic' THEN wind_gust_10m ELSE {_GUST} END AS x FROM {_SIGMA.format('w2')}) GROUP BY {CELLS}""", "mean_gust")
def _(w2):
    return storms.resolve_gusts(w2).groupBy("product", "latitude", "longitude", "gust_source").agg(F.count("gust").alias("n"), F.avg("gust").alias("mean_gust"))


@query("a12_gust_severity", "w", f"SELECT {CELLS}, count(*) FILTER (gust >= 25) * 1.0e0 AS severe_hours, count(*) FILTER (gust >= 32.7e0) * 1.0e0 AS extreme_hours, max(gust) AS max_gust, 'unknown' AS gust_source FROM (SELECT *, wind_speed_10m * 1.5e0 AS gust FROM w) GROUP BY {CELLS}", "severe_hours extreme_hours max_gust")
def _(w):
    return storms.classify_gust_severity(w.withColumn("gust", F.col("wind_speed_10m") * 1.5), **HOUR)


@query("a20_forecast_maxima", "w2", f"SELECT {CELLS}, max(wind_gust_10m) AS max_gust, max(wind_speed_10m) AS max_wind FROM w2 GROUP BY {CELLS}", "max_gust max_wind")
def _(w2):
    return storms.forecast_maxima(w2)


# --- water, domain, limits -----------------------------------------------------------------------------------------
@query("a17_domain_mean", "w", "SELECT product, time, avg(wind_speed_10m) AS wind_speed_10m, avg(temperature_2m) AS temperature_2m FROM w GROUP BY product, time", "wind_speed_10m temperature_2m")
def _(w):
    return events.domain_mean(w, "wind_speed_10m", "temperature_2m")


@query("a18_annual_precipitation", "w", f"SELECT {CELLS}, sum(precipitation) * (8766.0e0 / count(*)) AS annual_precipitation FROM w GROUP BY {CELLS}", "annual_precipitation")
def _(w):
    return water.annual_precipitation(w, **HOUR)


@query("a19_seasonal_totals", "daily", f"""
SELECT {CELLS}, CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) IN (3, 4, 5) THEN 'MAM' WHEN month(time) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season,
sum(precipitation) AS precipitation FROM daily GROUP BY ALL""", "precipitation")
def _(d):
    return water.seasonal_totals(d, "precipitation")


@query("a21_shared_limits", "w", "SELECT min(x) AS vmin, quantile_cont(x, 0.99) AS vmax FROM (SELECT wind_speed_10m AS x FROM w UNION ALL SELECT temperature_2m FROM w)", "vmin vmax")
def _(w):
    return limits.shared_limits([(w, "wind_speed_10m"), (w, "temperature_2m")])


@query("a22_symmetric_limits", "w", "SELECT -q AS vmin, q AS vmax FROM (SELECT quantile_cont(abs(temperature_2m), 0.99) AS q FROM w)", "vmin vmax")
def _(w):
    return limits.symmetric_limits([(w, "temperature_2m")])


# --- events ---------------------------------------------------------------------------------------------------------------
@query("e1_detect", "w", _stats(f"({_CF}) < 0.1e0 AND solar_radiation / 1000.0e0 < 0.05e0", 12), _STATS)
def _(w):
    rows = w.withColumns({"wind_capacity_factor": wind.capacity_factor(F.col("wind_speed_10m")), "solar_capacity_factor": F.col("solar_radiation") / 1000.0})
    return events.detect(rows, min_duration_hours=12, **HOUR).stats


@query("e2_detect_from_raw", "w", _stats(_LOW, 48), _STATS)
def _(w):
    return events.detect_from_raw(w, **HOUR).stats


@query("e2_mask", "w", f"SELECT {CELLS}, CAST(coalesce(sum(CASE WHEN n >= 48 THEN n END), 0) AS BIGINT) AS steps FROM ({_runs(_LOW, 'w')}) GROUP BY {CELLS}")
def _(w):
    return _per_cell(events.detect_from_raw(w, **HOUR).mask, F.count_if("dunkelflaute").alias("steps"))


@query("e3_cold_mask", "w", f"""
SELECT w.product, w.latitude, w.longitude, count(*) FILTER (r.n >= 48 AND temperature_2m < 8) AS steps FROM w
LEFT JOIN (SELECT *, first_time + (n - 1) * INTERVAL '1' HOUR AS last_time FROM ({_runs(_LOW, 'w')})) AS r
ON w.product = r.product AND w.latitude = r.latitude AND w.longitude = r.longitude AND w.time BETWEEN r.first_time AND r.last_time GROUP BY ALL""")
def _(w):
    return _per_cell(events.detect_from_raw(w, temperature="temperature_2m", cold_threshold=8.0, **HOUR).mask, F.count_if("cold_dunkelflaute").alias("steps"))


@query("e4_combine_conditions", "w", _stats("wind_speed_10m > 8 AND temperature_2m > 12", 3), _STATS)
def _(w):
    return events.combine_conditions(w, "both", {"windy": F.col("wind_speed_10m") > 8, "warm": F.col("temperature_2m") > 12}, min_duration_hours=3, **HOUR).stats


@query("e5_hellsturm", "w", _stats("wind_speed_10m > 12 AND solar_radiation > 500", 1), _STATS)
def _(w):
    return events.hellsturm(w, **HOUR).stats


@query("e6_heat_drought", "w", f"""
WITH d AS (SELECT {CELLS}, CAST(day AS TIMESTAMP) AS time, t_mean, rain FROM {_DAYS}),
r AS (SELECT {CELLS}, count(*) AS n FROM (SELECT *, day_number - row_number() OVER (PARTITION BY {CELLS} ORDER BY day_number) AS run
  FROM (SELECT *, date_diff('day', TIMESTAMP '1970-01-01', time) AS day_number FROM d WHERE t_mean > 15 AND rain < 15)) GROUP BY {CELLS}, run)
SELECT c.product, c.latitude, c.longitude, CAST(count(r.n) AS BIGINT) AS event_count, coalesce(sum(r.n), 0) * 24.0e0 AS total_hours,
coalesce(sum(r.n), 0) / any_value(c.steps) AS frequency, coalesce(max(r.n), 0) * 24.0e0 AS longest_event_hours
FROM (SELECT {CELLS}, CAST(count(*) AS DOUBLE) AS steps FROM d GROUP BY {CELLS}) AS c LEFT JOIN r USING ({CELLS}) GROUP BY ALL""", _STATS)
def _(w):
    return events.heat_drought(w, temperature_threshold=15.0, precipitation_threshold=15.0).stats


@query("e7_rain_on_snow", "w", _stats("temperature_2m > 0 AND temperature_2m < 5 AND precipitation > 2", 1), _STATS)
def _(w):
    return events.rain_on_snow(w, **HOUR).stats


@query("e8_foehn_like", "w", f"WITH f AS (SELECT *, temperature_2m - lag(temperature_2m, 3) OVER (PARTITION BY {CELLS} ORDER BY time) AS warming FROM w) {_stats('wind_speed_10m > 10 AND warming > 1.5e0', 1, 'f')}", _STATS)
def _(w):
    return events.foehn_like(w, warming_threshold=1.5, **HOUR).stats


_SWEEP = " UNION ALL ".join(
    f"SELECT product, {t}e0 AS wind_threshold, {d}e0 AS min_duration_hours, CAST(count(*) FILTER (n >= {d}) AS BIGINT) AS events, CAST(coalesce(sum(n) FILTER (n >= {d}), 0) AS DOUBLE) AS hours "
    f"FROM (SELECT DISTINCT product FROM w) LEFT JOIN ({_runs(f'wind_speed_10m < {t} AND solar_radiation < 100', 'w')}) USING (product) GROUP BY product"
    for t in (-1.0, 2.0, 3.0) for d in (24, 48)
)


@query("e9_sensitivity_sweep", "w", _SWEEP, "hours wind_threshold min_duration_hours")
def _(w):
    return events.sensitivity_sweep(w, "wind_speed_10m", "solar_radiation", [-1.0, 2.0, 3.0], [24, 48], solar_threshold=100.0, **HOUR)


# --- exposure and verification -----------------------------------------------------------------------------------------------
@query("j1_match_stations", "stations w", """
, a AS (SELECT DISTINCT latitude FROM w), b AS (SELECT DISTINCT longitude FROM w),
x AS (SELECT station_id, arg_min(latitude, (abs(latitude - lat), latitude)) AS grid_lat FROM stations, a GROUP BY station_id),
y AS (SELECT station_id, arg_min(longitude, (abs(longitude - lon), longitude)) AS grid_lon FROM stations, b GROUP BY station_id)
SELECT station_id, grid_lat, grid_lon FROM x JOIN y USING (station_id)""", "grid_lat grid_lon")
def _(stations, w):
    grid = w.select("latitude", "longitude").distinct()
    return verification.match_stations_to_grid(grid, stations).select("station_id", "grid_lat", "grid_lon")


@query("j7_population_weighted_mean", "w people", """
SELECT product, time, coalesce(sum(temperature_2m * population), 0) / (SELECT sum(population) FROM people) AS temperature_2m_population_weighted
FROM w JOIN people USING (latitude, longitude) GROUP BY product, time""", "temperature_2m_population_weighted")
def _(w, people):
    return exposure.population_weighted_mean(w, "temperature_2m", people)


@query("j8_person_days", "w people", "SELECT product, sum(population) / 24.0e0 AS person_days FROM w JOIN people USING (latitude, longitude) WHERE wind_speed_10m >= 15 GROUP BY product", "person_days")
def _(w, people):
    return exposure.person_days(w, F.col("wind_speed_10m") >= 15, people, hours_per_step=1.0)


@query("j5_population_to_grid", "population targets", """
SELECT t.latitude, t.longitude, coalesce(sum(p.population), 0.0e0) AS population FROM targets AS t
LEFT JOIN population AS p ON round(p.latitude * 1000) >= round(t.latitude * 1000) - 250 AND (round(p.latitude * 1000) < round(t.latitude * 1000) + 250 OR (t.latitude = (SELECT max(latitude) FROM targets) AND round(p.latitude * 1000) = round(t.latitude * 1000) + 250))
AND round(p.longitude * 1000) >= round(t.longitude * 1000) - 250 AND (round(p.longitude * 1000) < round(t.longitude * 1000) + 250 OR (t.longitude = (SELECT max(longitude) FROM targets) AND round(p.longitude * 1000) = round(t.longitude * 1000) + 250))
GROUP BY t.latitude, t.longitude""", "population")
def _(population, targets):
    return exposure.aggregate_population_to_grid(population, targets)


@query("j2_extract_at_stations", "stations w", """
, a AS (SELECT DISTINCT latitude FROM w), b AS (SELECT DISTINCT longitude FROM w),
x AS (SELECT station_id, arg_min(latitude, (abs(latitude - lat), latitude)) AS grid_lat FROM stations, a GROUP BY station_id),
y AS (SELECT station_id, arg_min(longitude, (abs(longitude - lon), longitude)) AS grid_lon FROM stations, b GROUP BY station_id)
SELECT station_id, count(*) AS n, avg(temperature_2m) AS mean_value FROM x JOIN y USING (station_id) JOIN w ON latitude = grid_lat AND longitude = grid_lon GROUP BY station_id""", "mean_value")
def _(stations, w):
    matched = verification.match_stations_to_grid(w.select("latitude", "longitude").distinct(), stations)
    found = verification.extract_at_stations(w, "temperature_2m", matched, station_id="station_id")
    return found.groupBy("station_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query("j3_station_metadata", "pairs stations", "SELECT station_id, lat AS latitude, alt AS elevation FROM stations WHERE station_id IN (SELECT station_id FROM pairs)", "latitude elevation")
def _(pairs, stations):
    merged = pairs.join(stations, "station_id")
    return verification.station_metadata(merged, {"lat": "latitude", "alt": "elevation"})


@query("j4_pair_with_observations", "pairs", """
SELECT a.station_id, count(*) AS n, avg(a.modelled) AS mean_modelled, avg(b.observed) AS mean_observed FROM pairs AS a
JOIN pairs AS b ON a.station_id = b.station_id AND a.l_orderkey * 10 + a.l_linenumber = b.l_orderkey * 10 + b.l_linenumber WHERE b.l_linenumber <> 3 GROUP BY a.station_id""", "mean_modelled mean_observed")
def _(pairs):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    modelled = pairs.select("station_id", key.alias("time"), F.col("modelled").alias("value"))
    observed = pairs.where("l_linenumber <> 3").select("station_id", key.alias("time"), F.col("observed").alias("value"))
    both = verification.pair_with_observations(modelled, observed)
    return both.groupBy("station_id").agg(F.count("*").alias("n"), F.avg("modelled").alias("mean_modelled"), F.avg("observed").alias("mean_observed"))


@query("a15_threshold_catalogue", "w", " UNION ALL ".join(f"SELECT '{n}' AS class, {t}e0 AS threshold, count(*) FILTER (wind_speed_10m >= {t}e0) AS n FROM w" for n, t in (("high_wind", 10.0), ("strong_wind", 12.5), ("severe_storm", 15.0), ("extreme_storm", 17.5))), "threshold")
def _(w):
    from aeolia.fixed_values import ALPINE_STORM_THRESHOLDS

    return storms.threshold_counts(w, "wind_speed_10m", ALPINE_STORM_THRESHOLDS)


@query("s6_registry_facts", "events", "SELECT 'era5' AS product, 1.0e0 AS timestep_hours, count(*) AS n FROM events", "timestep_hours")
def _(ev):
    facts = registry.registry_table(ev.sparkSession).select("product", "timestep_hours")
    return ev.withColumn("product", F.lit("era5")).join(facts, "product").groupBy("product", "timestep_hours").agg(F.count("*").alias("n"))


_V = """count(*) * 1.0e0 AS n_pairs, avg(m - o) AS bias, sqrt(avg((m - o) * (m - o))) AS rmse, avg(abs(m - o)) AS mae,
CASE WHEN stddev_pop(o) > 0 AND stddev_pop(m) > 0 AND count(*) >= 2 THEN covar_pop(o, m) / (stddev_pop(o) * stddev_pop(m)) END AS correlation, avg(o) AS obs_mean, avg(m) AS model_mean,
stddev_pop(o) AS obs_std, stddev_pop(m) AS model_std, CASE WHEN stddev_pop(o) > 0 AND count(*) >= 2 THEN stddev_pop(m) / stddev_pop(o) END AS std_ratio"""
_VALID = "(SELECT station_id, observed AS o, modelled AS m FROM pairs WHERE observed IS NOT NULL AND modelled IS NOT NULL)"
_VCOLS = "n_pairs bias rmse mae correlation obs_mean model_mean obs_std model_std std_ratio"


def _metric(name: str, f, expression: str):
    @query(name, "pairs", f"SELECT station_id, {expression} AS value FROM {_VALID} GROUP BY station_id", "value")
    def _(pairs):
        o, m = F.col("observed"), F.col("modelled")
        return pairs.where(metrics.valid_pair(o, m)).groupBy("station_id").agg(f(o, m).alias("value"))


_R = "CASE WHEN stddev_pop(o) > 0 AND stddev_pop(m) > 0 AND count(*) >= 2 THEN covar_pop(o, m) / (stddev_pop(o) * stddev_pop(m)) END"
_A = "CASE WHEN stddev_pop(o) > 0 AND count(*) >= 2 THEN stddev_pop(m) / stddev_pop(o) END"
_metric("v1_bias", metrics.bias, "avg(m - o)")
_metric("v2_rmse", metrics.root_mean_square_error, "sqrt(avg((m - o) * (m - o)))")
_metric("v3_mae", metrics.mean_absolute_error, "avg(abs(m - o))")
_metric("v4_correlation", metrics.correlation, _R)
_metric("v5_standard_deviation_ratio", metrics.standard_deviation_ratio, _A)
_metric("v6_kling_gupta", metrics.kling_gupta_efficiency, f"1 - sqrt(pow({_R} - 1, 2) + pow({_A} - 1, 2) + pow(avg(m) / avg(o) - 1, 2))")


@query("v7_verification_metrics", "pairs", f"SELECT 1 AS one, {_V} FROM {_VALID}", _VCOLS)
def _(pairs):
    o, m = F.col("observed"), F.col("modelled")
    return pairs.where(metrics.valid_pair(o, m)).groupBy(F.lit(1).alias("one")).agg(*metrics.verification_metrics(o, m))


@query("v8_station_metrics", "pairs", f"SELECT station_id, {_V} FROM {_VALID} GROUP BY station_id HAVING count(*) >= 100", _VCOLS)
def _(pairs):
    return verification.station_metrics(pairs)


@query("v8_station_exclusions", "pairs", "SELECT count(*) AS stations_total, count(*) FILTER (n < 520) AS stations_excluded FROM (SELECT station_id, count(observed) AS n FROM pairs GROUP BY station_id)")
def _(pairs):
    return verification.station_exclusions(pairs, minimum_pairs=520)


_BANDS = ((0, 500), (500, 1000), (1000, 1500), (1500, 2500), (2500, 4000))
_BAND_ROWS = ", ".join(f"('{a}-{b} m', {a}, {b})" for a, b in _BANDS)


@query("v9_elevation_bands", "pairs stations", f"""
, s AS (SELECT station_id, {_V} FROM {_VALID} GROUP BY station_id HAVING count(*) >= 100)
SELECT b.name AS elevation_band, count(alt) AS n_stations, avg(bias) AS bias, avg(rmse) AS rmse, avg(correlation) AS correlation
FROM (VALUES {_BAND_ROWS}) AS b(name, low, high) LEFT JOIN (SELECT * FROM s JOIN stations USING (station_id)) ON (alt > low OR (alt = 0 AND low = 0)) AND alt <= high GROUP BY b.name""", "bias rmse correlation")
def _(pairs, stations):
    per_station = verification.station_metrics(pairs).join(stations, "station_id")
    return verification.elevation_band_metrics(per_station)


# --- jobs --------------------------------------------------------------------------------------------------------------------------
_B2 = f"SELECT {CELLS}, count(*) FILTER (t_max >= 15) AS hot_days, sum(greatest(t_mean - 12.0e0, 0)) AS cdd, count(*) FILTER (u_max >= 17.5e0) AS storm_days FROM {_DAYS} GROUP BY {CELLS}"


@query("b2_reanalysis_comparison", "w", _B2, "cdd")
def reanalysis_comparison(w):
    return jobs.reanalysis_comparison(w, hot_day_threshold=15.0, cdd_base=12.0)


@query("b3_storm_case_study", "w2", f"SELECT {CELLS}, max(wind_gust_10m) AS max_gust, max(wind_speed_10m) AS max_wind FROM w2 GROUP BY {CELLS}", "max_gust max_wind")
def _(w2):
    one = w2.where("product = 'synthetic'").select("product", "latitude", "longitude", "time", "wind_speed_10m", "wind_gust_10m")
    two = w2.where("product = 'six_hourly'").select("product", "latitude", "longitude", "time", "wind_speed_10m")
    return jobs.storm_case_study(one, two)


@query("b4_winter_projection", "w2", f"""
SELECT {CELLS}, {_HDD} AS hdd, CAST(sum(strong) AS DOUBLE) AS storm_hours, CASE WHEN product = 'synthetic' THEN 'native' ELSE 'extrapolated' END AS hub_wind_source
FROM (SELECT {CELLS}, CAST(time AS DATE) AS day, avg(temperature_2m) AS t_mean, count(*) FILTER (coalesce(wind_speed_100m, CASE WHEN product <> 'synthetic' THEN wind_speed_10m * pow(10.0e0, 0.143e0) END) >= 15) AS strong FROM w2 GROUP BY ALL) GROUP BY {CELLS}""", "hdd storm_hours")
def _(w2):
    return jobs.winter_projection(w2)
