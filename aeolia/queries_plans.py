"""Queries of sources, sinks, whole plans and streams, and the SQL that states the same.

Queries that write use a new folder under ``spark.checkpoint.dir`` each time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia import streaming
from aeolia.fixed_values import ALPINE_STORM_THRESHOLDS
from aeolia.fixtures import view
from aeolia.functions import solar
from aeolia.operators import cleaning, events, exposure, naming
from aeolia.operators.runs import run_totals
from aeolia.plans import jobs, standardise
from aeolia.queries import _BAND_ROWS, _CLASSES, _LOW, _V, _VCOLS, CELLS, HOUR, ORACLES, QUERIES, _per_cell, _runs, _stats, query
from aeolia.sources import registry, tables
from aeolia.sources.scratch import scratch_folder

__all__ = ["ORACLES", "QUERIES"]

BOX = cleaning.BoundingBox(3.9, 9.0, 44.0, 47.0)
CHOICES = {"domain": BOX, "start": "2024-01-05", "end": "2024-01-19", "temperature_unit": "K", "precipitation_unit": "mm"}
_SUBSET = "latitude BETWEEN 44 AND 47 AND longitude BETWEEN 3.9e0 AND 9 AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-20'"
_BAD = "cell_id % 7 = 0 AND hour(time) = 5"
_ARA = f"""SELECT 'ara' AS product, time, latitude, longitude, CASE WHEN {_BAD} THEN NULL ELSE t2m - 273.15e0 END AS temperature_2m, wind_speed_10m,
  0.6e0 * wind_speed_10m AS u_wind_10m, ssrd / 3600.0e0 AS solar_radiation, tp AS precipitation FROM wx WHERE {_SUBSET}"""
_STD = "temperature_2m wind_speed_10m u_wind_10m solar_radiation precipitation"


def _deliveries(raw: DataFrame) -> list[str]:
    """Two deliveries of files, of which the later one repeats the first hours of the earlier."""
    folder = scratch_folder(raw.sparkSession)
    paths = [f"{folder}/m{k}" for k in (0, 1)]
    for k, path in enumerate(paths):
        raw.where(F.col("ingest_seq") == k).drop("ingest_seq").write.parquet(path)
    return paths


@query("b1_standardise", "ara_raw wx", f"SELECT * FROM ({_ARA})", _STD)
def _(ara_raw, wx):
    out = standardise.standardise(ara_raw, "ara", keep_unknown=False, **CHOICES)
    return out.select("product", "time", "latitude", "longitude", *_STD.split())


@query("s1_open_product", "ara_raw wx", f"SELECT {CELLS}, count(*) AS n, sum(temperature_2m) AS temperature, max(wind_speed_10m) AS wind, sum(solar_radiation) AS solar, sum(precipitation) AS rain FROM ({_ARA}) GROUP BY {CELLS}", "temperature wind solar rain")
def _(ara_raw, wx):
    out = standardise.open_product(ara_raw.sparkSession, _deliveries(ara_raw), "ara", keep_unknown=False, **CHOICES)
    return _per_cell(out, F.count("*").alias("n"), F.sum("temperature_2m").alias("temperature"), F.max("wind_speed_10m").alias("wind"), F.sum("solar_radiation").alias("solar"), F.sum("precipitation").alias("rain"))


def _batch(ara_raw: DataFrame, era5_raw: DataFrame, table: str | None = None) -> tuple[DataFrame, str]:
    """Both products standardised and written, then one of them again for fewer days."""
    spark, output = ara_raw.sparkSession, scratch_folder(ara_raw.sparkSession)
    era5 = f"{output}-raw"
    era5_raw.drop("ingest_seq").write.parquet(era5)
    choices = {k: CHOICES[k] for k in ("temperature_unit", "precipitation_unit")}
    both = [jobs.ProductSource("ara", tuple(_deliveries(ara_raw)), choices=choices), jobs.ProductSource("era5", (era5,), choices={"temperature_unit": "K", "precipitation_unit": "m"})]
    notes = jobs.standardise_all(spark, both, output, domain=BOX, start="2024-01-05", end="2024-01-19", table=table, buckets=16)
    jobs.standardise_all(spark, both[1:], output, domain=BOX, start="2024-01-05", end="2024-01-09", table=table, buckets=16)
    return notes, output


_WRITTEN = f"""SELECT product, CAST(2024 AS INTEGER) AS year, count(*) AS n, count(temperature_2m) AS temperatures, sum(solar_radiation) AS solar FROM (
SELECT product, temperature_2m, solar_radiation FROM ({_ARA})
UNION ALL SELECT 'era5', t2m - 273.15e0, ssrd / 3600.0e0 FROM wx WHERE {_SUBSET} AND time < TIMESTAMP '2024-01-10') GROUP BY product"""


def _read_back(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product", "year").agg(F.count("*").alias("n"), F.count("temperature_2m").alias("temperatures"), F.sum("solar_radiation").alias("solar"))


@query("s3_write_product", "ara_raw era5_raw wx", _WRITTEN, "solar")
def _(ara_raw, era5_raw, wx):
    _, output = _batch(ara_raw, era5_raw)
    return _read_back(ara_raw.sparkSession.read.parquet(output))


_JSON = "'{{\"' || '{}' || '\": ' || CAST({} AS VARCHAR) || '}}'"
_RENAMED = '{"grad": "solar_radiation", "lat": "latitude", "lon": "longitude", "t": "temperature_2m", "tp": "precipitation", "u10m": "u_wind_10m", "v10m": "v_wind_10m", "valid_time": "time"}'


@query("s8_provenance", "ara_raw era5_raw wx", f"""
, s AS (SELECT count(*) AS n, count(*) FILTER ({_BAD}) AS bad FROM wx WHERE {_SUBSET})
SELECT output, key, value_json FROM (SELECT 'ara' AS output, 'rows' AS key, CAST(n AS VARCHAR) AS value_json FROM s UNION ALL SELECT 'era5', 'rows', CAST(n AS VARCHAR) FROM s
UNION ALL SELECT 'ara', 'out_of_range', CASE WHEN bad > 0 THEN {_JSON.format('temperature_2m', 'bad')} ELSE '{{}}' END FROM s UNION ALL SELECT 'era5', 'out_of_range', '{{}}'
UNION ALL SELECT 'ara', 'renamed', '{_RENAMED}' UNION ALL SELECT 'ara', 'accumulation', '{{"precipitation": "running", "solar_radiation": "running"}}'
UNION ALL SELECT unnest(['ara', 'era5']), 'period', '["2024-01-05", "2024-01-19"]')""")
def _(ara_raw, era5_raw, wx):
    notes, _ = _batch(ara_raw, era5_raw)
    return notes.where(F.col("key").isin("rows", "out_of_range", "period") | ((F.col("output") == "ara") & F.col("key").isin("renamed", "accumulation")))


@query("s8_duplicates_in_provenance", "ara_raw wx", """
SELECT 'ara' AS output, 'duplicate_rows_removed' AS key, CAST(3 * count(DISTINCT cell_id) AS VARCHAR) AS value_json FROM wx""")
def _(ara_raw, wx):
    made = standardise.standardise_observed(ara_raw, "ara", temperature_unit="K", precipitation_unit="mm")
    made.table.write.parquet(scratch_folder(ara_raw.sparkSession))
    return made.provenance("ara").where("key = 'duplicate_rows_removed'")


@query("b6_standardise_all", "ara_raw era5_raw wx", f"""
SELECT {CELLS}, count(*) AS runs, CAST(sum(n) AS BIGINT) AS steps, max(n) AS longest FROM ({_runs('wind_speed_10m < 3', f"(SELECT product, latitude, longitude, time, wind_speed_10m FROM ({_ARA}) UNION ALL SELECT 'era5', latitude, longitude, time, wind_speed_10m FROM wx WHERE {_SUBSET} AND time < TIMESTAMP '2024-01-10')")}) GROUP BY {CELLS}""")
def _(ara_raw, era5_raw, wx):
    spark, name = ara_raw.sparkSession, "batch_" + scratch_folder(ara_raw.sparkSession)[-12:]
    _batch(ara_raw, era5_raw, name)
    found = run_totals(spark.table(name), F.col("wind_speed_10m") < 3, cell=tables.BUCKETED_CELL, **HOUR)
    path = scratch_folder(spark)
    found.select("product", "latitude", "longitude", *(F.col(c).cast("long").alias(c) for c in ("runs", "steps", "longest"))).write.parquet(path)
    spark.sql(f"DROP TABLE {name}")  # of the catalog only; the files stay in their folder
    return spark.read.parquet(path)


# --- names, registry, people -----------------------------------------------------------------------
@query("p4_known_names_only", "ara_raw wx", "SELECT ingest_seq, valid_time AS time, lat AS latitude, lon AS longitude, t AS temperature_2m, u10m AS u_wind_10m, v10m AS v_wind_10m, grad AS solar_radiation, tp AS precipitation FROM ara_raw", "temperature_2m u_wind_10m v_wind_10m solar_radiation precipitation")
def _(ara_raw, wx):
    return naming.rename_to_canonical(ara_raw, registry.get_product("ara").extra_aliases, keep_unknown=False)


_LISTED = (("aifs", 31.0, 6.0, False, True), ("ara", 2.5, 1.0, True, True), ("cerra", 5.5, 1.0, True, True), ("climate_dt", 4.4, 1.0, False, True), ("era5", 31.0, 1.0, False, True), ("era5_land", 9.0, 1.0, False, False), ("extremes_dt", 4.4, 1.0, True, True), ("ifs", 9.0, 1.0, True, True))
_LISTING = ", ".join(f"({k}, '{p}', {r}e0, {s}e0, {g}, {w})" for k, (p, r, s, g, w) in enumerate(_LISTED))


@query("s7_registry_listing", "events", f"""
SELECT product, resolution_km, timestep_hours, has_native_gust, has_100m_wind, count(event_id) AS n, count(event_id) * max(timestep_hours) AS hours
FROM (VALUES {_LISTING}) AS l(k, product, resolution_km, timestep_hours, has_native_gust, has_100m_wind) LEFT JOIN events ON user_id % 8 = k GROUP BY product, resolution_km, timestep_hours, has_native_gust, has_100m_wind""", "resolution_km timestep_hours hours")
def _(ev):
    """Rows whose product differs, each with its own product's facts."""
    listing = registry.registry_listing(ev.sparkSession)
    keys = F.array(*[F.lit(k) for k in sorted(registry.PRODUCTS)])
    counts = ev.groupBy(F.get(keys, (F.col("user_id") % 8).cast("int")).alias("product")).agg(F.count("event_id").alias("n"))
    out = listing.join(counts, "product", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("hours", F.col("n") * F.col("timestep_hours"))


_KINDS = ", ".join(f"({k}, '{p}', {'NULL' if not a else repr(a)}, {h})" for k, (p, a, h) in enumerate((
    ("aifs", "running", "NULL"), ("ara", "running", "3.0e0"), ("cerra", "period", "NULL"), ("climate_dt", "period", "NULL"), ("era5", "period", "NULL"),
    ("era5_land", "running", "24.0e0"), ("extremes_dt", "period", "NULL"), ("ifs", "running", "NULL"))))


@query("s6_registry_by_product", "events", f"""
SELECT product, kind, reset_hours, count(*) AS n, sum(value) AS total FROM (VALUES {_KINDS}) AS l(k, product, kind, reset_hours) JOIN events ON user_id % 8 = k GROUP BY product, kind, reset_hours""", "reset_hours total")
def _(ev):
    """Each row with what its own product says of a variable."""
    table = registry.registry_table(ev.sparkSession).select("product", F.col("accumulation")["solar_radiation"].alias("kind"), "reset_hours")
    keys = F.array(*[F.lit(k) for k in sorted(registry.PRODUCTS)])
    rows = ev.select(F.get(keys, (F.col("user_id") % 8).cast("int")).alias("product"), "value")
    return rows.join(F.broadcast(table), "product").groupBy("product", "kind", "reset_hours").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("s5_population_source", "population", """
SELECT latitude, longitude, count(*) AS n, sum(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE population END) AS population
FROM population WHERE longitude BETWEEN 4.12e0 AND 9.02e0 AND latitude BETWEEN 43.52e0 AND 47.02e0 GROUP BY latitude, longitude""", "population")
def _(population):
    marked = F.when(F.col("c_custkey") % 22 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("population"))
    raster = population.select("latitude", "longitude", marked.alias("population"), F.when(F.col("c_custkey") % 2 == 0, "EPSG:4326").otherwise("4326").alias("crs"))
    people = tables.read_population(raster, (4.12, 43.52, 9.02, 47.02))
    return people.groupBy("latitude", "longitude").agg(F.count("*").alias("n"), F.sum("population").alias("population"))


@query("f3_quality_report", "w", "SELECT product, variable, CAST(offending AS BIGINT) AS offending FROM (" + " UNION ALL ".join(
    f"SELECT product, '{v}' AS variable, count(*) FILTER ({x} < {low} OR {x} > {high}) AS offending FROM w GROUP BY product" for v, x, low, high in (
        ("temperature_2m", "temperature_2m * 4", -90, 60), ("u_wind_10m", "u_wind_10m", -120, 120), ("v_wind_10m", "v_wind_10m", -120, 120), ("wind_speed_10m", "wind_speed_10m", 0, 120),
        ("solar_radiation", "solar_radiation * 2", 0, 1500), ("precipitation", "precipitation - 1", 0, 1000))) + ")")
def _(w):
    raw = w.withColumns({"temperature_2m": F.col("temperature_2m") * 4, "solar_radiation": F.col("solar_radiation") * 2, "precipitation": F.col("precipitation") - 1})
    return cleaning.quality_counts(raw)


_NEAR = """
{0}x AS (SELECT x, CASE WHEN below = x OR (above IS NOT NULL AND (x - below) / (above - below) <= 0.5) THEN below WHEN below IS NOT NULL THEN above END AS near
  FROM (SELECT t.x, (SELECT max(k.k) FROM {0}k AS k WHERE k.k <= t.x) AS below, (SELECT min(k.k) FROM {0}k AS k WHERE k.k > t.x) AS above FROM (SELECT DISTINCT {1} AS x FROM {2}) AS t) AS b)"""


@query("j6_population_nearest", "population targets", f"""
, people AS (SELECT latitude, longitude, sum(population) AS people FROM population GROUP BY latitude, longitude),
ak AS (SELECT DISTINCT latitude AS k FROM people), ok AS (SELECT DISTINCT longitude AS k FROM people),{_NEAR.format('a', 'latitude', 'targets')},{_NEAR.format('o', 'longitude', 'targets')},
s AS (SELECT t.latitude, t.longitude, coalesce(p.people, 0.0e0) AS people FROM targets AS t LEFT JOIN ax ON ax.x = t.latitude LEFT JOIN ox ON ox.x = t.longitude
  LEFT JOIN people AS p ON p.latitude = ax.near AND p.longitude = ox.near)
SELECT latitude, longitude, people * (CASE WHEN (SELECT sum(people) FROM s) > 0 THEN (SELECT sum(people) FROM people) / (SELECT sum(people) FROM s) ELSE 1 END) AS population FROM s""", "population")
def _(population, targets):
    return exposure.aggregate_population_to_grid(population, targets, "nearest_normalised")


# --- the solar chain ------------------------------------------------------------------------------------
def _series(angle: str, terms: tuple) -> str:
    waves = [f"{a:.17e} * {'cos' if k % 2 == 0 else 'sin'}({k // 2 + 1} * {angle})" for k, a in enumerate(terms[1:])]
    return f"({' + '.join([f'{terms[0]:.17e}', *waves])})"


def _solar(altitude: str, system: solar.PVSystem) -> str:
    """The chain from irradiance to capacity factor in SQL, step by step."""
    tilt, turn = math.radians(system.tilt_deg), math.radians(system.azimuth_deg - 180)
    a0, a1, a2, a3, a4 = solar.ERBS_SERIES
    return f"""
, p1 AS (SELECT *, greatest(solar_radiation, 0.0e0) AS g, hour(time) + minute(time) / 60.0e0 + second(time) / 3600.0e0 AS h FROM w),
p2 AS (SELECT *, 2 * pi() / 365 * (dayofyear(time) - 1 + (h - 12) / 24.0e0) AS d, radians(latitude) AS phi FROM p1),
p3 AS (SELECT *, {_series('d', solar.DECLINATION_SERIES)} AS decl, {solar.SOLAR_CONSTANT} * {_series('d', solar.ECCENTRICITY_SERIES)} AS top,
  (h + longitude / 15 - 12) * pi() / 12 + {_series('d', solar.EQUATION_OF_TIME_SERIES)} AS angle FROM p2),
p4 AS (SELECT *, least(greatest(sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(angle), -1), 1) AS s,
  (cos(decl) * cos(angle) * sin(phi) - sin(decl) * cos(phi)) * {math.sin(tilt) * math.cos(turn)!r} + cos(decl) * sin(angle) * {math.sin(tilt) * math.sin(turn)!r} AS ground FROM p3),
p5 AS (SELECT *, degrees(asin(s)) AS e, {solar.SEA_LEVEL_HPA} * pow(1 - {altitude} * {solar.PRESSURE_LAPSE!r}, {solar.PRESSURE_EXPONENT}) AS hpa FROM p4),
p6 AS (SELECT *, radians(e + CASE WHEN e >= {solar.LOWEST_REFRACTED_DEG} THEN hpa / 1010 * 283 / 285.0e0 * 1.02e0 / (60 * tan(radians(e + 10.3e0 / (e + 5.11e0)))) ELSE 0 END) AS up FROM p5),
p7 AS (SELECT *, sin(up) AS z, sin(up) * {math.cos(tilt)!r} + ground * cos(up) / sqrt(1 - s * s) AS facing, least(g / (top * greatest(sin(up), {solar.LOWEST_COS_ZENITH})), 1) AS kt FROM p6),
p8 AS (SELECT *, z > cos(radians({solar.LARGEST_ZENITH_DEG})) AS high, CASE WHEN kt <= {solar.ERBS_LOW} THEN 1 - 0.09e0 * kt WHEN kt <= {solar.ERBS_HIGH}
  THEN {a0} + {a1} * kt + {a2} * kt * kt + {a3} * kt * kt * kt + {a4} * kt * kt * kt * kt ELSE {solar.ERBS_CLEAR} END AS share FROM p7),
p9 AS (SELECT *, CASE WHEN high THEN (g - g * share) / z * greatest(facing, 0) ELSE 0 END + CASE WHEN high THEN g * share ELSE g END * {(1 + math.cos(tilt)) / 2!r}
  + g * {solar.GROUND_ALBEDO * (1 - math.cos(tilt)) / 2!r} AS poa FROM p8),
p10 AS (SELECT *, poa / 1000 * (1 + {system.gamma_pdc} * (temperature_2m + poa / ({system.u0} + {system.u1} * wind_speed_10m) - 25)) AS cf FROM p9)
SELECT product, latitude, longitude, avg(least(greatest(cf, 0), 1)) AS mean_value, max(least(greatest(cf, 0), 1)) AS max_value, count(cf) AS n FROM p10 WHERE cf IS NOT NULL GROUP BY product, latitude, longitude"""


def _capacity(w: DataFrame, **options) -> DataFrame:
    x = solar.fixed_tilt_capacity_factor(w, "solar_radiation", "temperature_2m", "wind_speed_10m", output="x", **options)
    return _per_cell(x, F.avg("x").alias("mean_value"), F.max("x").alias("max_value"), F.count("x").alias("n"))


_WEST = solar.PVSystem("west", tilt_deg=45.0, azimuth_deg=250.0)


@query("p15_fixed_tilt_capacity_factor", "w", _solar("0", solar.REFERENCE_PV_SYSTEM), "mean_value max_value")
def _(w):
    return _capacity(w)


@query("p15_fixed_tilt_by_altitude", "w", _solar("((latitude - 43) * 900)", _WEST), "mean_value max_value")
def _(w):
    return _capacity(w.withColumn("height", (F.col("latitude") - 43) * 900), altitude="height", system=_WEST)


# --- stations -------------------------------------------------------------------------------------------
_MERGED = {"temperature": ("t_obs", "t_mod"), "wind_speed": ("w_obs", "w_mod")}
_STACKED = """
, stacked AS (SELECT 'temperature' AS variable, station_id, observed AS o, modelled AS m FROM pairs UNION ALL SELECT 'wind_speed', station_id, modelled / 2, observed / 3 FROM pairs WHERE l_linenumber <> 4),
valid AS (SELECT * FROM stacked WHERE o IS NOT NULL AND m IS NOT NULL)"""
_SITES = f"SELECT variable, station_id, {_V} FROM valid GROUP BY variable, station_id HAVING count(*) >= 100"


def _merged(pairs: DataFrame) -> DataFrame:
    """One row per station and time with both variables; wind is missing at times."""
    windy = F.col("l_linenumber") != 4
    return pairs.select("station_id", F.col("observed").alias("t_obs"), F.col("modelled").alias("t_mod"), F.when(windy, F.col("modelled") / 2).alias("w_obs"), (F.col("observed") / 3).alias("w_mod"))


@query("s4_paired_stations", "pairs", f"{_STACKED}\nSELECT variable, station_id, count(*) AS n, sum(o) AS observed, sum(m) AS modelled FROM valid GROUP BY variable, station_id", "observed modelled")
def _(pairs):
    both = tables.read_paired_stations(_merged(pairs), _MERGED).where("observed IS NOT NULL AND modelled IS NOT NULL")
    return both.groupBy("variable", "station_id").agg(F.count("*").alias("n"), F.sum("observed").alias("observed"), F.sum("modelled").alias("modelled"))


@query("b5_station_verification", "pairs stations", f"{_STACKED}, s AS ({_SITES})\nSELECT s.*, name, alt FROM s JOIN stations USING (station_id)", _VCOLS + " alt")
def _(pairs, stations):
    per_station, _ = jobs.station_verification(_merged(pairs), stations.select(F.col("station_id").alias("synnr"), "name", "alt"), _MERGED)
    return per_station.drop("synnr")


@query("b5_elevation_bands", "pairs stations", f"""{_STACKED}, s AS ({_SITES})
SELECT v.variable, b.name AS elevation_band, count(alt) AS n_stations, avg(bias) AS bias, avg(rmse) AS rmse, avg(correlation) AS correlation
FROM (SELECT DISTINCT variable FROM s) AS v CROSS JOIN (VALUES {_BAND_ROWS}) AS b(name, low, high)
LEFT JOIN (SELECT * FROM s JOIN stations USING (station_id)) AS x ON x.variable = v.variable AND (alt > low OR (alt = 0 AND low = 0)) AND alt <= high GROUP BY ALL""", "bias rmse correlation")
def _(pairs, stations):
    _, bands = jobs.station_verification(_merged(pairs), stations.select(F.col("station_id").alias("synnr"), "name", "alt"), _MERGED)
    return bands


# --- events that no other query asks for --------------------------------------------------------------------
_EPISODES = f"(SELECT w.* FROM w JOIN (SELECT *, first_time + (n - 1) * INTERVAL '1' HOUR AS last_time FROM ({_runs(_LOW, 'w')}) WHERE n >= 48) AS r ON w.product = r.product AND w.latitude = r.latitude AND w.longitude = r.longitude AND w.time BETWEEN r.first_time AND r.last_time)"


@query("e3_cold_statistics", "w", f"""
, cold AS (SELECT * FROM ({_runs('temperature_2m < 8', _EPISODES)}))
SELECT c.product, c.latitude, c.longitude, CAST(count(r.n) AS BIGINT) AS cold_event_count, CAST(coalesce(sum(r.n), 0) AS DOUBLE) AS cold_total_hours,
coalesce(sum(r.n), 0) / any_value(c.steps) AS cold_frequency, CAST(coalesce(max(r.n), 0) AS DOUBLE) AS cold_longest_event_hours
FROM (SELECT {CELLS}, CAST(count(*) AS DOUBLE) AS steps FROM w GROUP BY {CELLS}) AS c LEFT JOIN cold AS r USING ({CELLS}) GROUP BY ALL""", "cold_total_hours cold_frequency cold_longest_event_hours")
def _(w):
    stats = events.detect_from_raw(w, temperature="temperature_2m", cold_threshold=8.0, **HOUR).stats
    return stats.select("product", "latitude", "longitude", *[c for c in stats.columns if c.startswith("cold_")])


@query("e7_rain_on_deep_snow", "w", _stats("temperature_2m > 0 AND temperature_2m < 5 AND precipitation > 2 AND (latitude - 43) / 40 >= 0.05e0", 1), "total_hours frequency longest_event_hours")
def _(w):
    return events.rain_on_snow(w.withColumn("snow", (F.col("latitude") - 43) / 40), snow_depth="snow", **HOUR).stats


# --- streams -----------------------------------------------------------------------------------------------------
#: Events span a month; no row is late, in whatever order their files come.
_DELAY = "40 days"
_KEYS = {"product": "string", "cell": "long"}


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of wind speeds by user, in which a third of the rows is delivered twice."""
    schema = view(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    rows = raw.unionByName(raw.where("event_id % 3 = 0"))
    return rows.select(F.lit("events").alias("product"), F.col("user_id").alias("cell"), F.col("ts").alias("time"), "event_id", (F.col("value") / 8).alias("wind_speed_10m"))


def _stream_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    run = streaming.run_daily(_observations(spark, sf_dir), f"{folder}/days", f"{folder}/checkpoint", "wind_speed_10m", more_keys=("event_id",), delay=_DELAY, cell=("product", "cell"))
    run.awaitTermination()
    return streaming.latest_days(spark, f"{folder}/days", _KEYS)


def _streamed(name: str, sql: str, rounded: str = ""):
    def add(f):
        query(name, "events", sql, rounded)(f)
        columns = rounded.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})

        QUERIES[name] = run
        return f

    return add


_WIND = "(SELECT 'events' AS product, user_id AS cell, ts AS time, value / 8 AS wind_speed_10m FROM events)"
_STORM = ", ".join(f"count(*) FILTER (wind_speed_10m >= {t}e0) * 1.0e0 AS {n}_hours, count(*) FILTER (wind_speed_10m >= {t}e0) / CAST(count(*) AS DOUBLE) AS {n}_fraction" for n, t in _CLASSES)


@_streamed("stream_f4_deduplicated", f"SELECT product, cell, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM {_WIND} GROUP BY product, cell")
def _(spark, sf_dir):
    folder = scratch_folder(spark)
    streaming.run_deduplicated(_observations(spark, sf_dir), f"{folder}/rows", f"{folder}/checkpoint", more_keys=("event_id",), delay=_DELAY, cell=("product", "cell")).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("product", "cell").agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@_streamed("stream_a7_exceedance_hours", f"SELECT product, cell, CAST(count(*) FILTER (wind_speed_10m >= 12.5e0) AS DOUBLE) AS exceedance_hours FROM {_WIND} GROUP BY product, cell", "exceedance_hours")
def _(spark, sf_dir):
    return _stream_of_days(spark, sf_dir).groupBy("product", "cell").agg((F.sum("strong_wind_steps") * 1.0).alias("exceedance_hours"))


@_streamed("stream_a9_storm_hours", f"SELECT product, cell, {_STORM} FROM {_WIND} GROUP BY product, cell", " ".join(f"{n}_hours {n}_fraction" for n, _ in _CLASSES))
def _(spark, sf_dir):
    return streaming.storm_summary(_stream_of_days(spark, sf_dir), ("product", "cell"), ALPINE_STORM_THRESHOLDS).drop("storm_days")


@_streamed("stream_a10_storm_days", f"SELECT product, cell, count(*) FILTER (largest >= 15) AS storm_days FROM (SELECT product, cell, CAST(time AS DATE) AS day, max(wind_speed_10m) AS largest FROM {_WIND} GROUP BY ALL) GROUP BY product, cell")
def _(spark, sf_dir):
    return streaming.storm_summary(_stream_of_days(spark, sf_dir), ("product", "cell")).select("product", "cell", "storm_days")
