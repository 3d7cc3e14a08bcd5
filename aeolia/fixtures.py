"""Weather-shaped views over the given tables, as the same SQL text for Spark and for others.

The given tables hold no weather. These views derive an hourly lattice and its companions
from events, supplier, lineitem and customer by integer arithmetic, so that every engine
computes each value alike and the rows grow with the tables.

Where the plain text would have Spark make the rows of all cells in one task, or pair every customer with
every cell, Spark gets the same rows by the texts of ``SPREAD``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["SPREAD", "VIEWS", "portable", "view", "write_views"]

_WX = """
SELECT 'synthetic' AS product, lat.time, lat.u AS cell_id,
  43 + (lat.u % 40) * 0.15e0 AS latitude, 4 + ((lat.u - lat.u % 40) DIV 40) * 0.35e0 AS longitude,
  CASE WHEN k = 7 THEN NULL ELSE least((CASE WHEN calm THEN k / 100.0e0 ELSE k / 8.0e0 END) + coalesce(ev.ev, 0) / 50.0e0, 40.0e0) END AS wind_speed_10m,
  283.15e0 - (lat.u % 10) + 8 * (1 - abs(hod - 14) / 12.0e0) + ((h - hod) DIV 24) % 15 AS t2m,
  greatest(49 - (hod - 12) * (hod - 12), 0) * (CASE WHEN calm THEN 1 ELSE 20 END) * 3600.0e0 AS ssrd,
  CASE WHEN k % 5 = 0 THEN k / 40.0e0 ELSE 0e0 END AS tp
FROM (
  SELECT users.u, h, t0 + h * INTERVAL '1' HOUR AS time, h % 24 AS hod,
    (users.u * 37 + h * 13 + (h * h) % 97) % 200 AS k, ((h - h % 24) DIV 24 + users.u) % 7 < 3 AS calm
  FROM (SELECT DISTINCT user_id AS u FROM {events}) AS users
  CROSS JOIN (SELECT h FROM range(720) AS t(h)) AS hrs
  CROSS JOIN (SELECT CAST(CAST(min(ts) AS DATE) AS {TS}) AS t0 FROM {events}) AS start
) AS lat
LEFT JOIN (SELECT user_id AS u, CAST(date_trunc('HOUR', ts) AS {TS}) AS time, max(value) AS ev FROM {events} GROUP BY 1, 2) AS ev
ON ev.u = lat.u AND ev.time = lat.time
"""

#: name: (tables it reads, text)
VIEWS = {
    "wx": (("events",), _WX),
    "wx_dup": (("wx",), """
SELECT 0 AS ingest_seq, * FROM {wx}
UNION ALL SELECT 1 AS ingest_seq, * FROM {wx} WHERE time < (SELECT min(time) + INTERVAL '3' HOUR FROM {wx})"""),
    "wx_block": (("wx",), """
SELECT product, latitude, longitude, cell_id, time, ssrd AS ssrd_true, sum(ssrd) OVER (PARTITION BY cell_id, blk ORDER BY time ROWS UNBOUNDED PRECEDING) AS ssrd
FROM (SELECT *, (row_number() OVER (PARTITION BY cell_id ORDER BY time) + 1) DIV 3 AS blk FROM {wx}) x"""),
    "ara_raw": (("wx",), """
SELECT d.ingest_seq, time AS valid_time, latitude AS lat, longitude AS lon,
  CASE WHEN d.ingest_seq = 1 THEN t2m + 50 WHEN cell_id % 7 = 0 AND hour(time) = 5 THEN 500.0e0 ELSE t2m END AS t,
  0.6e0 * wind_speed_10m AS u10m, 0.8e0 * wind_speed_10m AS v10m, 'x' AS station_note,
  sum(ssrd) OVER (PARTITION BY d.ingest_seq, cell_id, blk ORDER BY time ROWS UNBOUNDED PRECEDING) AS grad,
  sum(tp) OVER (PARTITION BY d.ingest_seq, cell_id, blk ORDER BY time ROWS UNBOUNDED PRECEDING) AS tp
FROM (SELECT *, (row_number() OVER (PARTITION BY cell_id ORDER BY time) + 1) DIV 3 AS blk FROM {wx}) AS x
CROSS JOIN (SELECT 0 AS ingest_seq UNION ALL SELECT 1 AS ingest_seq) AS d
WHERE d.ingest_seq = 0 OR time < (SELECT min(time) + INTERVAL '3' HOUR FROM {wx})"""),
    "era5_raw": (("wx",), """
SELECT 0 AS ingest_seq, time, latitude, longitude, t2m AS var167, 0.6e0 * wind_speed_10m AS u10, 0.8e0 * wind_speed_10m AS v10, ssrd, tp / 1000 AS tp FROM {wx}"""),
    "w": (("wx",), """
SELECT product, time, latitude, longitude, wind_speed_10m, t2m - 273.15e0 AS temperature_2m, ssrd / 3600.0e0 AS solar_radiation,
  tp AS precipitation, 0.6e0 * wind_speed_10m AS u_wind_10m, 0.8e0 * wind_speed_10m AS v_wind_10m FROM {wx}"""),
    "w2": (("w",), """
SELECT product, time, latitude, longitude, wind_speed_10m, temperature_2m, solar_radiation, precipitation,
  wind_speed_10m * 1.5e0 AS wind_gust_10m, wind_speed_10m * 1.4e0 AS wind_speed_100m FROM {w}
UNION ALL SELECT 'six_hourly' AS product, time, latitude, longitude, wind_speed_10m, temperature_2m, solar_radiation, precipitation,
  CAST(NULL AS DOUBLE) AS wind_gust_10m, CAST(NULL AS DOUBLE) AS wind_speed_100m FROM {w} WHERE hour(time) % 6 = 0"""),
    "stations": (("supplier",), """
SELECT s_suppkey AS station_id, s_name AS name, 43 + (s_suppkey * 37 % 600) / 100.0e0 AS lat,
  4 + (s_suppkey * 53 % 1300) / 100.0e0 AS lon, greatest(s_acctbal, 0e0) * 0.45e0 AS alt FROM {supplier}"""),
    "pairs": (("lineitem",), """
SELECT l_suppkey AS station_id, l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 2 THEN NULL WHEN l_suppkey = 1 THEN 5e0 ELSE l_quantity END AS observed,
  l_quantity * (1 + l_discount) - 20 * l_tax AS modelled FROM {lineitem}"""),
    "population": (("customer",), """
SELECT c_custkey, 43 + (c_custkey % 120) * 0.05e0 AS latitude,
  4 + (((c_custkey - c_custkey % 120) DIV 120) % 280) * 0.05e0 AS longitude, greatest(c_acctbal, 0e0) AS population FROM {customer}"""),
    "people": (("w", "customer"), """
SELECT c.latitude, c.longitude, CAST(count(*) AS DOUBLE) * 10 AS population
FROM (SELECT DISTINCT latitude, longitude, cast(round((latitude - 43) / 0.15e0) AS BIGINT) AS k FROM {w}) AS c
JOIN {customer} ON c_custkey % 40 = c.k GROUP BY c.latitude, c.longitude"""),
    "targets": (("population",), """
SELECT DISTINCT 43.25e0 + ((c_custkey - 1) % 12) * 0.5e0 AS latitude, 4.25e0 + (((c_custkey - 1) DIV 12) % 28) * 0.5e0 AS longitude FROM {population}"""),
    "daily": (("lineitem",), """
SELECT 'series' AS product, 46.0e0 AS latitude, 8.0e0 AS longitude, CAST(CAST(l_shipdate AS DATE) AS {TS}) AS time,
  avg(l_quantity) - 3.5e0 - 5 * abs(month(CAST(l_shipdate AS DATE)) - 7) AS temperature_2m,
  avg(l_discount) * 20 AS precipitation FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)"""),
}

#: Cells that a task makes the hours of: what a task holds does not grow with the tables.
CELLS_OF_A_TASK = 500

_EV = """LEFT JOIN (SELECT user_id AS u, CAST(date_trunc('HOUR', ts) AS {TS}) AS time, max(value) AS ev FROM {events} GROUP BY 1, 2) AS ev
ON ev.u = lat.u AND ev.time = lat.time
"""

#: Views whose rows Spark makes by another text. The lattice: a row for each user with the values of its hours, spread over
#: tasks before the hours are made, so that no hour is moved. People: customers are counted before the join.
SPREAD = {
    "wx": (("events", "users"), _WX.replace(_EV, "").replace("coalesce(ev.ev, 0)", "coalesce(try_element_at(lat.found, lat.time), 0)")
           .replace("SELECT users.u, h, t0", "SELECT users.u, users.found, h, t0")
           .replace("(SELECT DISTINCT user_id AS u FROM {events})", "{users}")
           .replace("(SELECT h FROM range(720) AS t(h))", "LATERAL (SELECT explode(sequence(0L, 719L)) AS h)")),
    "users": (("events", "user_hours"), """
SELECT u, map_from_entries(collect_list(CASE WHEN time >= t0 AND time < t0 + INTERVAL '720' HOUR THEN struct(time, ev) END)) AS found
FROM {user_hours} CROSS JOIN (SELECT CAST(CAST(min(ts) AS DATE) AS {TS}) AS t0 FROM {events}) AS start GROUP BY u"""),
    "user_hours": (("events",), "SELECT user_id AS u, CAST(date_trunc('HOUR', ts) AS {TS}) AS time, max(value) AS ev FROM {events} GROUP BY 1, 2"),
    "people": (("w", "customer"), """
SELECT c.latitude, c.longitude, CAST(sum(n) AS DOUBLE) * 10 AS population
FROM (SELECT DISTINCT latitude, longitude, cast(round((latitude - 43) / 0.15e0) AS BIGINT) AS k FROM {w}) AS c
JOIN (SELECT c_custkey % 40 AS k, count(*) AS n FROM {customer} GROUP BY 1) AS p ON p.k = c.k GROUP BY c.latitude, c.longitude"""),
}


_written: dict[tuple[str, str], str] = {}
_users: dict[str, int] = {}


def write_views(spark: SparkSession, sf_dir: str, folder: str, *names: str) -> None:
    """Write views of a folder's tables once; from then on :func:`view` reads them in this process."""
    for name in names:
        view(spark, sf_dir, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        _written[sf_dir, name] = f"{folder}/{name}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a view over the tables in a folder; a given table's own rows by its name."""
    if (sf_dir, name) in _written:
        return spark.read.parquet(_written[sf_dir, name])
    if name not in SPREAD and name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables, text = SPREAD.get(name) or VIEWS[name]
    made = spark.sql(text.replace("{TS}", "TIMESTAMP_NTZ"), **{t: view(spark, sf_dir, t) for t in tables})
    if name == "user_hours":
        # By number, as the sizes of these few rows say nothing of the hours made of them.
        return made.repartition(_tasks(spark, sf_dir), "u")
    return made


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the lattice takes; about, as only the spread depends on it."""
    if sf_dir not in _users:
        _users[sf_dir] = view(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id")).first()[0]
    return max(1, -(-_users[sf_dir] // CELLS_OF_A_TASK))


def portable(*names: str) -> str:
    """The named views and all they read, to stand after WITH, for engines with TIMESTAMP and //."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for other in VIEWS[name][0]:
                add(other)
            order.append(name)

    for name in names:
        add(name)
    parts = []
    for name in order:
        text = VIEWS[name][1].replace("{TS}", "TIMESTAMP").replace(" DIV ", " // ")
        for other in VIEWS[name][0]:
            text = text.replace("{" + other + "}", other)
        parts.append(f"{name} AS ({text})")
    return ",\n".join(parts)
