"""The lattice and the people as Spark makes them: the rows of the plain texts, in bounded tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aeolia import fixtures
from tests.comparing import of_spark


def plain(spark, folder, name):
    """A view by the text that other engines get."""
    tables, text = fixtures.VIEWS[name]
    given = {t: plain(spark, folder, t) if t in fixtures.VIEWS else fixtures.view(spark, folder, t) for t in tables}
    return spark.sql(text.replace("{TS}", "TIMESTAMP_NTZ"), **given)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Users and stamps that are missing, hours met twice, missing values, a record beyond the lattice."""
    folder = str(tmp_path_factory.mktemp("odd"))
    at = lambda day, hour: datetime(2024, day // 31 + 1, day % 31 + 1, hour, 30)
    rows = [(0, at(0, 5), 1, 9.0), (1, at(0, 5), 1, 4.0), (2, at(0, 6), 1, None), (3, None, 2, 7.0), (4, at(1, 1), None, 8.0), (5, at(29, 23), 3, 1.0), (6, at(40, 2), 3, 90.0)]
    rows += [(10 + k, at(k % 30, k % 24), 40 + k % 90, float(k)) for k in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{folder}/events.parquet")
    customers = spark.range(130).select(F.expr("CASE WHEN id < 3 THEN NULL ELSE id * 3 END").alias("c_custkey"))
    customers.write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", ["wx", "people"])
def test_rows_of_the_plain_text(spark, odd, name):
    for folder in ("/root/testdata/sf0.001", odd):
        got, want = fixtures.view(spark, folder, name), plain(spark, folder, name)
        assert got.dtypes == want.dtypes
        assert of_spark(got) == of_spark(want)


def test_hours_of_few_cells_in_a_task(spark, odd, monkeypatch):
    monkeypatch.setattr(fixtures, "CELLS_OF_A_TASK", 10)
    rows = fixtures.view(spark, odd, "wx").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    cells = sum(r["n"] for r in rows) // 720
    assert cells == 94 and len(rows) > 4
    assert max(r["n"] for r in rows) <= 3 * 10 * 720


def test_customers_are_counted_before_they_meet_cells(spark, odd):
    plan = fixtures.view(spark, odd, "people")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("count(1)")


def test_rows_of_a_product_do_not_meet_in_a_task(spark):
    from aeolia.operators import accumulation, cleaning, storms

    rows = spark.range(20).selectExpr("IF(id % 2 = 0, 'a', 'b') AS product", "id * 1.0 AS latitude", "0.0 AS longitude", "timestamp_ntz'2024-01-01' + id * INTERVAL '1' HOUR AS time", "id % 3 AS number", "id * 1.0 AS wind_speed_10m", "IF(id % 2 = 0, 3.0, NULL) AS wind_gust_10m")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for made in (storms.resolve_gusts(rows), cleaning.control_member(rows), accumulation._leading(rows, ["product"], "time", 3)):
            assert "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_steps_of_runs_are_sorted_once(spark):
    from aeolia.operators import runs

    rng = random.Random(4)
    steps = [(c, datetime(2024, 1, 1) + timedelta(hours=h), rng.random() < 0.8) for c in range(4) for h in range(24 * 40) if rng.random() < 0.97]
    steps += [(9, datetime(2024, 1, 1) + timedelta(hours=h), True) for h in range(24 * 20)]
    rows = spark.createDataFrame([("p", float(c), t, v if rng.random() < 0.95 else None) for c, t, v in steps], "product string, latitude double, time timestamp_ntz, low boolean")
    for need, block in ((2, 24), (6, 24), (6, 2160), (48, 24)):
        made = runs.sustained(rows, F.col("low"), min_duration_hours=need, timestep_hours=1.0, block_hours=block)
        assert made._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 1
        got = {(r.latitude, r.time): r.sustained for r in made.collect()}
        want, hours = {}, {(r.latitude, r.time): bool(r.low) for r in rows.collect()}
        for at, low in sorted(hours.items()):
            run = [at] if low else []
            for step in (1, -1):
                k = 1
                while low and hours.get((at[0], at[1] + timedelta(hours=step * k))):
                    run.append(k)
                    k += 1
            want[at] = len(run) >= need
        assert got == want and len(got) == rows.count()
