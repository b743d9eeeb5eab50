"""Readings stored by day: slices equal those of the whole table and open only the folders of each key's own days."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millwright.operators import health
from millwright.session import fresh_path
from millwright.sources.days import DayTable

T0 = dt.datetime(2024, 1, 1)
COLUMNS = ("asset_id", "ts", "v", "max_ts", "age_min")


@pytest.fixture
def stored(spark):
    return DayTable(spark, fresh_path(spark, "readings"), spark.createDataFrame([], "asset_id STRING, ts TIMESTAMP_NTZ, v DOUBLE").schema,
                    "asset_id", "ts", 4)


def readings(spark, last_days, per_day=4, first=0):
    spec = [(a, T0 + dt.timedelta(days=d, hours=24 * i // per_day), float(d)) for a, last in last_days.items()
            for d in range(first, last) for i in range(per_day)]
    return spark.createDataFrame(spec, "asset_id STRING, ts TIMESTAMP_NTZ, v DOUBLE")


def opened(df):
    return {r[0].rsplit("stored_cell=", 1)[1].split("/")[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_silent_asset_costs_only_its_own_days(spark, stored):
    df = readings(spark, {**{f"A{i}": 60 for i in range(6)}, "S": 3, "old": 20})
    stored.append(df.where("ts < '2024-02-01'"), "january")
    stored.append(df.where("ts >= '2024-02-01'"), "later")
    want = health.trailing_slice(df, "asset_id", "ts", 8)
    assert rows(health.trailing_stored(stored, 8), *COLUMNS) == rows(want, *COLUMNS)
    days = {}
    for cell in opened(stored.trailing(8)[0]):
        days.setdefault(cell.split(".")[0], set()).add(cell.split(".")[1])
    silent = {d for d in days if d <= "2024-01-03"}
    assert silent == {"2024-01-01", "2024-01-02", "2024-01-03"} and all(len(days[d]) == 1 for d in silent)  # one slot of four
    assert not [d for d in days if "2024-01-20" < d < "2024-02-21"]
    assert len(opened(stored.read())) > 2 * sum(len(s) for s in days.values())
    assert rows(stored.newest(), "asset_id", "max_ts") == rows(df.groupBy("asset_id").agg(F.max("ts").alias("max_ts")), "asset_id", "max_ts")


def test_batches_that_died_are_run_again(spark, stored):
    df = readings(spark, {"A": 12, "B": 5})
    stored.append(df, "one")
    stored.append(df, "one")
    more = readings(spark, {"A": 14}, first=12)
    more.withColumn("stored_cell", F.lit("2024-01-13.0")).write.partitionBy("stored_cell").parquet(
        f"{stored.path}/slots=4/rows/stored_batch=two")  # rows without their newest times: not there yet
    assert rows(stored.read(), "asset_id", "ts", "v") == rows(df, "asset_id", "ts", "v")
    stored.append(more, "two")
    assert rows(stored.read(), "asset_id", "ts", "v") == rows(df.unionByName(more), "asset_id", "ts", "v")
    want = health.trailing_slice(df.unionByName(more), "asset_id", "ts", 2)
    assert rows(health.trailing_stored(stored, 2), *COLUMNS) == rows(want, *COLUMNS)


def test_nulls_repeats_and_no_rows(spark, stored):
    assert stored.read().isEmpty() and health.trailing_stored(stored, 8).isEmpty()
    stored.append(readings(spark, {}), "none")
    assert health.trailing_stored(stored, 8).isEmpty()
    spec = [("A", T0, 1.0), ("A", T0, 1.0), ("A", None, 2.0), (None, T0, 3.0), ("N", None, 4.0), (None, None, None)]
    df = spark.createDataFrame(spec, "asset_id STRING, ts TIMESTAMP_NTZ, v DOUBLE")
    stored.append(df, "odd")
    assert stored.read().count() == 6
    assert rows(health.trailing_stored(stored, 8), *COLUMNS) == rows(health.trailing_slice(df, "asset_id", "ts", 8), *COLUMNS)
