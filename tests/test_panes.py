"""Aggregates from panes against aggregates over rows, and the periodic feature job."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldstream.operators import gold, panes
from fieldstream.plans import streams
from fieldstream.plans.registry import AS_OF
from fieldstream.sources import readers
from fieldstream.streaming import jobs

SF = "/root/testdata/sf0.001"
SENSOR = "field_id string, location string, temperature double, humidity double, soil_ph double, temperature_valid boolean, humidity_valid boolean, ph_valid boolean, timestamp_parsed timestamp_ntz, month int, date date"
WEATHER = "location string, temp_c double, humidity bigint, wind_kph double, uv double, precip_mm double, condition string, timestamp_parsed timestamp_ntz, date date"


def close(a, b):
    return a == b if not (isinstance(a, float) and isinstance(b, float)) else abs(a - b) <= 1e-9 * max(1, abs(a))


def same(left, right):
    a, b = ([{**r.asDict()} for r in df.orderBy(*keys).collect()] for df, keys in ((left, left.columns[:2]), (right, right.columns[:2])))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(close(x[c], y[c]) for c in x), [(c, x[c], y[c]) for c in x if not close(x[c], y[c])]


def sensor_rows(n, start, seed=1):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        t = start + timedelta(seconds=rng.randint(-60, 1300), microseconds=rng.choice([0, 1, 999_999]))
        value = lambda: rng.choice([None, rng.uniform(-20, 1e6), 5.0])
        rows.append((rng.choice(["a", "b", None]), rng.choice(["x", "y"]), value(), value(), value(), rng.choice([True, False, None]), True, rng.choice([True, False]), t, rng.choice([1, 2, 2, None]), t.date()))
    rows.append(("single", "x", 7.0, None, 1.0, None, True, True, start + timedelta(minutes=5), 3, start.date()))
    return [*rows, ("edge", "x", 1.0, 1.0, 1.0, True, True, True, start, 1, start.date()), ("edge", "x", 2.0, 1.0, 1.0, True, True, True, start + timedelta(minutes=20), 2, start.date()), ("edge", "x", 9.0, 1.0, 1.0, True, True, True, start + timedelta(minutes=20, microseconds=1), 2, start.date())]


@pytest.mark.parametrize("start", [datetime(2024, 1, 1, 23, 50), datetime(2024, 1, 1, 11, 59, 30)])
def test_panes_give_what_rows_give(spark, start):
    rows = spark.createDataFrame(sensor_rows(400, start), SENSOR).repartition(4).cache()
    as_of = str(start + timedelta(minutes=20))
    # panes of several batches, which share minutes
    stored = panes.panes(rows.where("temperature > 5"), panes.SENSOR).unionByName(panes.panes(rows.where("NOT coalesce(temperature > 5, false)"), panes.SENSOR))
    found = panes.aggregates(panes.look_back(stored, rows, panes.SENSOR, as_of, 20), panes.SENSOR)
    want = gold.in_window(rows, as_of, 20).groupBy("field_id", "location").agg(*gold.sensor_aggregates())
    same(found.select(*want.columns), want)


def test_weather_panes(spark):
    start, rng = datetime(2024, 3, 1, 10), random.Random(2)
    rows = [(rng.choice("xy"), rng.uniform(-9, 9), rng.randint(0, 100), None, rng.choice([None, 1.5]), 0.5, rng.choice(["Fog", "Rain", None]), (t := start + timedelta(seconds=rng.randint(0, 600))), t.date()) for _ in range(200)]
    df = spark.createDataFrame(rows, WEATHER)
    as_of = "2024-03-01 10:10:00"
    want = gold.in_window(df, as_of, 10).groupBy("location").agg(*gold.weather_aggregates())
    same(panes.aggregates(panes.look_back(panes.panes(df, panes.WEATHER), df, panes.WEATHER, as_of, 10), panes.WEATHER).select(*want.columns), want)
    none = df.limit(0)
    assert panes.aggregates(panes.look_back(panes.panes(none, panes.WEATHER), none, panes.WEATHER, as_of, 10), panes.WEATHER).count() == 0


def test_rows_are_read_at_the_ends_only(spark, tmp_path):
    start = datetime(2024, 1, 1, 11, 59, 30)
    rows = spark.createDataFrame(sensor_rows(400, start), SENSOR)
    part = panes.look_back(panes.panes(rows, panes.SENSOR).limit(0), rows, panes.SENSOR, str(start + timedelta(minutes=20)), 20)
    assert {r["minute"] for r in part.collect()} <= {datetime(2024, 1, 1, 11, 59), datetime(2024, 1, 1, 12, 19)}


def test_periodic_features_replace_a_replayed_snapshot(spark, tmp_path):
    calls = []

    def features(as_of):
        calls.append(as_of)
        return spark.createDataFrame([("f", len(calls))], "field_id string, run int")

    def tick(*times, checkpoint):
        spark.createDataFrame([(datetime.fromisoformat(t),) for t in times], "timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("timestamp timestamp").parquet(f"{tmp_path}/in")
        jobs.drained(jobs.feature_job(stream, features, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", jobs.file_broker(f"{tmp_path}/topic", "gold"), jobs.NOW))

    tick("2024-01-01 10:00:00", "2024-01-01 10:00:07", checkpoint="c")
    tick("2024-01-01 10:10:00", checkpoint="c")
    assert calls == ["2024-01-01 10:00:07", "2024-01-01 10:10:00"]
    assert jobs.feature_snapshot(spark, f"{tmp_path}/out").collect()[0]["run"] == 2
    tick(checkpoint="c2")  # a lost checkpoint: all ticks come again, as one batch
    assert calls[2:] == ["2024-01-01 10:10:00"] and spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert jobs.feature_snapshot(spark, f"{tmp_path}/out").collect()[0]["run"] == 3
    assert readers.messages(spark, "gold", "parquet", f"{tmp_path}/topic").count() == 2


def test_clock_ticks(spark):
    assert jobs.clock(spark).isStreaming and jobs.clock(spark).columns == ["timestamp"]


def test_feature_job_at_two_times(spark):
    root = streams.feature_stream(spark, SF, ("2024-01-20 12:00:00", AS_OF))
    rows = jobs.feature_snapshot(spark, f"{root}/snapshots")
    assert rows.select(F.max("window_end_time").cast("string")).first()[0] == AS_OF and rows.count() == 13
