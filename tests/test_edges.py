"""Hand-written edge rows: range ends, nulls, broken messages, times, ties, empty inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldstream.functions.times import normalised_image_time, parse_timestamp, utc
from fieldstream.operators import alerts, bronze, cache_rules, gold, latest, ml, reports, silver
from fieldstream.plans import models
from fieldstream.schemas import CORE_FEATURES
from fieldstream.sources import readers, sinks

SENSOR = "timestamp string, field_id string, location string, latitude double, longitude double, temperature double, humidity double, soil_ph double"
T = "2024-01-15T12:00:00+00:00"


def sensor(spark, *rows):
    return spark.createDataFrame([(T, "f", "l", *r) for r in rows], SENSOR)


@pytest.mark.parametrize(("row", "valid"), [((90.0, 180.0, -20.0, 0.0, 3.0), True), ((-90.0, -180.0, 60.0, 100.0, 9.0), True), ((0.0, 0.0, -20.01, 50.0, 6.0), False), ((0.0, 0.0, 60.01, 50.0, 6.0), False), ((None, 0.0, 10.0, 50.0, 6.0), False)])
def test_closed_ranges(spark, row, valid):
    assert (silver.sensor(sensor(spark, row)).count() == 1) is valid


@pytest.mark.parametrize(("size", "valid"), [(1000, False), (1001, True), (49_999_999, True), (50_000_000, False)])
def test_open_image_size(spark, size, valid):
    rows = spark.createDataFrame([(T, "p", size, 0.0, 0.0, 1.0, 1.0)], "timestamp string, image_path string, image_size_bytes int, bbox_min_lon double, bbox_min_lat double, bbox_max_lon double, bbox_max_lat double")
    assert (silver.satellite(rows).count() == 1) is valid


def test_rows_without_a_time_are_dropped(spark):
    schema = SENSOR
    rows = spark.createDataFrame([(t, "f", "l", 0.0, 0.0, 50.0, 50.0, 6.0) for t in (T, "not-a-time", "", None)], schema)
    assert silver.sensor_flagged(rows).count() == 1 and alerts.sensor(silver.sensor(rows)).where("alert_timestamp IS NULL").count() == 0


def test_times(spark):
    texts = ["2024-01-15T12:00:00.123456+02:00", "2024-01-15T12:00:00+02:00", "2024-01-15T12:00:00Z", "2024-01-15T12:00:00", "bad", None]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(utc(parse_timestamp(F.col("t")))).collect()]
    assert found == [datetime(2024, 1, 15, 10, 0, 0, 123456), datetime(2024, 1, 15, 10), datetime(2024, 1, 15, 12), None, None, None]
    local = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(normalised_image_time("t")).collect()]
    assert local[1] == datetime(2024, 1, 15, 11) and local[2] == datetime(2024, 1, 15, 13) and local[3] == datetime(2024, 1, 15, 12) and local[4] is None


def envelope(spark, *values):
    return spark.createDataFrame([(v.encode() if v is not None else None, "t", 0, i, datetime(2024, 1, 1)) for i, v in enumerate(values)], "value binary, topic string, partition int, offset bigint, timestamp timestamp")


def test_messages(spark):
    rows = bronze.weather(envelope(spark, '{"location": "a", "humidity": 55.5, "more": 1}', '{"location": "b"', None, '{"location": null}')).orderBy("kafka_offset").collect()
    assert rows[0]["location"] == "a" and rows[0]["humidity"] is None and rows[0]["parse_ok"]
    assert not rows[1]["parse_ok"] and not rows[2]["parse_ok"]
    assert rows[3]["location"] is None


def test_boxes(spark):
    image = "aGVsbG8="
    rows = bronze.satellite(envelope(spark, f'{{"timestamp": "{T}", "image_base64": "{image}"}}', f'{{"timestamp": "x", "image_base64": "{image}", "location": {{"bbox": [1, 2]}}}}', '{"image_base64": ""}', "{}")).orderBy("kafka_offset").collect()
    assert [r["image_size_bytes"] for r in rows] == [5, 5]
    assert rows[0]["bbox_max_lat"] == 0.0 and rows[1]["bbox_min_lat"] == 2.0 and rows[1]["bbox_max_lat"] is None


@pytest.mark.parametrize(("t", "h", "ph", "severity"), [(5.0, 50.0, 7.0, None), (4.9, 50.0, 7.0, "MEDIUM"), (-0.1, 50.0, 7.0, "HIGH"), (40.0, 90.0, 8.0, None), (20.0, 95.0, 7.0, "MEDIUM"), (20.0, 95.1, 7.0, "HIGH"), (20.0, 50.0, 5.5, None), (20.0, 50.0, 4.4, "HIGH")])
def test_alert_cuts(spark, t, h, ph, severity):
    found = alerts.sensor(silver.sensor(sensor(spark, (0.0, 0.0, t, h, ph)))).collect()
    assert [r["severity"] for r in found] == ([severity] if severity else [])


def test_severity_cuts(spark):
    rows = spark.createDataFrame([(d,) for d in (0.5, 0.51, 1.0, 1.01, 4.0, 4.01)], "d double").select(ml.severity(F.col("d"))).collect()
    assert [r[0] for r in rows] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_features_of_small_groups(spark):
    rows = silver.sensor_flagged(sensor(spark, (0.0, 0.0, 10.0, 50.0, 6.0))).withColumn("timestamp_parsed", utc("timestamp_parsed"))
    found = gold.sensor_features(rows, "2024-01-15 12:05:00").collect()
    assert found[0]["sensor_std_temperature"] is None and found[0]["sensor_readings_count"] == 1
    assert gold.sensor_features(rows.limit(0), "2024-01-15 12:05:00").count() == 0
    tied = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1)], "k string, month int").groupBy("k").agg(F.mode("month", True).alias("m"))
    assert tied.first()["m"] == 1


def test_latest_ties_and_ttl(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", at(0), 1), ("a", at(0), 2), ("b", at(1), 1), (None, at(1), 1)], "field_id string, t timestamp_ntz, offset int")
    found = {r["field_id"]: r["offset"] for r in latest.latest(rows, "sensor", "2024-01-01 00:05:00", "t", ("offset",)).collect()}
    assert found == {"a": 2, "b": 1}
    assert latest.latest(rows, "sensor", "2024-01-01 00:05:01", "t", ("offset",)).count() == 1


def test_latest_as_of_the_newest_row(spark):
    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = spark.createDataFrame([("a", at(0), 1), ("a", at(0), 2), ("b", at(1), 1), ("c", None, 1), (None, at(301), 1)], "field_id string, t timestamp_ntz, offset int")
    found = latest.latest_as_of_newest(rows, "sensor", "t", ("offset",)).collect()
    assert [(r["field_id"], r["offset"], r["cached_at"], r["cache_ttl"]) for r in found] == [("b", 1, at(301), 300)]
    assert {r["field_id"]: r["offset"] for r in latest.latest_as_of_newest(rows.where("field_id IS NOT NULL"), "sensor", "t", ("offset",)).collect()} == {"a": 2, "b": 1}
    assert latest.latest_as_of_newest(rows.limit(0), "sensor", "t", ("offset",)).count() == 0


def test_medians_of_nothing(spark):
    schema = ", ".join(f"{c} double" for c in CORE_FEATURES)
    rows = spark.createDataFrame([(None,) * 10], schema)
    assert ml.filled(rows).first()["sensor_avg_temperature"] == 0.0


def test_sketched_medians(spark):
    schema = "day int, " + ", ".join(f"{c} double" for c in CORE_FEATURES)
    rows = spark.createDataFrame([(i % 7, float(i), None, *[1.0] * 8) for i in range(20_000)], schema)
    days = ml.sketches(rows, F.col("day")).cache()
    middle = ml.sketched_medians(days).first()
    assert days.count() == 7 and abs(middle[0] - 10_000) < 200 and middle[1] == 0.0 and middle[2] == 1.0
    assert ml.sketched_medians(days.limit(0)).first()[0] == 0.0
    assert ml.filled(rows, middle=ml.sketched_medians(days)).where(f"{CORE_FEATURES[1]} = 0").count() == 20_000


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "z", None), (2, "y", "RESOLVED")], "id long, zone_id string, status string")
    sinks.write_jdbc(sinks.alert_rows(rows), url, "alerts", driver="org.apache.derby.jdbc.EmbeddedDriver")
    found = readers.jdbc_table(spark, url, "alerts", driver="org.apache.derby.jdbc.EmbeddedDriver").orderBy("id").collect()
    assert [r["status"] for r in found] == ["ACTIVE", "RESOLVED"]


def test_newest_image(spark, tmp_path):
    import os

    for i, name in enumerate(("b.png", "a.png")):
        (tmp_path / name).write_bytes(name.encode())
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    assert bytes(readers.newest_image(spark, str(tmp_path)).first()["content"]) == b"a.png"


def test_conditions_and_center_of_nothing(spark):
    empty = spark.createDataFrame([], "latitude double, longitude double")
    assert reports.map_center(empty).first()["latitude"] == 45.4384


def test_message_files_and_stream(spark, tmp_path):
    sinks.publish(envelope(spark, '{"a":1}', '{"a":2}'), "parquet", f"{tmp_path}/m")
    assert readers.messages(spark, "t", "parquet", f"{tmp_path}/m").count() == 2
    stream = readers.message_stream(spark, "t", "parquet", path=f"{tmp_path}/m", per_trigger=1)
    query = stream.writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("m").count() == 2
    with pytest.raises(ValueError, match="no start at"):  # never ignored without notice
        readers.message_stream(spark, "t", "parquet", path=f"{tmp_path}/m", starting="latest")


def test_saved_cost_is_that_of_the_saved_centres(spark):
    """On these rows training stops after its last allowed step, before the centres stand still."""
    found = models.ml_train_invariants(spark, "/root/testdata/sf0.1").first()
    assert found.asDict() == {"n_rows": 100_000, "n_not_nearest": 0, "cost_agrees": True, "n_centres_at_means": 3}


@pytest.mark.parametrize("kind", ["sensor", "prediction"])
def test_a_message_is_judged_once(spark, kind):
    """Neither the filter of refused messages nor their reasons parse a message anew."""
    refused = cache_rules.rejects(cache_rules.checked(envelope(spark, "{}"), kind), kind).select("kafka_offset", "reasons")
    plan = refused._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1
