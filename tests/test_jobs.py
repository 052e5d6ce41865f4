"""Streaming jobs and sinks: partitions, replays, databases, expiry, triggers."""

import json
import time
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fieldstream.functions.times import parse_timestamp
from fieldstream.operators import alerts, bronze, cache_rules, gold, silver
from fieldstream.plans import models, streams
from fieldstream.plans.registry import AS_OF, MINUTES
from fieldstream.plans.tables import SCORER
from fieldstream.schemas import ENVELOPE, SENSOR_RAW, SENSOR_VALID
from fieldstream.sources import fixtures, readers, sinks
from fieldstream.streaming import jobs, state

SF = "/root/testdata/sf0.001"
DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def test_gold_prunes_what_the_stream_wrote(spark):
    rows = streams.silver_files(spark, SF)
    plan = gold.sensor_features(rows, AS_OF, MINUTES)._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.splitlines() if "PartitionFilters" in x).split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in filters and ">=" in filters and "<=" in filters


def test_replayed_batch_leaves_one_copy(spark, tmp_path):
    rows = spark.range(6).withColumn("k", F.col("id") % 2)
    for n in (6, 4):  # the replay has fewer rows; nothing of the first try stays
        sinks.replace_batch(rows.where(F.col("id") < n), 3, f"{tmp_path}/t", ("k",))
    sinks.replace_batch(rows, 4, f"{tmp_path}/t", ("k",))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 10


def test_large_partition_value_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("2024-01-01").alias("date"), F.when(F.col("id") % 100 > 0, "field_01").otherwise("field_02").alias("field_id"))
        sinks.write_files(rows, f"{tmp_path}/t", "sensor")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in spark.read.parquet(f"{tmp_path}/t").inputFiles() if "field_01" in f]
    assert len(files) > 3 and spark.read.parquet(f"{tmp_path}/t").count() == 200_000


def test_alerts_go_to_a_database_and_a_topic(spark, tmp_path):
    url, table = f"jdbc:derby:{tmp_path}/db;create=true", "alerts"
    raw = fixtures.sensor(spark, SF)
    stream, root = jobs.stream_of(spark, raw, "jdbc")
    want = alerts.sensor(silver.sensor(raw), "event_id")
    sinks.write_jdbc(sinks.alert_rows(want).limit(0).withColumn("batch_id", F.lit(0).cast("long")), url, table, driver=DERBY)

    def insert(batch, batch_id):
        for _ in range(2):  # the second time is a replay
            sinks.insert_batch(batch, batch_id, url, table, driver=DERBY)

    jobs.drained(jobs.alert_job(silver.sensor(stream), lambda rows: alerts.sensor(rows, "event_id"), insert, f"{root}/checkpoint", jobs.file_broker(f"{root}/topic", "alerts"), jobs.NOW))
    found = readers.jdbc_table(spark, url, table, driver=DERBY)
    assert found.count() == want.count() == found.select("event_id").distinct().count() > 0
    assert {r["status"] for r in found.select("status").distinct().collect()} == {"ACTIVE"}
    assert readers.messages(spark, "alerts", "parquet", f"{root}/topic").count() == want.count()


def test_predictions_go_to_a_database(spark, tmp_path):
    from fieldstream.operators import ml

    url, table = f"jdbc:derby:{tmp_path}/db;create=true", "ml_predictions"
    columns = ("kafka_offset", "field_id", "anomaly_score", "is_anomaly", "severity", "recommendations", "model_version", "features")
    messages = fixtures.feature_messages(spark, SF)
    want = ml.scored(fixtures.features(spark, SF), SCORER, F.col("prediction_ts"))
    empty = want.limit(0).withColumns({"kafka_offset": F.col("id"), "features": F.lit("").cast("string")}).select(*columns)
    sinks.write_jdbc(empty.withColumn("batch_id", F.lit(0).cast("long")), url, table, driver=DERBY)
    insert = lambda batch, batch_id: sinks.insert_batch(batch.select(*columns), batch_id, url, table, driver=DERBY)
    stream, root = jobs.stream_of(spark, messages, "jdbc-predictions")
    from fieldstream.schemas import FEATURE_INPUT

    rows = readers.decoded(stream, FEATURE_INPUT)
    jobs.drained(jobs.prediction_job(rows, lambda: SCORER, insert, f"{root}/checkpoint", jobs.file_broker(f"{root}/topic", "anomalies"), jobs.NOW))
    found = readers.jdbc_table(spark, url, table, driver=DERBY)
    assert found.count() == want.count() > 0
    assert found.where("is_anomaly").count() == readers.messages(spark, "anomalies", "parquet", f"{root}/topic").count()
    assert '"temperature":' in found.first()["features"]


def test_a_batch_that_fails_before_its_commit_leaves_no_row(spark, tmp_path, monkeypatch):
    url, table = f"jdbc:derby:{tmp_path}/db;create=true", "t"
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b")], "key int, value string")
    sinks.write_jdbc(rows.limit(0).withColumn("batch_id", F.lit(0).cast("long")), url, table, driver=DERBY)
    there = lambda: sorted((r["batch_id"], r["value"]) for r in readers.jdbc_table(spark, url, table, driver=DERBY).collect())
    whole = sinks.transaction
    with monkeypatch.context() as m, pytest.raises(Exception, match="NO_SUCH"):
        m.setattr(sinks, "transaction", lambda s, u, statements, **p: whole(s, u, [*statements[:2], "DELETE FROM NO_SUCH_TABLE"], **p))
        sinks.insert_batch(rows, 4, url, table, driver=DERBY)
    assert there() == []
    for _ in range(2):  # the replay, and one more after the commit
        sinks.insert_batch(rows, 4, url, table, driver=DERBY)
    sinks.insert_batch(rows.limit(1), 5, url, table, driver=DERBY)
    assert there() == [(4, "a"), (4, "b"), (4, "b"), (5, "a")]


def test_predictions_follow_a_new_model(spark, tmp_path):
    rows = fixtures.features(spark, SF)
    from fieldstream.operators import ml

    model = ml.train(ml.filled(rows))
    save = lambda version, at: sinks.save_model(model, str(tmp_path), version, ml.model_record(models.history(spark, SF), version, at, 30, 10.0))
    save("v1", "2024-01-01 00:00:00")
    scorer = jobs.newest_scorer(spark, str(tmp_path))
    first = scorer()
    assert first.version == "v1" and scorer() is first
    save("v2", "2024-01-02 00:00:00")
    assert scorer().version == "v2" and scorer().centroids == first.centroids


ENVELOPE = "value binary, topic string, partition int, offset bigint, timestamp timestamp"


def reading(field, minute, offset, **other):
    row = {"field_id": field, "location": "l", "latitude": 1, "longitude": 2.5, "temperature": 10, "humidity": 50, "soil_ph": 6.5, "timestamp": f"2024-01-01T12:{minute:02}:00Z"} | other
    return (json.dumps({k: v for k, v in row.items() if v is not ...}).encode(), "t", 0, offset, datetime(2024, 1, 1, 13))


def test_latest_values_of_a_stream(spark, tmp_path):
    """The newest of each key by time and place, over several batches; refused messages with their reasons; expiry between batches."""

    def run(*rows, ttl=3600):
        spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = readers.message_stream(spark, "t", "parquet", path=f"{tmp_path}/in")
        jobs.drained(jobs.latest_job(stream, "sensor", f"{tmp_path}/checkpoint-{ttl}", jobs.file_table(f"{tmp_path}/rejects"), jobs.file_table(f"{tmp_path}/changes-{ttl}"), jobs.NOW, ttl))
        return {r["key"]: r["kafka_offset"] for r in jobs.latest_table(spark, f"{tmp_path}/checkpoint-{ttl}", "sensor", ttl).collect()}

    assert run(reading("a", 0, 1), reading("a", 0, 2), reading("b", 1, 3), reading("b", 9, 4, humidity=101), reading("c", 0, 5, timestamp=...)) == {"a": 2, "b": 3, "c": 5}
    assert run(reading("b", 0, 6), reading("a", 1, 7), reading("", 1, 8)) == {"a": 7, "b": 3, "c": 5}
    assert [r["kafka_offset"] for r in spark.read.parquet(f"{tmp_path}/changes-3600").where("batch_id = 1").collect()] == [7]
    rejects = {r["kafka_offset"]: r["reasons"] for r in spark.read.parquet(f"{tmp_path}/rejects").collect()}
    assert rejects == {4: ["humidity is out of range"], 8: ["field_id is empty"]}
    fresh = F.lit("2024-01-01 13:59:00").cast("timestamp")
    assert [r["key"] for r in jobs.latest_table(spark, f"{tmp_path}/checkpoint-3600", "sensor", as_of=fresh, ttl=3600).collect()] == ["c"]
    later = F.current_timestamp() + F.make_interval(hours=F.lit(2))
    assert state.held(spark, f"{tmp_path}/checkpoint-3600", later).count() == 0
    run(reading("d", 5, 20), ttl=2)
    time.sleep(3)
    run(reading("d", 1, 21), ttl=2)  # older, but what was held has expired between the batches
    assert [r["kafka_offset"] for r in spark.read.parquet(f"{tmp_path}/changes-2").where("batch_id = 1").collect()] == [21]


@pytest.mark.parametrize(
    ("kind", "text", "reasons"),
    [
        ("sensor", "[1]", ["no JSON object"]),
        ("sensor", "{", ["no JSON object"]),
        ("sensor", "{}", [f"{m} is missing" for m in ("field_id", "location", "latitude", "longitude", "temperature", "humidity", "soil_ph")]),
        ("sensor", '{"field_id": 1, "location": " ", "latitude": 90, "longitude": "2", "temperature": true, "humidity": null, "soil_ph": 9.01}', ["field_id is no text", "longitude is no number", "humidity is no number", "soil_ph is out of range"]),
        ("weather", '{"location": "l", "temp_c": -50, "humidity": 100, "wind_kph": 500.0, "uv": 2e1, "condition": "", "precip_mm": 1000.5}', ["condition is empty", "precip_mm is out of range"]),
        ("alert", '{"zone_id": "z", "alert_timestamp": null, "alert_type": "t", "severity": "s", "message": 7, "status": "ACTIVE"}', []),
        ("prediction", '{"field_id": "", "location": "", "anomaly_score": 1, "is_anomaly": 1, "severity": "", "recommendations": "", "model_version": "", "prediction_timestamp": "", "features": []}', ["is_anomaly is no boolean", "features is no object"]),
    ],
)
def test_reasons_of_refused_messages(spark, kind, text, reasons):
    rows = cache_rules.checked(spark.createDataFrame([(text.encode(), "t", 0, 1, datetime(2024, 1, 1))], ENVELOPE), kind)
    assert rows.select(cache_rules.reasons(kind, "failed").alias("r")).first()["r"] == reasons
    assert cache_rules.rejects(rows, kind).count() == bool(reasons)


def test_triggers():
    assert jobs._trigger("bronze", None) == {"processingTime": "30 seconds"} and jobs._trigger("satellite", None) == {"processingTime": "60 seconds"}
    assert jobs._trigger("gold", None) == {"processingTime": "0 seconds"} and jobs._trigger("silver", jobs.NOW) == jobs.NOW


@pytest.mark.parametrize(("master", "refused"), [("local[4]", False), ("local-cluster[2,1,1024]", True), ("spark://host:7077", True)])
def test_local_folders_only_where_all_is_local(master, refused):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    if refused:
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            sinks.work_dir(session, "x")
    else:
        assert sinks.work_dir(session, "x").startswith("file:///")


def test_kafka_options():
    assert readers.kafka_options("t", "host:9092", "latest", 500) == {"subscribe": "t", "kafka.bootstrap.servers": "host:9092", "startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "500"}
    assert "maxOffsetsPerTrigger" not in readers.kafka_options("t", "host:9092") and SCORER.version


def test_files_of_a_stream_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_BYTES", 20_000)
    messages = fixtures.satellite_messages(spark, SF)
    whole = messages.agg(F.sum(F.octet_length("value")).alias("n"), F.max(F.octet_length("value")).alias("most")).first()
    stream, root = jobs.stream_of(spark, messages, "sized")
    by_file = spark.read.parquet(f"{root}/in").groupBy(F.input_file_name().alias("f")).agg(F.sum(F.octet_length("value")).alias("n")).agg(F.count("*").alias("files"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    assert by_file["files"] >= whole["n"] // 20_000 > 4 and by_file["n"] == whole["n"]
    assert by_file["most"] < whole["n"] / 4


def test_a_backfill_gathers_the_rows_of_a_folder(spark):
    stream, root = jobs.stream_of(spark, fixtures.sensor_messages(spark, SF), "gathered", batches=1)
    jobs.drained(jobs.bronze_job(stream, bronze.sensor, f"{root}/bronze", f"{root}/checkpoint", jobs.NOW, gather=1))
    files = spark.read.schema("kafka_offset long").json(f"{root}/bronze").inputFiles()
    assert len(files) == len({f.rpartition("/")[0] for f in files})


def test_a_large_folder_of_a_backfill_is_split_by_size(spark, tmp_path):
    """A third of the messages has no time: that folder is no single task's, while small ones stay whole."""
    rows = fixtures.sensor_messages(spark, SF)
    rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("i").repartition(8).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        jobs.drained(jobs.bronze_job(stream, bronze.sensor, f"{tmp_path}/bronze", f"{tmp_path}/checkpoint", jobs.NOW, gather=1))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    out = spark.read.schema("kafka_offset long").json(f"{tmp_path}/bronze")
    assert out.count() == 40 * rows.count()
    assert sum("__HIVE_DEFAULT_PARTITION__" in f for f in out.inputFiles()) > 1


def test_messages_are_made_by_many_tasks_and_once(spark):
    rows = fixtures.sensor_messages(spark, SF, 6)
    assert rows.rdd.getNumPartitions() == 6 and sorted(rows.collect()) == sorted(fixtures.sensor_messages(spark, SF).collect())
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(topic):
        made.add(1)
        return topic

    stream, root = jobs.stream_of(spark, rows.withColumn("topic", counted("topic")), "once", dealt=6)
    assert made.value == rows.count() and len(spark.read.parquet(f"{root}/in").inputFiles()) == 6


def test_one_pattern_reads_what_two_did(spark):
    texts = ["2024-01-01T00:00:00.123456Z", "2024-01-01T00:00:00.123456+05:30", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00-01:00", "2024-01-01T00:00:00.1Z", "2024-01-01T00:00:00.1234567Z", "2024-01-01T00:00:00.Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00.123456", "2024-01-01 00:00:00Z", "2024-02-30T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01t00:00:00z", " 2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z.5", "2024-01-01T00:00:00+0100", "+12024-01-01T00:00:00Z", "not-a-time", "", ".", None]
    two = F.coalesce(*[F.try_to_timestamp("t", F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX")])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", two.alias("two"), parse_timestamp(F.col("t")).alias("one"))
    assert rows.where("NOT one <=> two").collect() == [] and rows.where("one IS NOT NULL").count() >= 4
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") == 3


def test_latest_values_are_reduced_before_they_meet_and_judged_once(spark, tmp_path):
    rows = [reading(f"f{i % 3}", i * 7 % 60, i) for i in range(900)] + [reading("", 1, 901), reading("f0", 1, 902, humidity=101)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(2).write.parquet(f"{tmp_path}/in")
    messages = readers.messages(spark, "t", "parquet", f"{tmp_path}/in")
    left = state.reduced(cache_rules.checked(messages, "sensor")).collect()
    assert sorted(r["kafka_offset"] for r in left if not r["valid"]) == [901, 902] and len([r for r in left if r["valid"]]) <= 6
    query = jobs.latest_job(readers.message_stream(spark, "t", "parquet", path=f"{tmp_path}/in"), "sensor", f"{tmp_path}/checkpoint", jobs.file_table(f"{tmp_path}/rejects"), trigger=jobs.NOW, ttl=3600)
    jobs.drained(query)
    best = {f"f{k}": max(((i * 7 % 60, i) for i in range(k, 900, 3)))[1] for k in range(3)}
    assert {r["key"]: r["kafka_offset"] for r in jobs.latest_table(spark, f"{tmp_path}/checkpoint", "sensor", 3600).collect()} == best
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 2
    assert "ReusedExchange" in query._jsq.explainInternal(False)


def test_reduced_takes_empty_frames_and_rows_without_key(spark):
    schema = "key string, message_time timestamp, kafka_partition int, kafka_offset bigint, value string, failed bigint"
    at = datetime(2024, 1, 1)
    rows = [(None, at, 0, 1, "v", 0), ("a", None, 0, 2, "v", 0), ("a", at, 1, 3, "v", 0), ("a", at, 0, 9, "v", 0), (None, None, 0, 5, "v", 4)]
    left = state.reduced(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert sorted((r["kafka_offset"], r["valid"]) for r in left) == [(3, True), (5, False)]
    assert state.reduced(spark.createDataFrame([], schema)).count() == 0


def _optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_messages_are_read_once_a_row(spark):
    """Filters on members of the JSON, as those of alerts, must not each read it anew."""
    messages = spark.createDataFrame([], ENVELOPE)
    assert _optimized(alerts.sensor(readers.decoded(messages, SENSOR_VALID), time="timestamp")).count("from_json(") == 1
    plan = _optimized(bronze.sensor(messages))
    assert plan.count("from_json(") == 1 and plan.count("get_json_object(") == 1 and "CASE WHEN" in plan.split("get_json_object(")[0].splitlines()[-1]
    rows = spark.createDataFrame([], f"{SENSOR_RAW}, kafka_offset bigint")
    assert _optimized(silver.sensor(rows)).count("gettimestamp(") == 1


def test_parse_ok_is_that_of_the_whole_text(spark):
    """The same as reading every text as JSON, also where fields are read from a faulty one."""
    g = '"timestamp":"2024-01-01T00:00:00+00:00","field_id":"f"'
    ends = ["", ',"temperature":1x', ',"temperature":NaN', ',"q":NaN', ',"temperature":-Infinity', ',"temperature":"NaN"', ',"temperature":"a"', ',"location":"a\\x"', ',"q":"a\\x"', ',"q":"a\nb"', ',"location":"a\nb"', ',"q":[1,2', ',"q":01', ',"q":1e999', ",", ',"q":' + "9" * 1200, ',"q":tru', ',"_fault":"z"', ',"location":{"a":1}']
    texts = [None, "", "x", "null", "1", "[]", "{}", "[1]", "{" + g, "{" + g + "} tail", "[{" + g + "}]", "[{" + g + "},{" + g + "]", "{'timestamp':'t'}", '{"timestamp":null}', '{"q":1}', *["{" + g + e + "}" for e in ends]]
    rows = [(None if t is None else bytearray(t.encode()), "t", 0, i, None) for i, t in enumerate(texts)] + [(bytearray(b'{"timestamp":"\xff"}'), "t", 0, len(texts), None)]
    text = F.col("value").cast("string")
    messages = spark.createDataFrame(rows, ENVELOPE)
    want = messages.select("offset", text.alias("raw_value"), F.get_json_object(text, "$").isNotNull().alias("parse_ok"), F.from_json(text, SENSOR_RAW).alias("d")).select("offset", "raw_value", "parse_ok", "d.*")
    found = bronze.decode(messages, SENSOR_RAW).withColumnRenamed("kafka_offset", "offset").select(*want.columns)
    assert repr(sorted(found.collect(), key=lambda r: r["offset"])) == repr(sorted(want.collect(), key=lambda r: r["offset"]))
    assert 5 < found.where("parse_ok").count() < len(rows) - 5


def test_text_without_time_needs_no_exception(spark):
    texts = ["2024-01-01T00:00:00+00:00", "2024-01-01t00:00:00z", "2024-01-01T00:00:00.123456Z", "2024-01-01", "", None, ":", "+12024-01-01T00:00:00Z", "2024-02-30T00:00:00Z", "not-a-time"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = rows.select(parse_timestamp("t").cast("string").alias("a"), F.try_to_timestamp("t", F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")).cast("string").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in found) and sum(r["a"] is not None for r in found) == 4
    assert "contains(" in _optimized(rows.select(parse_timestamp("t"))).lower()
