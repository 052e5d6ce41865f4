"""Streaming jobs run to their end over messages derived from the test tables; each must equal its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import utc
from ..operators import alerts, bronze, cache_rules, gold, latest, panes, silver
from ..schemas import ALERT, FEATURE_INPUT, IMAGE, LATEST, PREDICTION, SENSOR_RAW, SENSOR_VALID, WEATHER_RAW, WEATHER_VALID
from ..sources import fixtures, readers, sinks
from ..streaming import jobs
from .layers import GOLD_CTE, GOLD_SQL, IMAGE_SQL, SATELLITE_CTE, SENSOR_ALERT_SQL, SENSOR_CTE, WEATHER_ALERT_SQL, WEATHER_CTE, rounded, sensor_features_sql
from .registry import AS_OF, MINUTES, query
from .tables import PREDICTIONS_CTE, SCORER, prediction_table

_SENSOR_TOPIC, _WEATHER_TOPIC, _ALERT_TOPIC, _ANOMALY_TOPIC = "sensor_valid", "weather_valid", "alerts", "anomalies"


def _parts(spark: SparkSession, sf_dir: str, row_bytes: int = 256) -> int:
    """Partitions for messages of so many bytes of the events, whose rows are only counted."""
    return jobs.n_files(spark, row_bytes * readers.table(spark, sf_dir, "events").count())


def _bronze(spark: SparkSession, messages: DataFrame, decode, name: str, dealt: int, keys: tuple[str, ...] | None = ("year", "month"), gather: int | None = None) -> str:
    """The raw layer that a stream of the messages, dealt to so many partitions, leaves, by default by month, as it holds all days at once; returns its root."""
    stream, root = jobs.stream_of(spark, messages, name, dealt=dealt)
    jobs.drained(jobs.bronze_job(stream, decode, f"{root}/bronze", f"{root}/checkpoint/bronze", jobs.NOW, keys=keys, gather=gather))
    return root


def _silver(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Messages through the raw to the validated layer, whose messages go to a topic of files; returns the root."""
    messages, decode, raw, refine, members, topic = {
        "sensor": (fixtures.sensor_messages, bronze.sensor, SENSOR_RAW, silver.sensor, silver.SENSOR_MESSAGE, _SENSOR_TOPIC),
        "weather": (fixtures.weather_messages, bronze.weather, WEATHER_RAW, silver.weather, silver.WEATHER_MESSAGE, _WEATHER_TOPIC),
    }[kind]
    n = _parts(spark, sf_dir)
    root = _bronze(spark, messages(spark, sf_dir, n), decode, f"silver-{kind}", n)
    rows = readers.json_stream(spark, f"{root}/bronze", f"{raw}, kafka_offset bigint")
    minutes = (f"{root}/panes", {"sensor": panes.SENSOR, "weather": panes.WEATHER}[kind])
    jobs.drained(jobs.silver_job(rows, refine, members, kind, f"{root}/silver", f"{root}/checkpoint/silver", jobs.file_broker(f"{root}/topic", topic), jobs.NOW, minutes))
    return root


def _topic(spark: SparkSession, root: str, topic: str, schema: str, key: str = "field_id") -> DataFrame:
    return readers.decoded(readers.message_stream(spark, topic, "parquet", path=f"{root}/topic"), schema, key)


@query(f"WITH s AS ({fixtures.sql('sensor')}) SELECT event_id AS kafka_offset, field_id, temperature, CASE WHEN event_id % 3 < 2 THEN CAST(hour(event_ts) AS INTEGER) END AS hour FROM s")
def stream_bronze_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw layer in its production layout, a folder an hour."""
    n = _parts(spark, sf_dir)
    root = _bronze(spark, fixtures.sensor_messages(spark, sf_dir, n), bronze.sensor, "bronze", n, keys=None, gather=1)
    out = spark.read.schema("kafka_offset long, field_id string, temperature double, hour int").json(f"{root}/bronze")
    return out.select("kafka_offset", "field_id", "temperature", "hour")


def _images(spark: SparkSession, sf_dir: str) -> str:
    stream, root = jobs.stream_of(spark, fixtures.satellite_messages(spark, sf_dir), "images")
    jobs.drained(jobs.image_job(stream, f"{root}/bronze", f"{root}/images", f"{root}/checkpoint/images", jobs.NOW, keys=("year", "month", "day")))
    return root


@query(f"WITH i AS ({IMAGE_SQL}) SELECT kafka_offset, image_path, image_size_bytes, CAST(image_size_bytes AS BIGINT) AS stored_bytes FROM i")
def stream_bronze_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of images, and the size of the object that was stored for each."""
    root = _images(spark, sf_dir)
    stored = spark.read.parquet(f"{root}/images").select("image_path", F.octet_length("image").cast("long").alias("stored_bytes"))
    return spark.read.schema(IMAGE).json(f"{root}/bronze").select("kafka_offset", "image_path", "image_size_bytes").join(stored, "image_path")


@query(f"WITH i AS ({IMAGE_SQL}) SELECT max_by(image_path, (local_timestamp, kafka_offset)) AS name, max_by(CAST(image_size_bytes AS BIGINT), (local_timestamp, kafka_offset)) AS n_bytes FROM i")
def latest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest image that the stream has stored."""
    found = readers.newest_stored_image(spark, f"{_images(spark, sf_dir)}/images")
    return found.select(F.col("image_path").alias("name"), F.octet_length("image").cast("long").alias("n_bytes"))


@query(f"WITH {SENSOR_CTE} SELECT event_id, field_id, timestamp_parsed, temperature FROM s_ok")
def stream_silver_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _silver(spark, sf_dir, "sensor")
    return spark.read.parquet(f"{root}/silver").select(F.col("kafka_offset").alias("event_id"), "field_id", utc("timestamp_parsed").alias("timestamp_parsed"), "temperature")


@query(f"WITH {WEATHER_CTE} SELECT event_id, location, timestamp_parsed, temp_c, humidity FROM w_ok")
def stream_silver_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _silver(spark, sf_dir, "weather")
    rows = spark.read.parquet(f"{root}/silver")
    return rows.select(F.col("kafka_offset").alias("event_id"), "location", utc("timestamp_parsed").alias("timestamp_parsed"), "temp_c", F.col("humidity").cast("long").alias("humidity"))


@query(f"WITH i AS ({IMAGE_SQL}) SELECT kafka_offset, image_size_bytes, DATE '2024-01-15' AS date FROM i WHERE image_size_bytes > 1000 AND image_size_bytes < 50000000 AND bbox_min_lon BETWEEN -180 AND 180 AND bbox_max_lon BETWEEN -180 AND 180 AND bbox_min_lat BETWEEN -90 AND 90 AND bbox_max_lat BETWEEN -90 AND 90 AND bbox_min_lon < bbox_max_lon AND bbox_min_lat < bbox_max_lat")
def stream_silver_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _images(spark, sf_dir)
    rows = readers.json_stream(spark, f"{root}/bronze", IMAGE)
    jobs.drained(jobs.silver_job(rows, silver.satellite, (), "satellite", f"{root}/silver", f"{root}/checkpoint/silver", trigger=jobs.NOW))
    return spark.read.parquet(f"{root}/silver").select("kafka_offset", "image_size_bytes", "date")


@query(f"WITH {SENSOR_CTE} SELECT field_id, location, temperature, date_trunc('millisecond', timestamp_parsed) AS timestamp FROM s_ok")
def stream_valid_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated readings that went to their topic."""
    root = _silver(spark, sf_dir, "sensor")
    rows = readers.decoded(readers.messages(spark, _SENSOR_TOPIC, "parquet", f"{root}/topic"), SENSOR_VALID)
    return rows.select("field_id", "location", "temperature", utc("timestamp").alias("timestamp"))


def silver_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated readings that the stream wrote, compacted to few files."""
    root = _silver(spark, sf_dir, "sensor")
    sinks.compact(spark, f"{root}/silver", f"{root}/compact", "sensor")
    return spark.read.parquet(f"{root}/compact").withColumn("timestamp_parsed", utc("timestamp_parsed"))


@query(f"WITH {SENSOR_CTE} SELECT date, field_id, count(*) AS n FROM s_ok GROUP BY ALL")
def silver_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_files(spark, sf_dir).groupBy("date", "field_id").agg(F.count("*").alias("n"))


@query(sensor_features_sql("s_ok"))
def gold_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor features of the look-back over what the stream wrote; its date partitions are pruned."""
    rows = silver_files(spark, sf_dir)
    return rounded(gold.sensor_features(rows, AS_OF, MINUTES).select("field_id", "location", "sensor_avg_temperature", "sensor_readings_count", "sensor_last_reading"))


def features_at(spark: SparkSession, sensors: str, weather: str, fields: DataFrame) -> Callable[[str], DataFrame]:
    """The feature table of a time from the panes and validated files below the roots of the two streams."""

    def valid(root: str) -> DataFrame:
        return spark.read.parquet(f"{root}/silver").withColumn("timestamp_parsed", utc("timestamp_parsed"))

    return lambda as_of: panes.features(spark.read.parquet(f"{sensors}/panes"), valid(sensors), spark.read.parquet(f"{weather}/panes"), valid(weather), fields, as_of, MINUTES)


def feature_stream(spark: SparkSession, sf_dir: str, times: tuple[str, ...] = (AS_OF,)) -> str:
    """A periodic feature job over what the streams have written, at the given times; returns its root."""
    sensors, weather = _silver(spark, sf_dir, "sensor"), _silver(spark, sf_dir, "weather")
    ticks = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("timestamp")).coalesce(1)
    clock, root = jobs.stream_of(spark, ticks, "features", batches=None)
    found = features_at(spark, sensors, weather, fixtures.fields(spark, sf_dir))
    jobs.drained(jobs.feature_job(clock, found, f"{root}/snapshots", f"{root}/checkpoint", jobs.file_broker(f"{root}/topic", "gold_features"), jobs.NOW))
    return root


@query(GOLD_SQL)
def stream_gold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that the periodic job leaves, from panes of the streams."""
    return rounded(jobs.feature_snapshot(spark, f"{feature_stream(spark, sf_dir)}/snapshots"))


@query(f"WITH {GOLD_CTE} SELECT field_id, location, sensor_readings_count, weather_dominant_condition FROM fields LEFT JOIN both_sides USING (field_id)")
def stream_gold_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the periodic job has published."""
    schema = "field_id string, location string, sensor_readings_count bigint, weather_dominant_condition string"
    return readers.decoded(readers.messages(spark, "gold_features", "parquet", f"{feature_stream(spark, sf_dir)}/topic"), schema).drop("kafka_partition", "kafka_offset")


def _alerts(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Alerts of the validated messages of a topic, to a table and to a topic; returns the root."""
    root = _silver(spark, sf_dir, kind)
    topic, schema, rule, key = {"sensor": (_SENSOR_TOPIC, SENSOR_VALID, alerts.sensor, "field_id"), "weather": (_WEATHER_TOPIC, WEATHER_VALID, alerts.weather, "location")}[kind]
    valid = _topic(spark, root, topic, schema, key)
    jobs.drained(jobs.alert_job(valid, lambda rows: rule(rows, time="timestamp"), jobs.file_table(f"{root}/alerts"), f"{root}/checkpoint/alerts", jobs.file_broker(f"{root}/alert-topic", _ALERT_TOPIC), jobs.NOW))
    return root


def _alert_sql(rows: str) -> str:
    return f"SELECT zone_id, date_trunc('millisecond', alert_timestamp) AS alert_timestamp, severity, message, status FROM ({rows})"


def _alert_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/alerts").select("zone_id", utc("alert_timestamp").alias("alert_timestamp"), "severity", "message", "status")


@query(f"WITH {SENSOR_CTE} " + _alert_sql(SENSOR_ALERT_SQL))
def stream_sensor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_rows(spark, _alerts(spark, sf_dir, "sensor"))


@query(f"WITH {WEATHER_CTE} " + _alert_sql(WEATHER_ALERT_SQL))
def stream_weather_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_rows(spark, _alerts(spark, sf_dir, "weather"))


@query(f"WITH {SENSOR_CTE} SELECT zone_id, alert_type, severity, message, status FROM ({SENSOR_ALERT_SQL})")
def stream_alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that went to their topic."""
    root = _alerts(spark, sf_dir, "sensor")
    rows = readers.decoded(readers.messages(spark, _ALERT_TOPIC, "parquet", f"{root}/alert-topic"), ALERT, "zone_id")
    return rows.select("zone_id", "alert_type", "severity", "message", "status")


def _predictions(spark: SparkSession, sf_dir: str) -> str:
    """Feature messages scored to a table and, if anomalies, to a topic; returns the root."""
    n = _parts(spark, sf_dir, 512)
    stream, root = jobs.stream_of(spark, fixtures.feature_messages(spark, sf_dir, n), "predictions", dealt=n)
    rows = readers.decoded(stream, FEATURE_INPUT)
    jobs.drained(jobs.prediction_job(rows, lambda: SCORER, jobs.file_table(f"{root}/out"), f"{root}/checkpoint", jobs.file_broker(f"{root}/topic", _ANOMALY_TOPIC), jobs.NOW))
    return root


@query(f"WITH {PREDICTIONS_CTE} SELECT id, severity, is_anomaly, round(anomaly_score, 4) AS anomaly_score FROM predictions")
def stream_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_predictions(spark, sf_dir)}/out")
    return rounded(rows.select(F.col("kafka_offset").alias("id"), "severity", "is_anomaly", "anomaly_score"))


@query(f"WITH {PREDICTIONS_CTE} SELECT field_id, location, severity, recommendations, model_version, sensor_avg_temperature AS temperature FROM predictions WHERE is_anomaly")
def stream_anomaly_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomalies, and only they, that went to their topic."""
    root = _predictions(spark, sf_dir)
    rows = readers.decoded(readers.messages(spark, _ANOMALY_TOPIC, "parquet", f"{root}/topic"), PREDICTION)
    return rows.select("field_id", "location", "severity", "recommendations", "model_version", F.col("features.temperature").alias("temperature"))


@query(
    f"""WITH {SENSOR_CTE} SELECT time_bucket(INTERVAL 10 MINUTE, timestamp_parsed) AS window_start, field_id, location, count(*) AS sensor_readings_count, round(avg(temperature), 4) AS sensor_avg_temperature
    FROM s_ok, (SELECT max(timestamp_parsed) AS newest FROM s_ok) WHERE time_bucket(INTERVAL 10 MINUTE, timestamp_parsed) + INTERVAL 10 MINUTE <= newest - INTERVAL 10 MINUTE GROUP BY ALL"""
)
def stream_gold_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed. All files are one batch, so that no reading comes after the watermark and is dropped."""
    rows, root = jobs.stream_of(spark, silver.sensor(fixtures.sensor(spark, sf_dir)), "gold", batches=None)
    jobs.drained(jobs.gold_job(rows, ("field_id", "location"), gold.sensor_aggregates(), f"{root}/out", f"{root}/checkpoint", trigger=jobs.NOW))
    out = spark.read.parquet(f"{root}/out").withColumn("window_start", utc("window_start"))
    return rounded(out.select("window_start", "field_id", "location", "sensor_readings_count", "sensor_avg_temperature"))


#: Seconds that the values of these queries live: some keys are older.
_TTL = 36 * 3600


#: Bytes of a message of these queries, about.
_ROW_BYTES = 512


def _cached(spark: SparkSession, sf_dir: str, messages: Callable[[SparkSession, str, int], DataFrame], kind: str) -> str:
    """A latest_job over the messages, run to its end; returns its root."""
    n = _parts(spark, sf_dir, _ROW_BYTES)
    stream, root = jobs.stream_of(spark, messages(spark, sf_dir, n), f"latest-{kind}", dealt=n)
    jobs.drained(jobs.latest_job(stream, kind, f"{root}/checkpoint", jobs.file_table(f"{root}/rejects"), trigger=jobs.NOW, ttl=_TTL))
    return root


def _latest(spark: SparkSession, sf_dir: str, messages: Callable[[SparkSession, str, int], DataFrame], kind: str) -> DataFrame:
    """The latest value of each key of a topic, as of its newest valid message, which is the newest that the state holds."""
    root = _cached(spark, sf_dir, messages, kind)
    held = jobs.latest_table(spark, f"{root}/checkpoint", kind, _TTL).select(utc("message_time").alias("t"))
    found = jobs.latest_table(spark, f"{root}/checkpoint", kind, _TTL, F.lit(latest.newest_time(held, "t")).cast("timestamp"))
    return found.select("key", utc("message_time").alias("message_time"), "cache_ttl")


def _latest_sql(rows: str, kind: str, time: str) -> str:
    key, _ = LATEST[kind]
    ms = f"date_trunc('millisecond', {time})"
    return f"SELECT {key} AS key, max({ms}) AS message_time, {_TTL} AS cache_ttl FROM {rows} GROUP BY {key} HAVING max({ms}) >= (SELECT max({ms}) FROM {rows}) - INTERVAL {_TTL} SECOND"


def _as_messages(rows: DataFrame, topic: str, offset: str) -> DataFrame:
    value = F.to_json(F.struct(*[c for c in rows.columns if c != offset])).cast("binary").alias("value")
    return rows.select(value, F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.col(offset).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))


def _sensor_readings(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Messages of all readings that are complete and have a time; those that are out of range must not be kept."""
    rows = silver.sensor_flagged(fixtures.sensor(spark, sf_dir, parts)).select("event_id", *silver.SENSOR_MESSAGE, F.col("timestamp_parsed").alias("timestamp"))
    return _as_messages(rows, _SENSOR_TOPIC, "event_id")


def _weather_readings(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    rows = silver.weather_flagged(fixtures.weather(spark, sf_dir, parts)).select("event_id", *silver.WEATHER_MESSAGE, F.col("timestamp_parsed").alias("timestamp"))
    return _as_messages(rows, _WEATHER_TOPIC, "event_id")


def _alert_messages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Alerts of which every 20th has an empty zone, every 21st no message, and every 22nd a number as its status."""
    e = F.col("event_id")
    rows = alerts.sensor(silver.sensor(fixtures.sensor(spark, sf_dir, parts)), "event_id").withColumns({"zone_id": F.when(e % 20 == 0, "").otherwise(F.col("zone_id")), "message": F.when(e % 21 != 0, F.col("message"))})
    messages = _as_messages(rows, _ALERT_TOPIC, "event_id")
    numbered = F.regexp_replace(F.col("value").cast("string"), '"status":"ACTIVE"', '"status":1').cast("binary")
    return messages.withColumn("value", F.when(F.col("offset") % 22 == 0, numbered).otherwise(F.col("value")))


def _prediction_messages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Predictions of which every 25th has no location, every 26th a text for a boolean, and every 27th is cut short."""
    columns = ("id", "field_id", "location", "anomaly_score", "is_anomaly", "severity", "recommendations", "model_version")
    rows = prediction_table(spark, sf_dir, parts).select(*columns, F.col("prediction_timestamp").cast("timestamp").alias("prediction_timestamp"), F.struct("temp_differential").alias("features"))
    messages = _as_messages(rows.withColumn("location", F.when(F.col("id") % 25 != 0, F.col("location"))), _ANOMALY_TOPIC, "id")
    text, at = F.col("value").cast("string"), F.col("offset")
    odd = F.when(at % 27 == 0, F.substring(text, 1, 40)).when(at % 26 == 0, F.regexp_replace(text, '"is_anomaly":(true|false)', '"is_anomaly":"$1"')).otherwise(text)
    return messages.withColumn("value", odd.cast("binary"))


_ALERTS_OK = f"a AS (SELECT * FROM ({SENSOR_ALERT_SQL}) WHERE event_id % 20 <> 0 AND event_id % 21 <> 0 AND event_id % 22 <> 0)"
_PREDICTIONS_OK = "p AS (SELECT * FROM predictions WHERE id % 25 <> 0 AND id % 26 <> 0 AND id % 27 <> 0)"


@query(f"WITH {SENSOR_CTE} " + _latest_sql("s_ok", "sensor", "timestamp_parsed"))
def stream_latest_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, _sensor_readings, "sensor")


@query(f"WITH {WEATHER_CTE} " + _latest_sql("w_ok", "weather", "timestamp_parsed"))
def stream_latest_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, _weather_readings, "weather")


@query(f"WITH {SENSOR_CTE}, {_ALERTS_OK} " + _latest_sql("a", "alert", "alert_timestamp"))
def stream_latest_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, _alert_messages, "alert")


@query(f"WITH {PREDICTIONS_CTE}, {_PREDICTIONS_OK} " + _latest_sql("p", "prediction", "prediction_timestamp"))
def stream_latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, _prediction_messages, "prediction")


@query(f"WITH {SENSOR_CTE} SELECT count(*) AS n_keys, min(field_id) AS first_key, max(field_id) AS last_key FROM (SELECT DISTINCT field_id FROM s_ok)")
def stream_latest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the keys that the state holds."""
    found = jobs.latest_table(spark, f"{_cached(spark, sf_dir, _sensor_readings, 'sensor')}/checkpoint", "sensor", _TTL)
    return found.agg(F.count("*").alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


# ---- refused messages --------------------------------------------------------------------


def _reasons_sql(cases: tuple[tuple[str, str], ...], rows: str, place: str) -> str:
    """Place and reasons, joined by commas, of the rows that have any; cases are (reason, condition)."""
    found = ", ".join(f"CASE WHEN {condition} THEN '{reason}' END" for reason, condition in cases)
    return f"SELECT * FROM (SELECT {place} AS kafka_offset, concat_ws(', ', {found}) AS reasons FROM {rows}) WHERE reasons <> ''"


def _refused(rows: DataFrame) -> DataFrame:
    return rows.select("kafka_offset", F.array_join("reasons", ", ").alias("reasons"))


def _range_cases(members: tuple[tuple[str, float, float], ...]) -> tuple[tuple[str, str], ...]:
    return tuple(c for m, low, high in members for c in ((f"{m} is missing", f"{m} IS NULL"), (f"{m} is out of range", f"NOT {m} BETWEEN {low} AND {high}")))


_SENSOR_CASES = _range_cases((("latitude", -90, 90), ("longitude", -180, 180), ("temperature", -20, 60), ("humidity", 0, 100), ("soil_ph", 3, 9)))
_WEATHER_CASES = _range_cases((("temp_c", -50, 60), ("humidity", 0, 100), ("wind_kph", 0, 500), ("uv", 0, 20)))


@query(f"WITH s AS ({fixtures.sql('sensor')}) " + _reasons_sql(_SENSOR_CASES, "s", "event_id"))
def cache_rejects_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused raw readings with their reasons."""
    return _refused(cache_rules.rejects(cache_rules.checked(fixtures.sensor_messages(spark, sf_dir), "sensor"), "sensor"))


@query(f"WITH w AS ({fixtures.sql('weather')}) " + _reasons_sql((*_WEATHER_CASES, ("condition is missing", "condition IS NULL"), *_range_cases((("precip_mm", 0, 1000),))), "w", "event_id"))
def cache_rejects_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refused(cache_rules.rejects(cache_rules.checked(fixtures.weather_messages(spark, sf_dir), "weather"), "weather"))


_ALERT_CASES = (("zone_id is empty", "event_id % 20 = 0"), ("message is missing", "event_id % 21 = 0"), ("status is no text", "event_id % 22 = 0"))


@query(f"WITH {SENSOR_CTE}, a AS ({SENSOR_ALERT_SQL}) " + _reasons_sql(_ALERT_CASES, "a", "event_id"))
def cache_rejects_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of latest alerts has refused, from its table of rejects."""
    root = _cached(spark, sf_dir, _alert_messages, "alert")
    return _refused(spark.read.parquet(f"{root}/rejects"))


_PREDICTION_CASES = (("no JSON object", "id % 27 = 0"), ("location is missing", "id % 25 = 0 AND id % 27 <> 0"), ("is_anomaly is no boolean", "id % 26 = 0 AND id % 27 <> 0"))


@query(f"WITH {PREDICTIONS_CTE} " + _reasons_sql(_PREDICTION_CASES, "predictions", "id"))
def cache_rejects_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _cached(spark, sf_dir, _prediction_messages, "prediction")
    return _refused(spark.read.parquet(f"{root}/rejects"))
