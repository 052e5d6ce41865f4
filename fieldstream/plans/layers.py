"""Queries of the raw, validated and feature layers and of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_timestamp, utc
from ..operators import alerts, bronze, gold, panes, silver
from ..sources import fixtures
from .registry import AS_OF, MINUTES, query

# ---- SQL fragments -------------------------------------------------------------

_PARTS = "CAST(loc AS DATE) AS date, CAST(hour(loc) AS INTEGER) AS hour, CAST(dayofweek(loc) + 1 AS INTEGER) AS day_of_week, CAST(month(loc) AS INTEGER) AS month, CAST(year(loc) AS INTEGER) AS year"
_ROME = "(event_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome' AS loc"
_SENSOR_FLAGS = (
    "coalesce(temperature BETWEEN -20 AND 60, false) AS temperature_valid, coalesce(humidity BETWEEN 0 AND 100, false) AS humidity_valid, "
    "coalesce(soil_ph BETWEEN 3 AND 9, false) AS ph_valid, coalesce(latitude BETWEEN -90 AND 90, false) AND coalesce(longitude BETWEEN -180 AND 180, false) AS coordinates_valid"
)
_WEATHER_FLAGS = (
    "coalesce(temp_c BETWEEN -50 AND 60, false) AS temp_valid, coalesce(humidity BETWEEN 0 AND 100, false) AS humidity_valid, coalesce(wind_kph BETWEEN 0 AND 500, false) AS wind_valid, "
    "coalesce(uv BETWEEN 0 AND 20, false) AS uv_valid, coalesce(precip_mm BETWEEN 0 AND 1000, false) AS precip_valid, coalesce(lat BETWEEN -90 AND 90, false) AND coalesce(lon BETWEEN -180 AND 180, false) AS coordinates_valid"
)
_SENSOR_COMPLETE = "temperature IS NOT NULL AND humidity IS NOT NULL AND soil_ph IS NOT NULL AND field_id IS NOT NULL AND location IS NOT NULL"
_WEATHER_COMPLETE = "temp_c IS NOT NULL AND humidity IS NOT NULL AND wind_kph IS NOT NULL AND uv IS NOT NULL AND precip_mm IS NOT NULL AND condition IS NOT NULL AND location IS NOT NULL"

SENSOR_CTE = f"""s_raw AS ({fixtures.sql("sensor")}),
 s_time AS (SELECT * REPLACE ({fixtures.PARSED_TIME} AS event_ts) FROM s_raw WHERE {_SENSOR_COMPLETE}),
 s_loc AS (SELECT *, {_ROME} FROM s_time WHERE event_ts IS NOT NULL),
 s_flag AS (SELECT * EXCLUDE (loc), event_ts AS timestamp_parsed, {_PARTS}, {_SENSOR_FLAGS} FROM s_loc),
 s_ok AS (SELECT * FROM s_flag WHERE temperature_valid AND humidity_valid AND ph_valid AND coordinates_valid)"""
WEATHER_CTE = f"""w_raw AS ({fixtures.sql("weather")}),
 w_time AS (SELECT * REPLACE ({fixtures.PARSED_TIME} AS event_ts) FROM w_raw WHERE {_WEATHER_COMPLETE}),
 w_loc AS (SELECT *, {_ROME} FROM w_time WHERE event_ts IS NOT NULL),
 w_flag AS (SELECT * EXCLUDE (loc), event_ts AS timestamp_parsed, {_PARTS}, {_WEATHER_FLAGS} FROM w_loc),
 w_ok AS (SELECT * FROM w_flag WHERE temp_valid AND humidity_valid AND wind_valid AND uv_valid AND precip_valid AND coordinates_valid)"""
SATELLITE_CTE = f"""i_raw AS (SELECT p.*, CAST(strlen(d.text) AS INTEGER) AS image_size_bytes, TIMESTAMP '2024-01-15 10:00:00' + to_minutes(doc_id % 60) AS event_ts FROM ({fixtures.sql("satellite")}) p JOIN documents d USING (doc_id) WHERE doc_id % 10 <> 4),
 i_loc AS (SELECT *, {_ROME} FROM i_raw),
 i_flag AS (SELECT * EXCLUDE (loc), event_ts AS timestamp_parsed, {_PARTS}, bbox_min_lon BETWEEN -180 AND 180 AND bbox_max_lon BETWEEN -180 AND 180 AND bbox_min_lat BETWEEN -90 AND 90 AND bbox_max_lat BETWEEN -90 AND 90 AND bbox_min_lon < bbox_max_lon AND bbox_min_lat < bbox_max_lat AS bbox_valid,
  image_size_bytes > 1000 AND image_size_bytes < 50000000 AS image_size_valid FROM i_loc WHERE image_size_bytes IS NOT NULL)"""

_SENSOR_COLUMNS = "event_id, field_id, location, latitude, longitude, temperature, humidity, soil_ph, timestamp_parsed, date, hour, day_of_week, month, year, temperature_valid, humidity_valid, ph_valid, coordinates_valid"
_WEATHER_COLUMNS = "event_id, location, lat, lon, temp_c, humidity, wind_kph, uv, precip_mm, condition, timestamp_parsed, date, hour, day_of_week, month, year, temp_valid, humidity_valid, wind_valid, uv_valid, precip_valid, coordinates_valid"


def _columns(text: str) -> list[str]:
    return text.split(", ")


def _utc(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp_parsed", utc("timestamp_parsed"))


def silver_sensor_rows(spark: SparkSession, sf_dir: str, keep_invalid: bool = False) -> DataFrame:
    """Validated readings with a zoneless UTC timestamp_parsed."""
    raw = fixtures.sensor(spark, sf_dir)
    return _utc(silver.sensor_flagged(raw) if keep_invalid else silver.sensor(raw))


def silver_weather_rows(spark: SparkSession, sf_dir: str, keep_invalid: bool = False) -> DataFrame:
    raw = fixtures.weather(spark, sf_dir)
    return _utc(silver.weather_flagged(raw) if keep_invalid else silver.weather(raw))


# ---- sources and raw layer -----------------------------------------------------------

_ENVELOPE_COUNT = "SELECT '{topic}' AS topic, CAST(event_id % 3 AS INTEGER) AS partition, count(*) AS n_messages, min(event_id) AS first_offset, max(event_id) AS last_offset FROM events {where} GROUP BY event_id % 3"


def _envelope_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic", "partition").agg(F.count("*").alias("n_messages"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query(_ENVELOPE_COUNT.format(topic="sensor_data", where=""))
def src_sensor_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelope_summary(fixtures.sensor_messages(spark, sf_dir))


@query(_ENVELOPE_COUNT.format(topic="weather_data", where=""))
def src_weather_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelope_summary(fixtures.weather_messages(spark, sf_dir))


@query("SELECT 'satellite_data' AS topic, 0 AS partition, count(*) AS n_messages, min(doc_id) AS first_offset, max(doc_id) AS last_offset FROM documents")
def src_satellite_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelope_summary(fixtures.satellite_messages(spark, sf_dir))


_BRONZE_TIME = "CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST({part}(CASE WHEN event_id % 3 = 0 THEN event_ts ELSE date_trunc('second', event_ts) END) AS INTEGER) END AS {name}"
_BRONZE_PARTS = ", ".join(_BRONZE_TIME.format(part=p, name=n) for p, n in (("year", "year"), ("month", "month"), ("day", "day"), ("hour", "hour")))


@query(f"WITH s AS ({fixtures.sql('sensor')}) SELECT event_id AS kafka_offset, CAST(event_id % 3 AS INTEGER) AS kafka_partition, field_id, location, latitude, longitude, temperature, humidity, soil_ph, {_BRONZE_PARTS}, true AS parse_ok FROM s")
def bronze_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.sensor(fixtures.sensor_messages(spark, sf_dir)).select("kafka_offset", "kafka_partition", "field_id", "location", "latitude", "longitude", "temperature", "humidity", "soil_ph", "year", "month", "day", "hour", "parse_ok")


@query(f"WITH w AS ({fixtures.sql('weather')}) SELECT event_id AS kafka_offset, location, lat, lon, temp_c, CAST(humidity AS INTEGER) AS humidity, wind_kph, uv, precip_mm, condition, {_BRONZE_PARTS}, true AS parse_ok FROM w")
def bronze_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.weather(fixtures.weather_messages(spark, sf_dir)).select("kafka_offset", "location", "lat", "lon", "temp_c", "humidity", "wind_kph", "uv", "precip_mm", "condition", "year", "month", "day", "hour", "parse_ok")


IMAGE_SQL = (
    f"""WITH i AS ({fixtures.sql("satellite")}), t AS (
    SELECT d.doc_id, strlen(d.text) AS n, TIMESTAMP '2024-01-15 10:00:00' + to_minutes(d.doc_id % 60) + CASE d.doc_id % 3 WHEN 0 THEN INTERVAL 1 HOUR WHEN 1 THEN INTERVAL (-1) HOUR ELSE INTERVAL 0 HOUR END AS local FROM documents d WHERE strlen(d.text) > 0)
    SELECT i.doc_id AS kafka_offset, CAST(n AS INTEGER) AS image_size_bytes, local AS local_timestamp,
     'satellite-images/' || strftime(local, '%Y-%m-%d_%H-%M-%S') || '_0_' || CAST(i.doc_id AS VARCHAR) || '.png' AS image_path,
     CASE WHEN i.doc_id % 10 = 0 THEN 0e0 ELSE bbox_min_lon END AS bbox_min_lon, CASE WHEN i.doc_id % 10 = 0 THEN 0e0 ELSE bbox_min_lat END AS bbox_min_lat,
     CASE WHEN i.doc_id % 10 = 0 THEN 0e0 ELSE bbox_max_lon END AS bbox_max_lon, CASE WHEN i.doc_id % 10 = 0 THEN 0e0 ELSE bbox_max_lat END AS bbox_max_lat
    FROM i JOIN t ON i.doc_id = t.doc_id"""
)


@query(IMAGE_SQL)
def bronze_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.satellite(fixtures.satellite_messages(spark, sf_dir)).select("kafka_offset", "image_size_bytes", "local_timestamp", "image_path", "bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat")


@query("SELECT count(*) > 0 AS has_rows FROM events")
def bronze_has_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze.sensor(fixtures.sensor_messages(spark, sf_dir))
    return spark.range(1).select(F.lit(bronze.has_rows(rows)).alias("has_rows"))


@query("SELECT event_id AS kafka_offset, event_id % 7 = 0 AS rejected FROM events WHERE event_id % 7 = 0")
def bronze_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh message is cut short, so that it is no JSON."""
    messages = fixtures.sensor_messages(spark, sf_dir).withColumn("value", F.when(F.col("offset") % 7 == 0, F.expr("substring(value, 1, 20)")).otherwise(F.col("value")))
    return bronze.rejects(bronze.sensor(messages)).select("kafka_offset", F.lit(True).alias("rejected"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 3 = 1 THEN date_trunc('second', ts) END AS parsed FROM events")
def parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze.sensor(fixtures.sensor_messages(spark, sf_dir))
    return rows.select(F.col("kafka_offset").alias("event_id"), utc(parse_timestamp(F.col("timestamp"))).alias("parsed"))


# ---- validated layer --------------------------------------------------------------------


@query(f"WITH s_raw AS ({fixtures.sql('sensor')}) SELECT event_id, field_id, location, temperature, humidity, soil_ph FROM s_raw WHERE {_SENSOR_COMPLETE}")
def sensor_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.complete(fixtures.sensor(spark, sf_dir), silver.SENSOR_REQUIRED).select("event_id", "field_id", "location", "temperature", "humidity", "soil_ph")


@query(f"WITH w_raw AS ({fixtures.sql('weather')}) SELECT event_id, location, condition FROM w_raw WHERE {_WEATHER_COMPLETE}")
def weather_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.complete(fixtures.weather(spark, sf_dir), silver.WEATHER_REQUIRED).select("event_id", "location", "condition")


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS image_size_bytes FROM documents WHERE text IS NOT NULL")
def satellite_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.complete(fixtures.satellite(spark, sf_dir), silver.SATELLITE_REQUIRED).select("doc_id", "image_size_bytes")


@query(f"WITH {SENSOR_CTE} SELECT event_id, date, hour, day_of_week, month, year FROM s_flag")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_sensor_rows(spark, sf_dir, keep_invalid=True).select("event_id", "date", "hour", "day_of_week", "month", "year")


@query(f"WITH {SENSOR_CTE} SELECT {_SENSOR_COLUMNS} FROM s_flag")
def sensor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_sensor_rows(spark, sf_dir, keep_invalid=True).select(*_columns(_SENSOR_COLUMNS))


@query(f"WITH {WEATHER_CTE} SELECT {_WEATHER_COLUMNS} FROM w_flag")
def weather_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_weather_rows(spark, sf_dir, keep_invalid=True).select(*_columns(_WEATHER_COLUMNS))


_IMAGE_COLUMNS = "doc_id, image_size_bytes, timestamp_parsed, date, hour, month, year, bbox_valid, image_size_valid"


@query(f"WITH {SATELLITE_CTE} SELECT {_IMAGE_COLUMNS} FROM i_flag")
def satellite_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc(silver.satellite_flagged(fixtures.satellite(spark, sf_dir))).select(*_columns(_IMAGE_COLUMNS))


@query(f"WITH {SENSOR_CTE} SELECT {_SENSOR_COLUMNS} FROM s_ok")
def silver_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_sensor_rows(spark, sf_dir).select(*_columns(_SENSOR_COLUMNS))


@query(f"WITH {WEATHER_CTE} SELECT {_WEATHER_COLUMNS} FROM w_ok")
def silver_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_weather_rows(spark, sf_dir).select(*_columns(_WEATHER_COLUMNS))


@query(f"WITH {SATELLITE_CTE} SELECT doc_id, image_size_bytes, timestamp_parsed, date, bbox_min_lon, bbox_min_lat, bbox_max_lon, bbox_max_lat FROM i_flag WHERE bbox_valid AND image_size_valid")
def silver_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc(silver.satellite(fixtures.satellite(spark, sf_dir))).select("doc_id", "image_size_bytes", "timestamp_parsed", "date", "bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat")


def _members_sql(members: tuple[str, ...], rows: str) -> str:
    """JSON objects of the members and the time, texts in quotes."""
    parts = []
    for m in members:
        value = f"""'"' || {m} || '"'""" if m in ("field_id", "location", "condition") else f"CAST({m} AS VARCHAR)"
        parts.append(f"""'"{m}":' || {value}""")
    parts.append("""'"timestamp":"' || strftime(timestamp_parsed, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"'""")
    return f"SELECT event_id, '{{' || concat_ws(',', {', '.join(parts)}) || '}}' AS value FROM {rows}"


@query(f"WITH {SENSOR_CTE} " + _members_sql(silver.SENSOR_MESSAGE, "s_ok"))
def sensor_valid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.sensor(fixtures.sensor(spark, sf_dir)).select("event_id", silver.message(silver.SENSOR_MESSAGE))


@query(f"WITH {WEATHER_CTE} " + _members_sql(silver.WEATHER_MESSAGE, "w_ok"))
def weather_valid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.weather(fixtures.weather(spark, sf_dir)).select("event_id", silver.message(silver.WEATHER_MESSAGE))


# ---- alerts -------------------------------------------------------------------------------

SENSOR_ALERT_SQL = """SELECT event_id, field_id AS zone_id, timestamp_parsed AS alert_timestamp, 'SENSOR_ANOMALY' AS alert_type,
  CASE WHEN temperature < 0 OR temperature > 45 OR humidity < 20 OR humidity > 95 OR soil_ph < 4.5 OR soil_ph > 9.0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'Alert: ' || CASE WHEN temperature < 5 THEN 'Low temperature ' || CAST(temperature AS VARCHAR) || '°C' WHEN temperature > 40 THEN 'High temperature ' || CAST(temperature AS VARCHAR) || '°C'
   WHEN humidity < 30 THEN 'Low humidity ' || CAST(humidity AS VARCHAR) || '%' WHEN humidity > 90 THEN 'High humidity ' || CAST(humidity AS VARCHAR) || '%'
   WHEN soil_ph < 5.5 THEN 'Low pH ' || CAST(soil_ph AS VARCHAR) WHEN soil_ph > 8.0 THEN 'High pH ' || CAST(soil_ph AS VARCHAR) ELSE 'Threshold exceeded' END AS message, 'ACTIVE' AS status
 FROM s_ok WHERE temperature < 5 OR temperature > 40 OR humidity < 30 OR humidity > 90 OR soil_ph < 5.5 OR soil_ph > 8.0"""
WEATHER_ALERT_SQL = """SELECT event_id, location AS zone_id, timestamp_parsed AS alert_timestamp, 'WEATHER_ALERT' AS alert_type,
  CASE WHEN temp_c < -10 OR temp_c > 50 OR wind_kph > 100 OR uv >= 11 OR precip_mm >= 100 OR humidity < 20 OR humidity > 95 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'Weather Alert: ' || CASE WHEN temp_c < 0 THEN 'Low temperature ' || CAST(temp_c AS VARCHAR) || '°C' WHEN temp_c > 45 THEN 'High temperature ' || CAST(temp_c AS VARCHAR) || '°C'
   WHEN humidity < 30 THEN 'Low humidity ' || CAST(CAST(humidity AS DOUBLE) AS VARCHAR) || '%' WHEN humidity > 85 THEN 'High humidity ' || CAST(CAST(humidity AS DOUBLE) AS VARCHAR) || '%'
   WHEN wind_kph > 80 THEN 'High wind speed ' || CAST(wind_kph AS VARCHAR) || ' km/h' WHEN uv >= 8 THEN 'High UV index ' || CAST(uv AS VARCHAR)
   WHEN precip_mm >= 50 THEN 'Heavy rainfall ' || CAST(precip_mm AS VARCHAR) || ' mm' ELSE 'Weather threshold exceeded' END AS message, 'ACTIVE' AS status
 FROM w_ok WHERE temp_c < 0 OR temp_c > 45 OR humidity < 30 OR humidity > 85 OR wind_kph > 80 OR uv >= 8 OR precip_mm >= 50"""


@query(f"WITH {SENSOR_CTE} {SENSOR_ALERT_SQL}")
def alerts_sensor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.sensor(silver_sensor_rows(spark, sf_dir), "event_id")


@query(f"WITH {WEATHER_CTE} {WEATHER_ALERT_SQL}")
def alerts_weather_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.weather(silver_weather_rows(spark, sf_dir), "event_id")


# ---- feature layer -------------------------------------------------------------------------

_IN_WINDOW = f"timestamp_parsed >= TIMESTAMP '{AS_OF}' - INTERVAL {MINUTES} MINUTE AND timestamp_parsed <= TIMESTAMP '{AS_OF}'"


def _stats_sql(prefix: str, metrics: tuple[tuple[str, str, str], ...]) -> str:
    parts = [f"round({f}({c}), 4) AS {prefix}_{n}_{long}" for c, long, _ in metrics for n, f in (("avg", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
    return ", ".join(parts + [f"round(max({c}) - min({c}), 4) AS {prefix}_{short}_range" for c, _, short in metrics])


def _mode_sql(column: str, keys: str, rows: str) -> str:
    return f"SELECT {keys}, {column} AS top FROM (SELECT {keys}, {column}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {column}) AS nth FROM {rows} WHERE {column} IS NOT NULL GROUP BY {keys}, {column}) WHERE nth = 1"


def _gold_ctes(sensor: str, weather: str) -> str:
    return f"""s_in AS (SELECT * FROM {sensor} WHERE {_IN_WINDOW}), w_in AS (SELECT * FROM {weather} WHERE {_IN_WINDOW}),
 s_mode AS ({_mode_sql("month", "field_id, location", "s_in")}), w_mode AS ({_mode_sql("condition", "location", "w_in")}),
 s_agg AS (SELECT field_id, location, {_stats_sql("sensor", gold.SENSOR_METRICS)},
  round(avg(CAST(temperature_valid AS INTEGER)), 4) AS sensor_temp_valid_rate, round(avg(CAST(humidity_valid AS INTEGER)), 4) AS sensor_humidity_valid_rate, round(avg(CAST(ph_valid AS INTEGER)), 4) AS sensor_ph_valid_rate,
  count(*) AS sensor_readings_count, count(*) FILTER (NOT temperature_valid) + count(*) FILTER (NOT humidity_valid) + count(*) FILTER (NOT ph_valid) AS sensor_anomaly_count,
  round((avg(CAST(temperature_valid AS INTEGER)) + avg(CAST(humidity_valid AS INTEGER)) + avg(CAST(ph_valid AS INTEGER))) / 3, 4) AS sensor_data_quality_score, max(timestamp_parsed) AS sensor_last_reading,
  avg(temperature) AS raw_t, avg(humidity) AS raw_h FROM s_in GROUP BY field_id, location),
 s_all AS (SELECT a.*, round(sensor_anomaly_count * 1e0 / sensor_readings_count, 4) AS sensor_anomaly_rate, m.top AS sensor_dominant_month FROM s_agg a JOIN s_mode m USING (field_id, location)),
 w_agg AS (SELECT location, {_stats_sql("weather", gold.WEATHER_METRICS)}, round(sum(precip_mm), 4) AS weather_total_precipitation, count(*) AS weather_readings_count, max(timestamp_parsed) AS weather_last_reading,
  avg(temp_c) AS raw_wt, avg(humidity) AS raw_wh FROM w_in GROUP BY location),
 w_all AS (SELECT a.*, m.top AS weather_dominant_condition FROM w_agg a JOIN w_mode m USING (location))"""


def sensor_features_sql(rows: str) -> str:
    """A few sensor features over the look-back, of the named validated rows."""
    return f"WITH {SENSOR_CTE}, {WEATHER_CTE}, {_gold_ctes(rows, 'w_ok')} SELECT field_id, location, sensor_avg_temperature, sensor_readings_count, sensor_last_reading FROM s_all"


_SENSOR_OUT = [c for c in gold.COLUMNS if c in ("field_id", "location") or (c.startswith("sensor_") and "freshness" not in c)]
_WEATHER_OUT = ["location", *(c for c in gold.COLUMNS if c.startswith("weather_") and "freshness" not in c)]


def rounded(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to that many digits: sums differ in the last bits between runs and engines."""
    return rows.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(f"WITH {SENSOR_CTE}, {WEATHER_CTE}, {_gold_ctes('s_flag', 'w_ok')} SELECT {', '.join(_SENSOR_OUT)} FROM s_all")
def gold_sensor_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor features over flagged but unfiltered rows, so that rates have meaning."""
    rows = silver_sensor_rows(spark, sf_dir, keep_invalid=True)
    return rounded(gold.sensor_features(rows, AS_OF, MINUTES).select(*_SENSOR_OUT))


@query(f"WITH {SENSOR_CTE}, {WEATHER_CTE}, {_gold_ctes('s_ok', 'w_ok')} SELECT {', '.join(_WEATHER_OUT)} FROM w_all")
def gold_weather_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gold.weather_features(silver_weather_rows(spark, sf_dir), AS_OF, MINUTES).select(*_WEATHER_OUT))


_JOINED_OUT = ["field_id", "location", "sensor_avg_temperature", "weather_avg_temperature", "sensor_readings_count", "weather_readings_count"]


@query(f"WITH {SENSOR_CTE}, {WEATHER_CTE}, {_gold_ctes('s_ok', 'w_ok')} SELECT {', '.join(_JOINED_OUT)} FROM s_all JOIN w_all USING (location)")
def gold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = gold.sensor_features(silver_sensor_rows(spark, sf_dir), AS_OF, MINUTES)
    return rounded(gold.joined(sensors, gold.weather_features(silver_weather_rows(spark, sf_dir), AS_OF, MINUTES)).select(*_JOINED_OUT))


_CROSS = {
    "temp_differential": "round(abs(raw_t - raw_wt), 4)",
    "humidity_differential": "round(abs(raw_h - raw_wh), 4)",
    "sensor_data_freshness_minutes": f"round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(sensor_last_reading))) / 60, 4)",
    "weather_data_freshness_minutes": f"round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(weather_last_reading))) / 60, 4)",
    "temporal_feature_ml_sin": "round(sin(2 * pi() * (sensor_dominant_month - 1) / 12), 4)",
    "temporal_feature_ml_cos": "round(cos(2 * pi() * (sensor_dominant_month - 1) / 12), 4)",
    "processing_timestamp": f"TIMESTAMP '{AS_OF}'",
    "window_start_time": f"TIMESTAMP '{AS_OF}' - INTERVAL {MINUTES} MINUTE",
    "window_end_time": f"TIMESTAMP '{AS_OF}'",
    "window_duration_minutes": f"{MINUTES}",
}
GOLD_CTE = f"{SENSOR_CTE}, {WEATHER_CTE}, {_gold_ctes('s_ok', 'w_ok')}, both_sides AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _CROSS.items()) + f" FROM s_all JOIN w_all USING (location)), fields AS ({fixtures.FIELDS_SQL})"
GOLD_SQL = f"WITH {GOLD_CTE} SELECT {', '.join(gold.COLUMNS)} FROM fields LEFT JOIN both_sides USING (field_id)"


@query(GOLD_SQL)
def gold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold.features(silver_sensor_rows(spark, sf_dir), silver_weather_rows(spark, sf_dir), fixtures.fields(spark, sf_dir), AS_OF, MINUTES)
    return rounded(rows)


@query(GOLD_SQL)
def gold_features_from_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table from aggregates by minute."""
    sensors, weather = silver_sensor_rows(spark, sf_dir), silver_weather_rows(spark, sf_dir)
    return rounded(panes.features(panes.panes(sensors, panes.SENSOR), sensors, panes.panes(weather, panes.WEATHER), weather, fixtures.fields(spark, sf_dir), AS_OF, MINUTES))


@query(f"WITH {SENSOR_CTE}, {WEATHER_CTE}, {_gold_ctes('s_flag', 'w_ok')} SELECT {', '.join(_SENSOR_OUT)} FROM s_all")
def gold_sensor_agg_from_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor features over flagged but unfiltered rows, from aggregates by minute."""
    rows = silver_sensor_rows(spark, sf_dir, keep_invalid=True)
    found = panes.aggregates(panes.look_back(panes.panes(rows, panes.SENSOR), rows, panes.SENSOR, AS_OF, MINUTES), panes.SENSOR)
    return rounded(gold.sensor_derived(found).select(*_SENSOR_OUT))


_JSON_OUT = ("field_id", "location", "sensor_readings_count", "weather_readings_count", "weather_dominant_condition")


@query(
    f"""WITH {GOLD_CTE} SELECT '{{' || concat_ws(',', '"field_id":"' || field_id || '"', '"location":"' || location || '"', '"sensor_readings_count":' || CAST(sensor_readings_count AS VARCHAR),
    '"weather_readings_count":' || CAST(weather_readings_count AS VARCHAR), '"weather_dominant_condition":"' || weather_dominant_condition || '"') || '}}' AS value FROM fields LEFT JOIN both_sides USING (field_id)"""
)
def gold_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold.features(silver_sensor_rows(spark, sf_dir), silver_weather_rows(spark, sf_dir), fixtures.fields(spark, sf_dir), AS_OF, MINUTES)
    return rows.select(F.to_json(F.struct(*_JSON_OUT)).alias("value"))


def _window_sql(rows: str, keys: str, metrics: tuple[tuple[str, str, str], ...], prefix: str) -> str:
    return f"SELECT time_bucket(INTERVAL 10 MINUTE, timestamp_parsed) AS window_start, {keys}, count(*) AS {prefix}_readings_count, " + ", ".join(f"round(avg({c}), 4) AS {prefix}_avg_{long}" for c, long, _ in metrics) + f" FROM {rows} GROUP BY ALL"


def _windowed(rows: DataFrame, keys: tuple[str, ...], aggregates: list, prefix: str, metrics: tuple) -> DataFrame:
    found = gold.windowed(rows, keys, aggregates)
    return rounded(found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), *keys, f"{prefix}_readings_count", *[f"{prefix}_avg_{long}" for _, long, _ in metrics]))


@query(f"WITH {SENSOR_CTE} " + _window_sql("s_ok", "field_id, location", gold.SENSOR_METRICS, "sensor"))
def gold_sensor_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(silver_sensor_rows(spark, sf_dir), ("field_id", "location"), gold.sensor_aggregates(), "sensor", gold.SENSOR_METRICS)


@query(f"WITH {WEATHER_CTE} " + _window_sql("w_ok", "location", gold.WEATHER_METRICS, "weather"))
def gold_weather_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(silver_weather_rows(spark, sf_dir), ("location",), gold.weather_aggregates(), "weather", gold.WEATHER_METRICS)
