"""Queries on alerts, predictions and latest values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import SENSOR_COORDINATES
from ..operators import cache_rules, gold, latest, reports
from ..schemas import ALERT_TYPES, LATEST, SEVERITIES, STATUSES
from ..sources import fixtures, readers, sinks
from .layers import GOLD_CTE, SENSOR_CTE, WEATHER_CTE, rounded, silver_sensor_rows, silver_weather_rows
from .registry import AS_OF, MINUTES, query
from .tables import ALERTS_CTE, PREDICTIONS_CTE, alert_table, prediction_table

_ALERT = "id, zone_id, alert_timestamp, alert_type, severity, message, status, created_at"
_END = f"TIMESTAMP '{AS_OF}'"


def _in(time: str, span: str) -> str:
    return f"{time} >= {_END} - INTERVAL {span} AND {time} <= {_END}"


def _alerts(rest: str) -> str:
    return f"WITH {ALERTS_CTE} {rest}"


def _predictions(rest: str) -> str:
    return f"WITH {PREDICTIONS_CTE} {rest}"


_ACTIVE = f"SELECT {_ALERT} FROM alerts WHERE status = 'ACTIVE' AND {_in('alert_timestamp', '24 HOUR')} ORDER BY alert_timestamp DESC, id DESC LIMIT 100"

# ---- alerts ---------------------------------------------------------------------------


ACTIVE_SQL = _alerts(_ACTIVE)


@query(ACTIVE_SQL)
def alerts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.active(alert_table(spark, sf_dir), AS_OF)


@query(_alerts(f"SELECT * FROM ({_ACTIVE}) WHERE alert_type = 'WEATHER_ALERT'"))
def alerts_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.active_of_type(alert_table(spark, sf_dir), "WEATHER_ALERT", AS_OF)


@query(_alerts(f"SELECT * FROM ({_ACTIVE}) WHERE alert_type = 'SENSOR_ANOMALY'"))
def alerts_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.active_of_type(alert_table(spark, sf_dir), "SENSOR_ANOMALY", AS_OF)


@query(_alerts(f"SELECT {_ALERT} FROM alerts WHERE {_in('alert_timestamp', '7 DAY')}"))
def alerts_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.history(alert_table(spark, sf_dir), "alert_timestamp", AS_OF, 7)


@query(_alerts(f"SELECT {_ALERT} FROM alerts WHERE {_in('alert_timestamp', '7 DAY')} AND zone_id = 'field_03'"))
def alerts_historical_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.history(alert_table(spark, sf_dir), "alert_timestamp", AS_OF, 7, "zone_id", "field_03")


@query(_alerts(f"SELECT {_ALERT} FROM alerts WHERE zone_id IN ('field_01', 'field_02', 'loc_1') AND alert_type IN ('SENSOR_ANOMALY', 'WEATHER_ALERT') AND severity IN ('HIGH')"))
def alerts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.selected(alert_table(spark, sf_dir), zone_id=("field_01", "field_02", "loc_1"), alert_type=("SENSOR_ANOMALY", "WEATHER_ALERT"), severity=("HIGH",))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"


@query(_alerts(f"SELECT {_ALERT} FROM alerts ORDER BY {_RANK} DESC, alert_timestamp DESC, id DESC LIMIT 10"))
def alerts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked(alert_table(spark, sf_dir))


@query(_alerts(f"SELECT {_ALERT} FROM alerts WHERE status = 'ACTIVE'"))
def view_active_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert_table(spark, sf_dir).where("status = 'ACTIVE'").createOrReplaceTempView("active_alerts")
    return spark.table("active_alerts")


@query(_alerts(f"SELECT alert_type, severity, status, count(*) AS n_alerts FROM alerts WHERE {_in('alert_timestamp', '24 HOUR')} GROUP BY ALL"))
def alert_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_statistics(alert_table(spark, sf_dir), AS_OF)


@query(_alerts(f"SELECT date_trunc('hour', alert_timestamp) AS hour, count(*) AS n_alerts FROM alerts WHERE {_in('alert_timestamp', '24 HOUR')} GROUP BY ALL"))
def alert_stats_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alerts_by_hour(alert_table(spark, sf_dir), AS_OF)


@query(_alerts("SELECT zone_id, severity, count(*) AS n FROM alerts GROUP BY ALL"))
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(alert_table(spark, sf_dir), "zone_id", "severity")


_INDICATORS = "SELECT count(*) AS n_alerts, count(*) FILTER (severity = 'HIGH') AS n_high, count(DISTINCT zone_id) AS n_zones, count(*) FILTER (alert_type = 'SENSOR_ANOMALY') AS n_sensor, count(*) FILTER (alert_type = 'WEATHER_ALERT') AS n_weather FROM alerts"


@query(_alerts(_INDICATORS))
def alert_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_indicators(alert_table(spark, sf_dir))


@query(_alerts(f"{_INDICATORS} WHERE severity IN ('HIGH') AND zone_id IN ('field_01', 'field_02', 'loc_1')"))
def alert_filtered_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_indicators(reports.selected(alert_table(spark, sf_dir), severity=("HIGH",), zone_id=("field_01", "field_02", "loc_1")))


@query(_alerts("SELECT id, zone_id, alert_timestamp, 1 AS alert FROM alerts"))
def alert_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_timeline(alert_table(spark, sf_dir))


@query(_alerts("SELECT id, strftime((alert_timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome', '%d/%m/%Y %H:%M:%S') AS shown_time, regexp_replace(message, '^(Weather )?Alert: ', '') AS shown_message FROM alerts"))
def alert_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_display(alert_table(spark, sf_dir)).select("id", "shown_time", "shown_message")


@query(_alerts("""SELECT '{"zone_id":"' || zone_id || '","alert_type":"' || alert_type || '","severity":"' || severity || '","message":"' || message || '","status":"' || status || '"}' AS value, id FROM alerts"""))
def alert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(spark, sf_dir).select(F.to_json(F.struct("zone_id", "alert_type", "severity", "message", "status")).alias("value"), "id")


@query(
    f"""WITH {ALERTS_CTE}, {PREDICTIONS_CTE}, a AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE zone_id END AS zone_id, message, alert_type, CASE WHEN id % 70 = 0 THEN 'SEVERE' ELSE severity END AS severity, CASE WHEN id % 90 = 0 THEN 'OPEN' ELSE status END AS status FROM alerts)
    SELECT 'alerts' AS table_name, id, 'zone_id' AS constraint_name FROM a WHERE zone_id IS NULL UNION ALL SELECT 'alerts', id, 'severity' FROM a WHERE severity = 'SEVERE' UNION ALL SELECT 'alerts', id, 'status' FROM a WHERE status = 'OPEN'
    UNION ALL SELECT 'ml_predictions', id, 'severity' FROM predictions WHERE id % 60 = 0"""
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of tables into which some broken rows are put."""
    broken = lambda every, value, name: F.when(F.col("id") % every == 0, F.lit(value)).otherwise(F.col(name))
    rows = alert_table(spark, sf_dir).withColumns({"zone_id": broken(50, None, "zone_id"), "severity": broken(70, "SEVERE", "severity"), "status": broken(90, "OPEN", "status")})
    predictions = prediction_table(spark, sf_dir).withColumn("severity", broken(60, "SEVERE", "severity"))
    return reports.violations(rows, predictions, {"alert_type": ALERT_TYPES, "severity": SEVERITIES, "status": STATUSES})


STATUS_SQL = _alerts("SELECT id, CASE WHEN id % 10 = 0 THEN 'RESOLVED' WHEN id % 15 = 0 THEN 'ACKNOWLEDGED' ELSE status END AS status FROM alerts")


@query(STATUS_SQL)
def alert_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alert_table(spark, sf_dir)
    changes = rows.select("id", F.when(F.col("id") % 10 == 0, "RESOLVED").when(F.col("id") % 15 == 0, "ACKNOWLEDGED").alias("new_status")).where("new_status IS NOT NULL")
    return reports.with_status(rows, changes).select("id", "status")


_CLOSED = f"alert_timestamp < {_END} - INTERVAL 14 DAY AND status IN ('RESOLVED', 'IGNORED')"


RETAINED_SQL = _alerts(f"SELECT {_ALERT} FROM alerts WHERE NOT ({_CLOSED})")


@query(RETAINED_SQL)
def alert_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retained(alert_table(spark, sf_dir), AS_OF, 14)


@query(_alerts(f"SELECT count(*) AS n_removed FROM alerts WHERE {_CLOSED}"))
def alert_retention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retained(alert_table(spark, sf_dir), AS_OF, 14, gone=True).agg(F.count("*").alias("n_removed"))


# ---- predictions --------------------------------------------------------------------------

_PREDICTION = "id, field_id, location, prediction_timestamp, round(anomaly_score, 4) AS anomaly_score, is_anomaly, severity, model_version"
_PREDICTION_COLUMNS = ("id", "field_id", "location", "prediction_timestamp", "anomaly_score", "is_anomaly", "severity", "model_version")


def _shown(rows: DataFrame) -> DataFrame:
    return rounded(rows.select(*_PREDICTION_COLUMNS))


@query(_predictions(f"SELECT {_PREDICTION} FROM predictions WHERE {_in('prediction_timestamp', '7 DAY')} AND field_id = 'field_05'"))
def predictions_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reports.history(prediction_table(spark, sf_dir), "prediction_timestamp", AS_OF, 7, "field_id", "field_05"))


@query(_predictions(f"SELECT {_PREDICTION} FROM predictions ORDER BY prediction_timestamp DESC, id DESC LIMIT 50"))
def predictions_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reports.recent(prediction_table(spark, sf_dir), "prediction_timestamp", 50))


@query(_predictions(f"SELECT {_PREDICTION} FROM predictions WHERE {_in('prediction_timestamp', '24 HOUR')}"))
def view_recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports.history(prediction_table(spark, sf_dir), "prediction_timestamp", AS_OF, 1).createOrReplaceTempView("recent_predictions")
    return _shown(spark.table("recent_predictions"))


@query(_predictions(f"SELECT {_PREDICTION} FROM predictions WHERE is_anomaly"))
def anomalies_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(prediction_table(spark, sf_dir).where("is_anomaly"))


@query(_predictions(f"SELECT field_id, severity, is_anomaly, count(*) AS n_predictions, round(avg(anomaly_score), 4) AS avg_score FROM predictions WHERE {_in('prediction_timestamp', '7 DAY')} GROUP BY ALL"))
def prediction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.prediction_statistics(prediction_table(spark, sf_dir), AS_OF))


@query(_predictions(f"SELECT field_id, round(avg(anomaly_score), 4) AS avg_score, count(*) AS n_predictions, count(*) FILTER (is_anomaly) AS n_anomalies FROM predictions WHERE {_in('prediction_timestamp', '7 DAY')} GROUP BY ALL"))
def prediction_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.field_summary(prediction_table(spark, sf_dir), AS_OF))


@query(_predictions("SELECT field_id, severity, count(*) AS n FROM predictions WHERE is_anomaly GROUP BY ALL"))
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(prediction_table(spark, sf_dir).where("is_anomaly"), "field_id", "severity")


@query(_predictions("SELECT field_id, round(avg(anomaly_score), 4) AS avg_score FROM predictions GROUP BY ALL"))
def avg_score_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prediction_table(spark, sf_dir).groupBy("field_id").agg(F.avg("anomaly_score").alias("avg_score")))


@query(_predictions("SELECT field_id, count(*) AS n_predictions, count(*) FILTER (is_anomaly) AS n_anomalies, round(1e2 * count(*) FILTER (is_anomaly) / count(*), 2) AS anomaly_rate, round(avg(anomaly_score), 3) AS avg_score, round(max(anomaly_score), 3) AS max_score, round(min(anomaly_score), 3) AS min_score FROM predictions GROUP BY ALL"))
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.field_statistics(prediction_table(spark, sf_dir))


@query(_predictions("SELECT id, format('{:.2f}', anomaly_score) AS shown_score FROM predictions"))
def score_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_display(prediction_table(spark, sf_dir)).select("id", "shown_score")


@query(_predictions("SELECT id, field_id, prediction_timestamp, CAST(is_anomaly AS INTEGER) AS anomaly FROM predictions"))
def anomaly_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.anomaly_timeline(prediction_table(spark, sf_dir))


# ---- latest values ---------------------------------------------------------------------------


def _latest_sql(kind: str, rows: str, time: str, columns: str, order: str) -> str:
    """As of the newest time of the rows."""
    key, ttl = LATEST[kind]
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {time} DESC, {order} DESC) AS nth FROM {rows}) WHERE nth = 1 AND {time} >= (SELECT max({time}) FROM {rows}) - INTERVAL {ttl} SECOND"


def _latest(rows: DataFrame, kind: str, time: str, order: str) -> DataFrame:
    return latest.latest_as_of_newest(rows, kind, time, (order,))


def _newest_key(rows: DataFrame, key: str, time: str, order: str) -> str:
    """The key of the newest row, which a lookup asks for."""
    return rows.agg(F.max_by(key, F.struct(time, order))).first()[0]


def latest_sensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(silver_sensor_rows(spark, sf_dir), "sensor", "timestamp_parsed", "event_id")


def latest_weather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(silver_weather_rows(spark, sf_dir), "weather", "timestamp_parsed", "event_id")


def latest_alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(alert_table(spark, sf_dir), "alert", "alert_timestamp", "id")


def latest_prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(prediction_table(spark, sf_dir), "prediction", "prediction_timestamp", "id")


_SENSOR_LATEST = "field_id, location, temperature, humidity, soil_ph, timestamp_parsed, event_id"
_LATEST_SENSOR = _latest_sql("sensor", "s_ok", "timestamp_parsed", _SENSOR_LATEST, "event_id")
_LATEST_WEATHER = _latest_sql("weather", "w_ok", "timestamp_parsed", "location, temp_c, condition, timestamp_parsed, event_id", "event_id")
_LATEST_ALERT = _latest_sql("alert", "alerts", "alert_timestamp", "zone_id, severity, message, alert_timestamp, id", "id")
_LATEST_PREDICTION = _latest_sql("prediction", "predictions", "prediction_timestamp", "field_id, severity, is_anomaly, prediction_timestamp, id", "id")


@query(f"WITH {SENSOR_CTE} {_LATEST_SENSOR}")
def latest_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_sensor_rows(spark, sf_dir).select(*_SENSOR_LATEST.split(", "))


@query(f"WITH {WEATHER_CTE} {_LATEST_WEATHER}")
def latest_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_weather_rows(spark, sf_dir).select("location", "temp_c", "condition", "timestamp_parsed", "event_id")


@query(_alerts(_LATEST_ALERT))
def latest_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_alert_rows(spark, sf_dir).select("zone_id", "severity", "message", "alert_timestamp", "id")


@query(_predictions(_LATEST_PREDICTION))
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_prediction_rows(spark, sf_dir).select("field_id", "severity", "is_anomaly", "prediction_timestamp", "id")


@query(_predictions(f"SELECT * FROM ({_LATEST_PREDICTION}) WHERE field_id = (SELECT field_id FROM predictions ORDER BY prediction_timestamp DESC, id DESC LIMIT 1)"))
def latest_prediction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _newest_key(prediction_table(spark, sf_dir), "field_id", "prediction_timestamp", "id")
    return latest.lookup(latest_prediction(spark, sf_dir), "field_id", key)


@query(f"WITH {SENSOR_CTE} SELECT * FROM ({_LATEST_SENSOR}) WHERE field_id = (SELECT field_id FROM s_ok ORDER BY timestamp_parsed DESC, event_id DESC LIMIT 1)")
def latest_sensor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _newest_key(silver_sensor_rows(spark, sf_dir), "field_id", "timestamp_parsed", "event_id")
    return latest.lookup(latest_sensor(spark, sf_dir), "field_id", key)


_ALL_CTE = f"WITH {ALERTS_CTE}, {PREDICTIONS_CTE}"


@query(f"{_ALL_CTE} SELECT 'sensor' AS kind, count(*) AS n_keys FROM ({_LATEST_SENSOR}) UNION ALL SELECT 'weather', count(*) FROM ({_LATEST_WEATHER}) UNION ALL SELECT 'alert', count(*) FROM ({_LATEST_ALERT}) UNION ALL SELECT 'prediction', count(*) FROM ({_LATEST_PREDICTION})")
def latest_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers = {"sensor": latest_sensor_rows, "weather": latest_weather_rows, "alert": latest_alert_rows, "prediction": latest_prediction_rows}
    return latest.key_counts({kind: make(spark, sf_dir) for kind, make in makers.items()})


@query(_predictions(f"SELECT DISTINCT field_id AS id FROM ({_LATEST_PREDICTION})"))
def available_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.available_ids(latest_prediction_rows(spark, sf_dir), "field_id")


@query(f"{_ALL_CTE}, fields AS ({fixtures.FIELDS_SQL}), newest AS ({_LATEST_ALERT}) SELECT field_id, severity, message, CASE WHEN severity IS NULL THEN 'green' WHEN severity = 'HIGH' THEN 'red' WHEN severity = 'MEDIUM' THEN 'orange' ELSE 'yellow' END AS colour FROM fields LEFT JOIN newest ON zone_id = field_id")
def field_status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.field_status(fixtures.fields(spark, sf_dir), latest_alert_rows(spark, sf_dir))


@query(f"WITH {WEATHER_CTE} SELECT condition, string_agg(location, ', ' ORDER BY location) AS locations FROM (SELECT location, arg_max(condition, (timestamp_parsed, event_id)) AS condition FROM w_ok GROUP BY location) GROUP BY condition")
def conditions_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of the newest weather of each location."""
    return reports.conditions_by_location(latest.newest_of(silver_weather_rows(spark, sf_dir), "location", ("timestamp_parsed", "event_id")))


@query(f"WITH s AS ({fixtures.sql('sensor')}) SELECT round(avg(latitude), 4) AS latitude, round(avg(longitude), 4) AS longitude FROM s WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def map_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.map_center(fixtures.sensor(spark, sf_dir)))


def _messages(rows: DataFrame, *members: str) -> DataFrame:
    """Rows with an id as message envelopes."""
    return rows.select(F.to_json(F.struct(*members)).cast("binary").alias("value"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.current_timestamp().alias("timestamp"))


def _judged(messages: DataFrame, kind: str, place: str) -> DataFrame:
    return cache_rules.checked(messages, kind).select(F.col("kafka_offset").alias(place), (F.col("failed") == 0).alias("cache_valid"))


@query(
    f"""WITH s AS ({fixtures.sql("sensor")}) SELECT event_id, coalesce(temperature BETWEEN -20 AND 60 AND humidity BETWEEN 0 AND 100 AND soil_ph BETWEEN 3 AND 9 AND {SENSOR_COORDINATES[0]} BETWEEN -90 AND 90 AND {SENSOR_COORDINATES[1]} BETWEEN -180 AND 180, false) AS cache_valid FROM s"""
)
def cache_valid_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(fixtures.sensor_messages(spark, sf_dir), "sensor", "event_id")


@query(f"WITH w AS ({fixtures.sql('weather')}) SELECT event_id, coalesce(condition IS NOT NULL AND temp_c BETWEEN -50 AND 60 AND humidity BETWEEN 0 AND 100 AND wind_kph BETWEEN 0 AND 500 AND uv BETWEEN 0 AND 20 AND precip_mm BETWEEN 0 AND 1000, false) AS cache_valid FROM w")
def cache_valid_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(fixtures.weather_messages(spark, sf_dir), "weather", "event_id")


@query(_alerts("SELECT id, id % 20 <> 0 AND id % 33 <> 0 AS cache_valid FROM alerts"))
def cache_valid_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth alert gets an empty zone, every 33rd no message."""
    rows = alert_table(spark, sf_dir).withColumns({"zone_id": F.when(F.col("id") % 20 == 0, "").otherwise(F.col("zone_id")), "message": F.when(F.col("id") % 33 != 0, F.col("message"))})
    return _judged(_messages(rows, "zone_id", "alert_timestamp", "alert_type", "severity", "message", "status"), "alert", "id")


@query(_predictions("SELECT id, id % 25 <> 0 AS cache_valid FROM predictions"))
def cache_valid_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 25th prediction has no location, and every 30th an empty one, which is allowed."""
    rows = prediction_table(spark, sf_dir).withColumns({"location": F.when(F.col("id") % 25 == 0, None).when(F.col("id") % 30 == 0, "").otherwise(F.col("location")), "features": F.struct("sensor_avg_temperature")})
    return _judged(_messages(rows, "field_id", "location", "anomaly_score", "is_anomaly", "severity", "recommendations", "model_version", "prediction_timestamp", "features"), "prediction", "id")


@query(f"WITH {GOLD_CTE} SELECT field_id, location, sensor_readings_count, weather_dominant_condition FROM fields LEFT JOIN both_sides USING (field_id)")
def gold_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows published as messages, read back from their topic."""
    rows = gold.features(silver_sensor_rows(spark, sf_dir), silver_weather_rows(spark, sf_dir), fixtures.fields(spark, sf_dir), AS_OF, MINUTES)
    path = sinks.work_dir(spark, "gold-topic")
    envelope = {"partition": F.lit(0), "offset": F.monotonically_increasing_id(), "timestamp": F.current_timestamp()}
    sinks.publish(sinks.as_messages(rows, "gold_features", "field_id").withColumns(envelope), "parquet", path)
    schema = "field_id string, location string, sensor_readings_count bigint, weather_dominant_condition string"
    return readers.decoded(readers.messages(spark, "gold_features", "parquet", path), schema).drop("kafka_partition", "kafka_offset")
