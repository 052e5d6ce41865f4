"""Schemas of messages and tables, as Spark DDL."""

from __future__ import annotations

# Column names and types of the data model.
ENVELOPE = "value binary, topic string, partition int, offset bigint, timestamp timestamp"
SENSOR_RAW = "timestamp string, field_id string, location string, latitude double, longitude double, temperature double, humidity double, soil_ph double"
WEATHER_RAW = "message_id string, timestamp string, location string, region string, country string, lat double, lon double, temp_c double, humidity int, wind_kph double, condition string, uv double, precip_mm double"
SATELLITE_RAW = "timestamp string, image_base64 string, location struct<bbox: array<double>>"
SENSOR_VALID = "field_id string, location string, latitude double, longitude double, temperature double, humidity double, soil_ph double, temperature_valid boolean, humidity_valid boolean, ph_valid boolean, coordinates_valid boolean, timestamp timestamp"
WEATHER_VALID = "location string, temp_c double, humidity bigint, wind_kph double, uv double, condition string, precip_mm double, temp_valid boolean, humidity_valid boolean, wind_valid boolean, uv_valid boolean, precip_valid boolean, coordinates_valid boolean, timestamp timestamp"
IMAGE = "timestamp string, image_path string, image_size_bytes int, bbox_min_lon double, bbox_min_lat double, bbox_max_lon double, bbox_max_lat double, kafka_offset bigint"
ALERT = "zone_id string, alert_timestamp string, alert_type string, severity string, message string, status string"
ALERT_TABLE = "id bigint, zone_id string, alert_timestamp timestamp, alert_type string, severity string, message string, status string, created_at timestamp"
PREDICTION = (
    "field_id string, location string, anomaly_score double, is_anomaly boolean, severity string, recommendations string, "
    "model_version string, prediction_timestamp string, features struct<temperature: double, humidity: double, soil_ph: double, temp_differential: double, humidity_differential: double>"
)
FEATURE_INPUT = (
    "field_id string, location string, sensor_avg_temperature double, sensor_avg_humidity double, sensor_avg_soil_ph double, "
    "temp_differential double, humidity_differential double, sensor_anomaly_rate double, weather_avg_uv_index double, "
    "weather_avg_wind_speed double, temporal_feature_ml_sin double, temporal_feature_ml_cos double, processing_timestamp timestamp"
)

# Enumerations of the alert and prediction tables.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
STATUSES = ("ACTIVE", "ACKNOWLEDGED", "RESOLVED", "IGNORED")
ALERT_TYPES = ("DISEASE_DETECTED", "HIGH_RISK", "DATA_QUALITY", "SENSOR_ANOMALY", "WEATHER_ALERT")

# The ten core features of the anomaly model.
CORE_FEATURES = (
    "sensor_avg_temperature",
    "sensor_avg_humidity",
    "sensor_avg_soil_ph",
    "temp_differential",
    "humidity_differential",
    "sensor_anomaly_rate",
    "weather_avg_uv_index",
    "weather_avg_wind_speed",
    "temporal_feature_ml_sin",
    "temporal_feature_ml_cos",
)

#: Latest-value kinds: key column and seconds to live.
LATEST = {"sensor": ("field_id", 300), "weather": ("location", 600), "alert": ("zone_id", 1800), "prediction": ("field_id", 3600)}
LATEST_TIME = {"sensor": "timestamp", "weather": "timestamp", "alert": "alert_timestamp", "prediction": "prediction_timestamp"}
