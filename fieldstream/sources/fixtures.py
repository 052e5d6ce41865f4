"""Field-monitoring rows derived from the `events` and `documents` tables.

Each projection is arithmetic on integer keys in SQL that both Spark and other
engines run as is, so that queries can be checked against an oracle. With `parts`
the table's narrow rows are dealt to so many partitions before anything is made of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table

# Projections as (name, expression).
SENSOR = (
    ("event_id", "event_id"),
    ("event_ts", "ts"),
    ("field_id", "'field_' || lpad(CAST(user_id % 12 + 1 AS STRING), 2, '0')"),
    ("location", "'loc_' || CAST(user_id % 12 % 4 AS STRING)"),
    ("latitude", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE 45 + CAST(user_id % 12 AS DOUBLE)/100 END"),
    ("longitude", "10.9e0 + CAST(user_id % 12 AS DOUBLE)/100"),
    ("temperature", "CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(event_id * 7919 % 1000 AS DOUBLE)/10 - 30 END"),
    ("humidity", "CAST(event_id * 104729 % 1200 AS DOUBLE)/10 - 10"),
    ("soil_ph", "CAST(event_id * 15485863 % 75 AS DOUBLE)/10 + 2.5e0"),
)
WEATHER = (
    ("event_id", "event_id"),
    ("event_ts", "ts"),
    ("location", "'loc_' || CASE event_id % 5 WHEN 3 THEN '4' ELSE CAST(event_id % 5 AS STRING) END"),
    ("lat", "45.4e0"),
    ("lon", "10.9e0"),
    ("temp_c", "CAST(event_id * 6007 % 1300 AS DOUBLE)/10 - 60"),
    ("humidity", "CAST(event_id * 3571 % 110 - 5 AS BIGINT)"),
    ("wind_kph", "CAST(event_id * 4001 % 5500 AS DOUBLE)/10 - 10"),
    ("uv", "CAST(event_id * 2099 % 230 AS DOUBLE)/10 - 1"),
    ("precip_mm", "CAST(event_id * 1009 % 10500 AS DOUBLE)/10 - 10"),
    ("condition", "CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'Sunny' WHEN event_id % 4 = 1 THEN 'Cloudy' WHEN event_id % 4 = 2 THEN 'Rain' ELSE 'Fog' END"),
)
SATELLITE = (
    ("doc_id", "doc_id"),
    ("bbox_min_lon", "CAST(doc_id * 37 % 4000 AS DOUBLE)/10 - 200"),
    ("bbox_min_lat", "CAST(doc_id * 53 % 1900 AS DOUBLE)/10 - 95"),
    ("bbox_max_lon", "CAST(doc_id * 37 % 4000 AS DOUBLE)/10 - 199.5e0"),
    ("bbox_max_lat", "CAST(doc_id * 53 % 1900 AS DOUBLE)/10 - 94.5e0"),
)
#: Model input rows: the ten core features by event.
FEATURES = (
    ("id", "event_id"),
    ("prediction_ts", "ts"),
    ("field_id", "'field_' || lpad(CAST(user_id % 12 + 1 AS STRING), 2, '0')"),
    ("location", "'loc_' || CAST(user_id % 12 % 4 AS STRING)"),
    ("sensor_avg_temperature", "CAST(event_id * 7919 % 450 AS DOUBLE)/10 - 5"),
    ("sensor_avg_humidity", "CAST(event_id * 104729 % 800 AS DOUBLE)/10 + 20"),
    ("sensor_avg_soil_ph", "CAST(event_id * 31 % 60 AS DOUBLE)/10 + 3"),
    ("temp_differential", "CAST(event_id * 6007 % 150 AS DOUBLE)/10"),
    ("humidity_differential", "CAST(event_id * 3571 % 300 AS DOUBLE)/10"),
    ("sensor_anomaly_rate", "CAST(event_id * 97 % 20 AS DOUBLE)/100"),
    ("weather_avg_uv_index", "CASE WHEN event_id % 103 = 0 THEN NULL ELSE CAST(event_id * 2099 % 110 AS DOUBLE)/10 END"),
    ("weather_avg_wind_speed", "CAST(event_id * 4001 % 500 AS DOUBLE)/10"),
    ("temporal_feature_ml_sin", "CAST(event_id * 13 % 21 AS DOUBLE)/10 - 1"),
    ("temporal_feature_ml_cos", "CAST(event_id * 17 % 21 AS DOUBLE)/10 - 1"),
)
#: Text times of messages: microseconds with offset, seconds with offset, or no time.
_TEXT_TIME = "CASE event_id % 3 WHEN 0 THEN date_format(event_ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || '+00:00' WHEN 1 THEN date_format(event_ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '+00:00' ELSE 'not-a-time' END"
#: The times that these texts mean, as SQL; and times of images, of which a tenth is none.
PARSED_TIME = "CASE event_id % 3 WHEN 0 THEN event_ts WHEN 1 THEN date_trunc('second', event_ts) END"
_IMAGE_TIME = "CASE WHEN doc_id % 10 = 4 THEN 'not-a-time' ELSE '2024-01-15T10:' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || ':00Z' END"
FIELDS_SQL = "SELECT DISTINCT 'field_' || lpad(CAST(user_id % 12 + 1 AS STRING), 2, '0') AS field_id FROM events UNION SELECT 'field_99' AS field_id"


def _projected(rows: DataFrame, columns: tuple[tuple[str, str], ...]) -> DataFrame:
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in columns])


def sql(name: str) -> str:
    """The same projection as a SELECT."""
    columns, source = {"sensor": (SENSOR, "events"), "weather": (WEATHER, "events"), "features": (FEATURES, "events"), "satellite": (SATELLITE, "documents")}[name]
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns) + f" FROM {source}"


def sensor(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Sensor readings with a text `timestamp`, of which a third is no time."""
    return _projected(table(spark, sf_dir, "events", parts), SENSOR).withColumn("timestamp", F.expr(_TEXT_TIME))


def weather(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _projected(table(spark, sf_dir, "events", parts), WEATHER).withColumn("timestamp", F.expr(_TEXT_TIME))


def satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpacked images: the size is that of the document's text in UTF-8."""
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length("text").alias("image_size_bytes")
    return docs.select(*[F.expr(e).alias(n) for n, e in SATELLITE], size, F.expr(_IMAGE_TIME).alias("timestamp"), F.concat(F.lit("satellite-images/"), F.col("doc_id").cast("string")).alias("image_path"))


def features(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _projected(table(spark, sf_dir, "events", parts), FEATURES)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected fields: those of the events, and one without readings."""
    own = table(spark, sf_dir, "events").selectExpr(f"{SENSOR[2][1]} AS field_id").distinct()
    return own.union(spark.sql("SELECT 'field_99' AS field_id"))


def _envelope(rows: DataFrame, topic: str, members: tuple[str, ...], time: str = _TEXT_TIME) -> DataFrame:
    value = F.to_json(F.struct(F.expr(time).alias("timestamp"), *members)).cast("binary")
    return rows.select(value.alias("value"), F.lit(topic).alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("event_ts").cast("timestamp").alias("timestamp"))


def sensor_messages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Sensor readings as messages; a third of them has no readable time."""
    return _envelope(_projected(table(spark, sf_dir, "events", parts), SENSOR), "sensor_data", ("field_id", "location", "latitude", "longitude", "temperature", "humidity", "soil_ph"))


def weather_messages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    rows = _projected(table(spark, sf_dir, "events", parts), WEATHER)
    return _envelope(rows, "weather_data", ("location", "lat", "lon", "temp_c", "humidity", "wind_kph", "condition", "uv", "precip_mm"))


def feature_messages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Feature rows as messages."""
    rows = features(spark, sf_dir, parts)
    members = [c for c in rows.columns if c not in ("id", "prediction_ts")]
    value = F.to_json(F.struct(*members, F.col("prediction_ts").cast("timestamp").alias("processing_timestamp"))).cast("binary")
    return rows.select(value.alias("value"), F.lit("gold_features").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"), F.col("prediction_ts").cast("timestamp").alias("timestamp"))


def satellite_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images: the text in base64, a box of four corners, none for every tenth."""
    docs = table(spark, sf_dir, "documents")
    corners = F.array(*[F.expr(e) for _, e in SATELLITE[1:]])
    box = F.struct(F.when(F.col("doc_id") % 10 != 0, corners).alias("bbox")).alias("location")
    time = F.concat(F.lit("2024-01-15T10:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.expr("CASE doc_id % 3 WHEN 0 THEN ':00Z' WHEN 1 THEN ':00+02:00' ELSE ':00' END"))
    value = F.to_json(F.struct(time.alias("timestamp"), F.base64(F.encode("text", "UTF-8")).alias("image_base64"), box)).cast("binary")
    return docs.select(value.alias("value"), F.lit("satellite_data").alias("topic"), F.lit(0).alias("partition"), F.col("doc_id").alias("offset"), F.expr("TIMESTAMP '2024-01-15 12:00:00'").alias("timestamp"))
