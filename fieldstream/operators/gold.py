"""Feature layer: one row a field over a look-back window or event-time windows.

Aggregates are by key with map-side partial aggregation, so a location with a
third of all rows costs no more than others. A location joins to one weather
row; AQE broadcasts that side when it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_of_literal, on_days, within

# Metrics of the feature table and the names they get there.
SENSOR_METRICS = (("temperature", "temperature", "temp"), ("humidity", "humidity", "humidity"), ("soil_ph", "soil_ph", "ph"))
SENSOR_RATES = (("temperature_valid", "temp"), ("humidity_valid", "humidity"), ("ph_valid", "ph"))
WEATHER_METRICS = (("temp_c", "temperature", "temp"), ("humidity", "humidity", "humidity"), ("wind_kph", "wind_speed", "wind"), ("uv", "uv_index", "uv"), ("precip_mm", "precipitation", "precip"))


def _statistics(prefix: str, metrics: tuple[tuple[str, str, str], ...]) -> list[Column]:
    return [f(c).alias(f"{prefix}_{name}_{long}") for c, long, _ in metrics for name, f in (("avg", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]


def _ranges(prefix: str, metrics: tuple[tuple[str, str, str], ...]) -> dict[str, Column]:
    return {f"{prefix}_{short}_range": F.col(f"{prefix}_max_{long}") - F.col(f"{prefix}_min_{long}") for _, long, short in metrics}


def sensor_aggregates() -> list[Column]:
    rates = [F.avg(F.col(flag).cast("int")).alias(f"sensor_{short}_valid_rate") for flag, short in SENSOR_RATES]
    invalid = [F.count_if(~F.col(flag)).alias(f"sensor_{short}_invalid_count") for flag, short in SENSOR_RATES]
    ends = [F.min("timestamp_parsed").alias("sensor_first_reading"), F.max("timestamp_parsed").alias("sensor_last_reading")]
    return [*_statistics("sensor", SENSOR_METRICS), *rates, F.count("*").alias("sensor_readings_count"), *invalid, *ends, F.mode("month", True).alias("sensor_dominant_month")]


def sensor_derived(rows: DataFrame) -> DataFrame:
    """Ranges, anomaly count and rate, and the quality score."""
    rows = rows.withColumns(_ranges("sensor", SENSOR_METRICS))
    count = sum((F.col(f"sensor_{short}_invalid_count") for _, short in SENSOR_RATES), F.lit(0))
    rates = sum((F.col(f"sensor_{short}_valid_rate") for _, short in SENSOR_RATES), F.lit(0.0))
    rows = rows.withColumn("sensor_anomaly_count", count)
    rate = F.when(F.col("sensor_readings_count") > 0, F.col("sensor_anomaly_count") / F.col("sensor_readings_count")).otherwise(0.0)
    return rows.withColumns({"sensor_anomaly_rate": rate, "sensor_data_quality_score": rates / 3})


def weather_aggregates() -> list[Column]:
    ends = [F.min("timestamp_parsed").alias("weather_first_reading"), F.max("timestamp_parsed").alias("weather_last_reading")]
    return [*_statistics("weather", WEATHER_METRICS), F.sum("precip_mm").alias("weather_total_precipitation"), F.mode("condition", True).alias("weather_dominant_condition"), F.count("*").alias("weather_readings_count"), *ends]


def weather_derived(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_ranges("weather", WEATHER_METRICS))


def in_window(rows: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """Rows of the look-back, with a predicate on the date partition so that whole folders are skipped."""
    end = as_of_literal(as_of)
    start = end - F.make_interval(mins=F.lit(minutes))
    return rows.where(on_days(start, end) & within("timestamp_parsed", as_of, mins=minutes))


def sensor_features(rows: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    return sensor_derived(in_window(rows, as_of, minutes).groupBy("field_id", "location").agg(*sensor_aggregates()))


def weather_features(rows: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    return weather_derived(in_window(rows, as_of, minutes).groupBy("location").agg(*weather_aggregates()))


def _names(prefix: str, metrics: tuple[tuple[str, str, str], ...]) -> list[str]:
    return [x for _, long, short in metrics for x in (*(f"{prefix}_{s}_{long}" for s in ("avg", "std", "min", "max")), f"{prefix}_{short}_range")]


#: The feature table's columns, in order.
COLUMNS = (
    "field_id",
    "location",
    *_names("sensor", SENSOR_METRICS),
    *(f"sensor_{short}_valid_rate" for _, short in SENSOR_RATES),
    "sensor_readings_count",
    "sensor_anomaly_count",
    "sensor_anomaly_rate",
    "sensor_data_quality_score",
    "sensor_dominant_month",
    *_names("weather", WEATHER_METRICS),
    "weather_total_precipitation",
    "weather_dominant_condition",
    "weather_readings_count",
    "temp_differential",
    "humidity_differential",
    "sensor_data_freshness_minutes",
    "weather_data_freshness_minutes",
    "temporal_feature_ml_sin",
    "temporal_feature_ml_cos",
    "processing_timestamp",
    "window_start_time",
    "window_end_time",
    "window_duration_minutes",
)


def joined(sensors: DataFrame, weather: DataFrame) -> DataFrame:
    """Sensor features with the weather features of their location; a field without weather has no row."""
    return sensors.join(weather, "location", "inner")


def cross_features(rows: DataFrame, as_of: str, minutes: int) -> DataFrame:
    end = as_of_literal(as_of)
    age = lambda c: (F.unix_timestamp(end) - F.unix_timestamp(c)) / 60.0
    turn = 2 * F.pi() * (F.col("sensor_dominant_month") - 1) / 12
    return rows.withColumns(
        {
            "temp_differential": F.abs(F.col("sensor_avg_temperature") - F.col("weather_avg_temperature")),
            "humidity_differential": F.abs(F.col("sensor_avg_humidity") - F.col("weather_avg_humidity")),
            "sensor_data_freshness_minutes": age("sensor_last_reading"),
            "weather_data_freshness_minutes": age("weather_last_reading"),
            "temporal_feature_ml_sin": F.sin(turn),
            "temporal_feature_ml_cos": F.cos(turn),
            "processing_timestamp": end,
            "window_start_time": end - F.make_interval(mins=F.lit(minutes)),
            "window_end_time": end,
            "window_duration_minutes": F.lit(minutes),
        }
    )


def features(sensors: DataFrame, weather: DataFrame, fields: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """The feature table: a row for each expected field (column field_id of `fields`), null where it has no data."""
    both = joined(sensor_features(sensors, as_of, minutes), weather_features(weather, as_of, minutes))
    return fields.select("field_id").join(cross_features(both, as_of, minutes), "field_id", "left").select(*COLUMNS)


def windowed(rows: DataFrame, keys: tuple[str, ...], aggregates: list[Column], minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Aggregates by event-time window, for batch and streams; a stream drops rows later than `late`."""
    span = F.window("timestamp_parsed", f"{minutes} minutes")
    return rows.withWatermark("timestamp_parsed", late).groupBy(span.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[a for a in _aliases(aggregates)])


def _aliases(aggregates: list[Column]) -> list[str]:
    return [c._jc.toString().rpartition(" AS ")[2].strip("`") for c in aggregates]

