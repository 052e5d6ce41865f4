"""Validated layer: complete rows with calendar parts and validity flags.

`*_flagged` keep rows whose flags are false, the others drop them. Null in any
required column, or a time that does not parse, drops a row; a null reading is
never valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SENSOR_COORDINATES, SENSOR_RANGES, WEATHER_COORDINATES, WEATHER_RANGES, all_of, image_flags, range_flags
from ..functions.times import calendar_parts, once, parse_timestamp

# Required columns and members of validated messages, in order.
SENSOR_REQUIRED = ("temperature", "humidity", "soil_ph", "field_id", "location", "timestamp")
WEATHER_REQUIRED = ("temp_c", "humidity", "wind_kph", "uv", "precip_mm", "condition", "location", "timestamp")
SATELLITE_REQUIRED = ("timestamp", "image_path", "image_size_bytes")
SENSOR_MESSAGE = ("field_id", "location", "latitude", "longitude", "temperature", "humidity", "soil_ph", "temperature_valid", "humidity_valid", "ph_valid", "coordinates_valid")
WEATHER_MESSAGE = ("location", "temp_c", "humidity", "wind_kph", "uv", "condition", "precip_mm", "temp_valid", "humidity_valid", "wind_valid", "uv_valid", "precip_valid", "coordinates_valid")

SENSOR_FLAGS = (*(r.flag for r in SENSOR_RANGES), "coordinates_valid")
WEATHER_FLAGS = (*(r.flag for r in WEATHER_RANGES), "coordinates_valid")
SATELLITE_FLAGS = ("bbox_valid", "image_size_valid")


def complete(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    return rows.dropna(subset=list(required))


def _timed(rows: DataFrame, parsed: Column) -> DataFrame:
    """Rows whose time parses, with it and its calendar parts."""
    return once(rows, timestamp_parsed=parsed).where(F.col("timestamp_parsed").isNotNull()).withColumns(calendar_parts("timestamp_parsed"))


def sensor_flagged(rows: DataFrame) -> DataFrame:
    return _timed(complete(rows, SENSOR_REQUIRED), parse_timestamp(F.col("timestamp"))).withColumns(range_flags(SENSOR_RANGES, SENSOR_COORDINATES))


def weather_flagged(rows: DataFrame) -> DataFrame:
    return _timed(complete(rows, WEATHER_REQUIRED), parse_timestamp(F.col("timestamp"))).withColumns(range_flags(WEATHER_RANGES, WEATHER_COORDINATES))


def satellite_flagged(rows: DataFrame) -> DataFrame:
    """Any time that Spark casts counts for images; they have no day of week."""
    return _timed(complete(rows, SATELLITE_REQUIRED), F.try_to_timestamp("timestamp")).drop("day_of_week").withColumns(image_flags())


def all_valid(rows: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    return rows.where(all_of(F.col(f) for f in flags))


def sensor(rows: DataFrame) -> DataFrame:
    return all_valid(sensor_flagged(rows), SENSOR_FLAGS)


def weather(rows: DataFrame) -> DataFrame:
    return all_valid(weather_flagged(rows), WEATHER_FLAGS)


def satellite(rows: DataFrame) -> DataFrame:
    return all_valid(satellite_flagged(rows), SATELLITE_FLAGS)


def message(columns: tuple[str, ...], time: str = "timestamp_parsed") -> Column:
    """A validated row as JSON; null members are left out."""
    return F.to_json(F.struct(*columns, F.col(time).alias("timestamp"))).alias("value")
