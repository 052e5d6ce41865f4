"""Rules as data, compiled to columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """A closed range of a column and the flag that tells whether it holds; null is out of range."""

    column: str
    low: float
    high: float
    flag: str


# Ranges of valid readings.
SENSOR_RANGES = (Range("temperature", -20, 60, "temperature_valid"), Range("humidity", 0, 100, "humidity_valid"), Range("soil_ph", 3, 9, "ph_valid"))
WEATHER_RANGES = (
    Range("temp_c", -50, 60, "temp_valid"),
    Range("humidity", 0, 100, "humidity_valid"),
    Range("wind_kph", 0, 500, "wind_valid"),
    Range("uv", 0, 20, "uv_valid"),
    Range("precip_mm", 0, 1000, "precip_valid"),
)
SENSOR_COORDINATES, WEATHER_COORDINATES = ("latitude", "longitude"), ("lat", "lon")
IMAGE_BYTES = (1_000, 50_000_000)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def holds(column: Column, low: float, high: float) -> Column:
    return F.coalesce(column.between(low, high), F.lit(False))


def range_flags(ranges: tuple[Range, ...], coordinates: tuple[str, str]) -> dict[str, Column]:
    """A flag for each range, and coordinates_valid."""
    lat, lon = map(F.col, coordinates)
    return {r.flag: holds(F.col(r.column), r.low, r.high) for r in ranges} | {"coordinates_valid": holds(lat, -90, 90) & holds(lon, -180, 180)}


def image_flags() -> dict[str, Column]:
    """bbox_valid and image_size_valid (open range) of unpacked images."""
    west, south, east, north = (F.col(f"bbox_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    box = holds(west, -180, 180) & holds(east, -180, 180) & holds(south, -90, 90) & holds(north, -90, 90)
    size = F.col("image_size_bytes")
    return {"bbox_valid": box & F.coalesce((west < east) & (south < north), F.lit(False)), "image_size_valid": F.coalesce((size > IMAGE_BYTES[0]) & (size < IMAGE_BYTES[1]), F.lit(False))}


@dataclass(frozen=True)
class Threshold:
    """One side of an alert rule: fires beyond `cut`, is grave beyond `grave`, and says `text` with the value in place of {}."""

    column: str
    side: str
    cut: float
    grave: float | None
    flag: str
    text: str

    def beyond(self, cut: float) -> Column:
        c = F.col(self.column)
        return {"<": c < cut, ">": c > cut, ">=": c >= cut}[self.side]


# Alert thresholds, in the order in which messages are chosen.
SENSOR_ALERTS = (
    Threshold("temperature", "<", 5, 0, "temperature_valid", "Low temperature {}°C"),
    Threshold("temperature", ">", 40, 45, "temperature_valid", "High temperature {}°C"),
    Threshold("humidity", "<", 30, 20, "humidity_valid", "Low humidity {}%"),
    Threshold("humidity", ">", 90, 95, "humidity_valid", "High humidity {}%"),
    Threshold("soil_ph", "<", 5.5, 4.5, "ph_valid", "Low pH {}"),
    Threshold("soil_ph", ">", 8.0, 9.0, "ph_valid", "High pH {}"),
)
WEATHER_ALERTS = (
    Threshold("temp_c", "<", 0, -10, "temp_valid", "Low temperature {}°C"),
    Threshold("temp_c", ">", 45, 50, "temp_valid", "High temperature {}°C"),
    Threshold("humidity", "<", 30, 20, "humidity_valid", "Low humidity {}%"),
    Threshold("humidity", ">", 85, 95, "humidity_valid", "High humidity {}%"),
    Threshold("wind_kph", ">", 80, 100, "wind_valid", "High wind speed {} km/h"),
    Threshold("uv", ">=", 8, 11, "uv_valid", "High UV index {}"),
    Threshold("precip_mm", ">=", 50, 100, "precip_valid", "Heavy rainfall {} mm"),
)


def fires(thresholds: tuple[Threshold, ...]) -> Column:
    return any_of(F.coalesce(t.beyond(t.cut) & F.col(t.flag), F.lit(False)) for t in thresholds)


def alert_severity(thresholds: tuple[Threshold, ...]) -> Column:
    """HIGH beyond any grave cut, whatever its flag, else MEDIUM."""
    return F.when(any_of(F.coalesce(t.beyond(t.grave), F.lit(False)) for t in thresholds if t.grave is not None), "HIGH").otherwise("MEDIUM")


def alert_message(thresholds: tuple[Threshold, ...], prefix: str, otherwise: str) -> Column:
    """prefix and the text of the first threshold passed, whatever its flag."""
    texts = []
    for t in thresholds:
        before, _, after = t.text.partition("{}")
        texts.append(F.when(t.beyond(t.cut), F.concat(F.lit(before), F.col(t.column).cast("double").cast("string"), F.lit(after))))
    return F.concat(F.lit(prefix), F.coalesce(*texts, F.lit(otherwise)))
