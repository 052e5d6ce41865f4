"""Threshold alerts from validated readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SENSOR_ALERTS, WEATHER_ALERTS, Threshold, alert_message, alert_severity, fires


def raised(rows: DataFrame, thresholds: tuple[Threshold, ...], zone: str, kind: str, prefix: str, otherwise: str, time: Column, *keep: str) -> DataFrame:
    """Alerts of the rows beyond a threshold whose flag holds: zone_id, alert_timestamp, alert_type, severity, message, status, and the columns to keep."""
    return rows.where(fires(thresholds)).select(
        *keep,
        F.col(zone).alias("zone_id"),
        time.alias("alert_timestamp"),
        F.lit(kind).alias("alert_type"),
        alert_severity(thresholds).alias("severity"),
        alert_message(thresholds, prefix, otherwise).alias("message"),
        F.lit("ACTIVE").alias("status"),
    )


def sensor(rows: DataFrame, *keep: str, time: str = "timestamp_parsed") -> DataFrame:
    return raised(rows, SENSOR_ALERTS, "field_id", "SENSOR_ANOMALY", "Alert: ", "Threshold exceeded", F.col(time), *keep)


def weather(rows: DataFrame, *keep: str, time: str = "timestamp_parsed") -> DataFrame:
    return raised(rows, WEATHER_ALERTS, "location", "WEATHER_ALERT", "Weather Alert: ", "Weather threshold exceeded", F.col(time), *keep)
