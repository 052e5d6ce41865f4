"""Reports on the alert and prediction tables, and changes of the alert table.

Times are relative to `as_of`. Where the original order is by time alone, the
id breaks ties, so that limits are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import LOCAL_ZONE, as_of_literal, within


def _newest(rows: DataFrame, time: str) -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc("id"))


def active(alerts: DataFrame, as_of: str, limit: int = 100, hours: int = 24) -> DataFrame:
    """Newest active alerts of the last hours."""
    return _newest(alerts.where((F.col("status") == "ACTIVE") & within("alert_timestamp", as_of, hours=hours)), "alert_timestamp").limit(limit)


def active_of_type(alerts: DataFrame, kind: str, as_of: str, limit: int = 100) -> DataFrame:
    """Those of a type among the newest active alerts; the limit comes first."""
    return active(alerts, as_of, limit).where(F.col("alert_type") == kind)


def history(rows: DataFrame, time: str, as_of: str, days: int, key: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of the last days, newest first, of one key value where given."""
    found = rows.where(within(time, as_of, days=days))
    return _newest(found.where(F.col(key) == value) if key and value is not None else found, time)


def recent(rows: DataFrame, time: str, limit: int, key: str | None = None, value: str | None = None) -> DataFrame:
    """Newest rows, of one key value where given."""
    return _newest(rows.where(F.col(key) == value) if key and value is not None else rows, time).limit(limit)


def selected(rows: DataFrame, **lists: tuple[str, ...]) -> DataFrame:
    """Rows whose columns are in the given lists; an empty list selects all."""
    for column, values in lists.items():
        rows = rows.where(F.col(column).isin(*values)) if values else rows
    return rows


def severity_rank() -> Column:
    return F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0)


def ranked(alerts: DataFrame, limit: int = 10, gravest_first: bool = True) -> DataFrame:
    """Alerts by severity and time, gravest and newest first (or least grave first)."""
    rank = severity_rank()
    return alerts.orderBy(rank.desc() if gravest_first else rank.asc(), F.desc("alert_timestamp"), F.desc("id")).limit(limit)


def alert_statistics(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return alerts.where(within("alert_timestamp", as_of, hours=hours)).groupBy("alert_type", "severity", "status").agg(F.count("*").alias("n_alerts"))


def alerts_by_hour(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    hour = F.date_trunc("hour", "alert_timestamp").cast("timestamp_ntz").alias("hour")
    return alerts.where(within("alert_timestamp", as_of, hours=hours)).groupBy(hour).agg(F.count("*").alias("n_alerts")).orderBy(F.desc("hour"))


def prediction_statistics(predictions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    found = predictions.where(within("prediction_timestamp", as_of, days=days))
    return found.groupBy("field_id", "severity", "is_anomaly").agg(F.count("*").alias("n_predictions"), F.avg("anomaly_score").alias("avg_score"))


def field_summary(predictions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    found = predictions.where(within("prediction_timestamp", as_of, days=days))
    return found.groupBy("field_id").agg(F.avg("anomaly_score").alias("avg_score"), F.count("*").alias("n_predictions"), F.count_if("is_anomaly").alias("n_anomalies"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def field_statistics(predictions: DataFrame) -> DataFrame:
    """Totals, anomalies, their rate in per cent and score statistics by field."""
    rate = F.round(100.0 * F.count_if("is_anomaly") / F.count("*"), 2)
    scores = [F.round(f("anomaly_score"), 3).alias(f"{name}_score") for name, f in (("avg", F.avg), ("max", F.max), ("min", F.min))]
    return predictions.groupBy("field_id").agg(F.count("*").alias("n_predictions"), F.count_if("is_anomaly").alias("n_anomalies"), rate.alias("anomaly_rate"), *scores)


def alert_indicators(alerts: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("alert_type") == kind).alias(name) for kind, name in (("SENSOR_ANOMALY", "n_sensor"), ("WEATHER_ALERT", "n_weather"))]
    return alerts.agg(F.count("*").alias("n_alerts"), F.count_if(F.col("severity") == "HIGH").alias("n_high"), F.countDistinct("zone_id").alias("n_zones"), *kinds)


def conditions_by_location(weather: DataFrame) -> DataFrame:
    """Locations of each condition as one sorted list; take latest weather, one row a location."""
    return weather.where(F.col("condition").isNotNull()).groupBy("condition").agg(F.array_join(F.array_sort(F.collect_set("location")), ", ").alias("locations"))


def map_center(sensors: DataFrame, default: tuple[float, float] = (45.4384, 10.9917)) -> DataFrame:
    """Mean coordinates of the rows that have both, or the default."""
    both = sensors.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return both.agg(F.coalesce(F.avg("latitude"), F.lit(default[0])).alias("latitude"), F.coalesce(F.avg("longitude"), F.lit(default[1])).alias("longitude"))


def field_status(fields: DataFrame, latest_alerts: DataFrame) -> DataFrame:
    """Colour of each field by its latest alert."""
    joined = fields.join(latest_alerts.select(F.col("zone_id").alias("field_id"), "severity", "message"), "field_id", "left")
    colour = F.when(F.col("severity").isNull(), "green").when(F.col("severity") == "HIGH", "red").when(F.col("severity") == "MEDIUM", "orange").otherwise("yellow")
    return joined.withColumn("colour", colour)


def alert_display(alerts: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Local time as text, and the message without its prefix; time is zoneless UTC."""
    shown = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), "alert_timestamp"), "dd/MM/yyyy HH:mm:ss")
    return alerts.withColumns({"shown_time": shown, "shown_message": F.regexp_replace("message", r"^(Weather )?Alert: ", "")})


def score_display(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("shown_score", F.format_number("anomaly_score", 2))


def anomaly_timeline(predictions: DataFrame) -> DataFrame:
    return predictions.select("id", "field_id", "prediction_timestamp", F.col("is_anomaly").cast("int").alias("anomaly")).orderBy("field_id", "prediction_timestamp", "id")


def alert_timeline(alerts: DataFrame) -> DataFrame:
    return alerts.select("id", "zone_id", "alert_timestamp", F.lit(1).alias("alert")).orderBy("zone_id", "alert_timestamp", "id")


def violations(alerts: DataFrame, predictions: DataFrame, enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows that break the tables' constraints: (table_name, id, constraint_name)."""
    checks = [
        ("alerts", alerts, "zone_id", F.col("zone_id").isNull()),
        ("alerts", alerts, "message", F.col("message").isNull()),
        *(("alerts", alerts, c, F.col(c).isNull() | ~F.col(c).isin(*enums[c])) for c in ("alert_type", "severity", "status")),
        ("ml_predictions", predictions, "field_id", F.col("field_id").isNull()),
        ("ml_predictions", predictions, "severity", ~F.col("severity").isin(*enums["severity"])),
    ]
    out = None
    for table, rows, name, broken in checks:
        part = rows.where(broken).select(F.lit(table).alias("table_name"), F.col("id").cast("long").alias("id"), F.lit(name).alias("constraint_name"))
        out = part if out is None else out.unionByName(part)
    return out


def with_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """The alert table with new statuses from rows (id, new_status)."""
    return alerts.join(changes, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def closed(as_of: str, days: int = 30) -> Column:
    """Whether an alert is closed and older than days."""
    old = F.col("alert_timestamp") < as_of_literal(as_of) - F.make_interval(days=F.lit(days))
    return old & F.col("status").isin("RESOLVED", "IGNORED")


def retained(alerts: DataFrame, as_of: str, days: int = 30, gone: bool = False) -> DataFrame:
    """The alert table without closed alerts older than days (or those that go)."""
    return alerts.where(closed(as_of, days) if gone else ~F.coalesce(closed(as_of, days), F.lit(False)))
