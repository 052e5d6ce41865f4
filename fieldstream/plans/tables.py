"""Alert and prediction tables derived from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, ml
from ..schemas import CORE_FEATURES, STATUSES
from ..sources import fixtures
from .layers import SENSOR_ALERT_SQL, SENSOR_CTE, WEATHER_ALERT_SQL, WEATHER_CTE, silver_sensor_rows, silver_weather_rows

#: A scaler and centroids of a fixed size, so that scores can be checked by SQL.
SCORER = ml.Scorer(
    mean=(17.5, 60.0, 6.0, 7.5, 15.0, 0.1, 5.5, 25.0, 0.0, 0.0),
    std=(39.0, 69.0, 5.25, 13.0, 26.0, 0.17, 9.6, 43.0, 1.8, 1.8),
    centroids=((-0.3, -0.2, 0.1, 0.0, 0.1, -0.1, 0.2, 0.0, 0.2, -0.2), (0.3, 0.2, -0.1, 0.1, -0.1, 0.1, -0.2, 0.1, -0.2, 0.2), (0.0, 0.1, 0.3, -0.2, 0.2, 0.2, 0.0, -0.3, 0.0, 0.0)),
    version="v2024-01-28_02-00",
)

_STATUS = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUSES))
ALERTS_CTE = f"""{SENSOR_CTE}, {WEATHER_CTE},
 alerts AS (SELECT 2 * event_id AS id, zone_id, alert_timestamp, alert_type, severity, message, CASE event_id % 4 {_STATUS} END AS status, alert_timestamp AS created_at FROM ({SENSOR_ALERT_SQL})
  UNION ALL SELECT 2 * event_id + 1 AS id, zone_id, alert_timestamp, alert_type, severity, message, CASE event_id % 4 {_STATUS} END AS status, alert_timestamp AS created_at FROM ({WEATHER_ALERT_SQL}))"""


def _table(rows: DataFrame, odd: int) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 4 + 1).cast("int"))
    return rows.select((2 * F.col("event_id") + odd).alias("id"), "zone_id", "alert_timestamp", "alert_type", "severity", "message", status.alias("status"), F.col("alert_timestamp").alias("created_at"))


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts of sensors (even ids) and weather (odd ids), with statuses by event."""
    return _table(alerts.sensor(silver_sensor_rows(spark, sf_dir), "event_id"), 0).unionByName(_table(alerts.weather(silver_weather_rows(spark, sf_dir), "event_id"), 1))


def prediction_table(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Scores of the feature rows by the fixed model."""
    return ml.scored(fixtures.features(spark, sf_dir, parts), SCORER, F.col("prediction_ts"))


def _distance_sql(centroid: tuple[float, ...]) -> str:
    return "sqrt(0e0 + " + " + ".join(f"(s{i} - ({c}::DOUBLE)) * (s{i} - ({c}::DOUBLE))" for i, c in enumerate(centroid)) + ")"


PREDICTIONS_CTE = f"""f_raw AS ({fixtures.sql("features")}),
 f_scaled AS (SELECT *, {", ".join(f"({c} - ({m}::DOUBLE)) / ({s}::DOUBLE) AS s{i}" for i, (c, m, s) in enumerate(zip(CORE_FEATURES, SCORER.mean, SCORER.std, strict=True)))} FROM f_raw WHERE {" AND ".join(f"{c} IS NOT NULL" for c in CORE_FEATURES)}),
 f_distance AS (SELECT *, {", ".join(f"{_distance_sql(c)} AS d{i}" for i, c in enumerate(SCORER.centroids))} FROM f_scaled),
 f_least AS (SELECT *, least(d0, d1, d2) AS anomaly_score FROM f_distance),
 predictions AS (SELECT id, field_id, location, prediction_ts AS prediction_timestamp, {", ".join(CORE_FEATURES)}, anomaly_score, CAST(CASE anomaly_score WHEN d0 THEN 0 WHEN d1 THEN 1 ELSE 2 END AS INTEGER) AS cluster, anomaly_score > 1 AS is_anomaly,
  CASE WHEN anomaly_score > 4 THEN 'CRITICAL' WHEN anomaly_score > 1 THEN 'HIGH' WHEN anomaly_score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  {ml.recommended_sql()} AS recommendations, '{SCORER.version}' AS model_version FROM f_least)"""
