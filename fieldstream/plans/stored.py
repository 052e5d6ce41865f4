"""Queries over tables that are written, changed, compacted and read back by their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import as_of_literal, utc
from ..operators import bronze, gold, reports, silver
from ..schemas import SENSOR_RAW
from ..sources import fixtures, readers, sinks
from ..sources.stored import Stored
from ..streaming import jobs
from .layers import SENSOR_CTE, rounded, sensor_features_sql
from .models import history
from .registry import AS_OF, MINUTES, query
from .reports import ACTIVE_SQL, RETAINED_SQL, STATUS_SQL
from .tables import ALERTS_CTE, PREDICTIONS_CTE, alert_table, prediction_table

_START = "2024-01-20 00:00:00"


def alert_store(spark: SparkSession, sf_dir: str, batches: int = 6) -> Stored:
    """The alert table, written in batches of consecutive times; the last batch comes twice."""
    table = Stored(spark, sinks.work_dir(spark, "alerts"), "alert_timestamp")
    rows = alert_table(spark, sf_dir).persist()  # each batch reads it
    part = F.least(F.floor((F.dayofmonth("alert_timestamp") - 1) * batches / 30), F.lit(batches - 1))
    for n in [*range(batches), batches - 1]:
        table.append(rows.where(part == n), n)
    rows.unpersist()
    return table


def _change(table: Stored) -> int:
    rows = table.read().select("id", F.when(F.col("id") % 10 == 0, "RESOLVED").when(F.col("id") % 15 == 0, "ACKNOWLEDGED").alias("status"))
    return table.change(rows.where("status IS NOT NULL"))


@query(STATUS_SQL)
def stored_alert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses after a change of the stored table."""
    table = alert_store(spark, sf_dir)
    _change(table)
    return table.read().select("id", "status")


@query(f"WITH {ALERTS_CTE} SELECT count(*) AS n_changed FROM alerts WHERE id % 10 = 0 OR id % 15 = 0")
def stored_alert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_change(alert_store(spark, sf_dir)),)], "n_changed long")


@query(RETAINED_SQL)
def stored_alert_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after old closed alerts have been removed, and its small files compacted."""
    table = alert_store(spark, sf_dir)
    table.remove(reports.closed(AS_OF, 14))
    table.compact()
    return table.read()


@query(ACTIVE_SQL)
def stored_alerts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest active alerts, from the newest files alone."""
    since = as_of_literal(AS_OF) - F.make_interval(hours=F.lit(24))
    return alert_store(spark, sf_dir).newest(100, (F.col("status") == "ACTIVE") & F.col("alert_timestamp").between(since, as_of_literal(AS_OF)))


@query(f"WITH {PREDICTIONS_CTE} SELECT id, field_id, prediction_timestamp, severity FROM predictions ORDER BY prediction_timestamp DESC, id DESC LIMIT 100")
def stored_predictions_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Stored(spark, sinks.work_dir(spark, "predictions"), "prediction_timestamp")
    rows = prediction_table(spark, sf_dir)
    for n in range(3):
        table.append(rows.where(F.floor((F.dayofmonth("prediction_timestamp") - 1) / 10) == n), n)
    return table.newest(100).select("id", "field_id", "prediction_timestamp", "severity")


def history_store(spark: SparkSession, sf_dir: str) -> Stored:
    """Feature rows by processing time, a batch every ten days."""
    table = Stored(spark, sinks.work_dir(spark, "gold"), "processing_timestamp")
    rows = history(spark, sf_dir)
    for n in range(3):
        table.append(rows.where(F.least(F.floor((F.dayofmonth("processing_timestamp") - 1) / 10), F.lit(2)) == n), n)
    return table


_FEATURES = fixtures.sql("features")


@query(f"WITH f AS ({_FEATURES}), n AS (SELECT count(*) FILTER (prediction_ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{AS_OF}') AS inside FROM f) SELECT id FROM f, n WHERE CASE WHEN inside >= 100 THEN prediction_ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{AS_OF}' ELSE true END")
def stored_train_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of a range, decided by the bounds of files."""
    return history_store(spark, sf_dir).range_or_all(as_of_literal(_START), as_of_literal(AS_OF), 100).select("id")


@query(f"WITH f AS ({_FEATURES}) SELECT id FROM f")
def stored_train_set_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_store(spark, sf_dir).range_or_all(as_of_literal("2030-01-01 00:00:00"), as_of_literal("2030-01-02 00:00:00"), 100).select("id")


@query(f"WITH f AS ({_FEATURES}) SELECT count(*) AS n_rows FROM f WHERE prediction_ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{AS_OF}'")
def stored_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(history_store(spark, sf_dir).count(as_of_literal(_START), as_of_literal(AS_OF)),)], "n_rows long")


def silver_store(spark: SparkSession, sf_dir: str) -> Stored:
    """Validated readings that a stream appends, compacts, and appends to again."""
    root = sinks.work_dir(spark, "silver-stored")
    table = Stored(spark, f"{root}/silver", "timestamp_parsed")
    messages = fixtures.sensor_messages(spark, sf_dir)
    for half in range(2):
        dealt, n = jobs.spread(messages.where(F.col("offset") % 2 == half))
        dealt.write.mode("append").parquet(f"{root}/in")
        stream = readers.message_stream(spark, "sensor_data", "parquet", path=f"{root}/in", per_trigger=-(-n // 2))
        jobs.drained(jobs.bronze_job(stream, bronze.sensor, f"{root}/bronze", f"{root}/checkpoint/bronze", jobs.NOW, keys=("year", "month", "day"), gather=4))
        rows = readers.json_stream(spark, f"{root}/bronze", f"{SENSOR_RAW}, kafka_offset bigint")
        jobs.drained(jobs.silver_job(rows, silver.sensor, silver.SENSOR_MESSAGE, "sensor", jobs.stored_table(table), f"{root}/checkpoint/silver", trigger=jobs.NOW))
        if not half:
            table.compact()
    return table


@query(f"WITH {SENSOR_CTE} SELECT event_id, field_id, timestamp_parsed, temperature FROM s_ok")
def stored_silver_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_store(spark, sf_dir).read().select(F.col("kafka_offset").alias("event_id"), "field_id", utc("timestamp_parsed").alias("timestamp_parsed"), "temperature")


@query(sensor_features_sql("s_ok"))
def gold_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor features of the look-back, of whose files only those are read that meet it."""
    end = as_of_literal(AS_OF)
    rows = silver_store(spark, sf_dir).read((end - F.make_interval(mins=F.lit(MINUTES))).cast("timestamp"), end.cast("timestamp"))
    found = gold.sensor_features(rows.withColumn("timestamp_parsed", utc("timestamp_parsed")), AS_OF, MINUTES)
    return rounded(found.select("field_id", "location", "sensor_avg_temperature", "sensor_readings_count", "sensor_last_reading"))
