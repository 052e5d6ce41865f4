"""The alert and prediction tables where they lie in a database: reports and changes that the database does itself.

Tables come through a catalog, so that Spark hands filters, columns, groups and
aggregates to the database and gets a row a group. A report that counts by
conditions takes groups by its discrete columns there and adds up those few rows
here. Sorted limits are handed over only where `attach` is told that the database's
dialect writes them; elsewhere Spark sorts the rows that pass the filters.

Defined results: those of the reports of the same names; an empty table has no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import as_of_literal, within
from . import sinks

CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
#: Text columns of the tables with lengths, which databases need to compare and group by them.
TEXTS = {
    "alerts": {"zone_id": 255, "alert_type": 32, "severity": 16, "message": 4000, "status": 16},
    "ml_predictions": {"field_id": 255, "location": 255, "severity": 16, "recommendations": 4000, "model_version": 64},
}


def create(rows: DataFrame, url: str, name: str, **properties: str) -> None:
    """Append rows to a database table, which is made with bounded texts if it is not there."""
    types = ", ".join(f"{c} VARCHAR({n})" for c, n in TEXTS.get(name, {}).items() if c in rows.columns)
    sinks.write_jdbc(rows, url, name, **properties, **({"createTableColumnTypes": types} if types else {}))


def attach(spark: SparkSession, catalog: str, url: str, driver: str, limits: bool = False, **options: str) -> None:
    """Make a database's tables readable as catalog.schema.table; hand sorted limits over only where its dialect writes them, as some drop them without notice."""
    settings = {"": CATALOG, ".url": url, ".driver": driver, ".pushDownAggregate": "true", ".pushDownLimit": str(limits).lower(), **{f".{k}": v for k, v in options.items()}}
    for key, value in settings.items():
        spark.conf.set(f"spark.sql.catalog.{catalog}{key}", value)


def _groups(predictions: DataFrame) -> DataFrame:
    """Counts and scores by field and verdict, which the database adds up."""
    scores = [F.count("anomaly_score").alias("scored"), F.sum("anomaly_score").alias("total"), F.max("anomaly_score").alias("high"), F.min("anomaly_score").alias("low")]
    return predictions.groupBy("field_id", "is_anomaly").agg(F.count(F.lit(1)).alias("n"), *scores)


def _mean() -> Column:
    return F.sum("total") / F.sum("scored")


def _total(condition: Column | str = "true") -> Column:
    """Rows of the groups that meet a condition."""
    return F.coalesce(F.sum(F.when(F.expr(condition) if isinstance(condition, str) else condition, F.col("n"))), F.lit(0))


def field_summary(predictions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    found = _groups(predictions.where(within("prediction_timestamp", as_of, days=days)))
    return found.groupBy("field_id").agg(_mean().alias("avg_score"), F.sum("n").alias("n_predictions"), _total("is_anomaly").alias("n_anomalies"))


def field_statistics(predictions: DataFrame) -> DataFrame:
    """Totals, anomalies, their rate in per cent and score statistics by field."""
    rate = F.round(100.0 * _total("is_anomaly") / F.sum("n"), 2).alias("anomaly_rate")
    scores = [F.round(c, 3).alias(f"{name}_score") for name, c in (("avg", _mean()), ("max", F.max("high")), ("min", F.min("low")))]
    return _groups(predictions).groupBy("field_id").agg(F.sum("n").alias("n_predictions"), _total("is_anomaly").alias("n_anomalies"), rate, *scores)


def alert_indicators(alerts: DataFrame) -> DataFrame:
    groups = alerts.groupBy("zone_id", "alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    kinds = [_total(F.col("alert_type") == kind).alias(name) for kind, name in (("SENSOR_ANOMALY", "n_sensor"), ("WEATHER_ALERT", "n_weather"))]
    return groups.agg(_total().alias("n_alerts"), _total(F.col("severity") == "HIGH").alias("n_high"), F.countDistinct("zone_id").alias("n_zones"), *kinds)


def change_status(changes: DataFrame, url: str, name: str, key: str, **properties: str) -> int:
    """Give rows of a table new statuses from rows (id, status), one a given id; returns how many changed.

    Tasks write the changes to a staging table named after `key`, which a second try
    makes anew; one transaction applies them, so that all take effect or none.
    """
    staging = f"{name}_change_{key}"
    changes.select(F.col("id").cast("long").alias("id"), "status").write.jdbc(url, staging, mode="overwrite", properties={**properties, "createTableColumnTypes": "status VARCHAR(16)"})
    new = f'SELECT s."status" FROM {staging} s WHERE s."id" = {name}."id"'
    return sinks.transaction(changes.sparkSession, url, [f'UPDATE {name} SET "status" = ({new}) WHERE "id" IN (SELECT "id" FROM {staging})', f"DROP TABLE {staging}"], **properties)[0]


def remove_closed(spark: SparkSession, url: str, name: str, as_of: str, days: int = 30, **properties: str) -> int:
    """Delete closed alerts older than days; returns how many went."""
    limit = spark.range(1).select((as_of_literal(as_of) - F.make_interval(days=F.lit(days))).cast("string")).first()[0]
    statement = f"DELETE FROM {name} WHERE \"status\" IN ('RESOLVED', 'IGNORED') AND \"alert_timestamp\" < CAST('{limit}' AS TIMESTAMP)"
    return sinks.transaction(spark, url, [statement], **properties)[0]
