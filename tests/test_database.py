"""Reports and changes that the database does itself: pushed parts of the plans, and the results of the plain reports."""

import pytest
from pyspark.sql import functions as F

from fieldstream.operators import reports
from fieldstream.plans.registry import AS_OF
from fieldstream.plans.tables import alert_table, prediction_table
from fieldstream.sources import database, readers, sinks

SF, DERBY = "/root/testdata/sf0.001", "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    odd = spark.createDataFrame([(10**6, None, "DATA_QUALITY", "LOW", "m", "ACTIVE")], "id long, zone_id string, alert_type string, severity string, message string, status string")
    predictions = prediction_table(spark, SF).select("id", "field_id", "anomaly_score", "is_anomaly", "severity", "prediction_timestamp")
    unscored = spark.createDataFrame([(10**6, "none", None, None, "LOW"), (10**6 + 1, None, 0.5, True, "HIGH")], "id long, field_id string, anomaly_score double, is_anomaly boolean, severity string")
    database.create(alert_table(spark, SF), url, "alerts", driver=DERBY)
    database.create(predictions, url, "ml_predictions", driver=DERBY)
    # rows with nulls, which Spark's writer cannot bind to this database's bounded texts
    rows = ["INSERT INTO alerts (\"id\", \"alert_type\", \"severity\", \"message\", \"status\") VALUES (1000000, 'DATA_QUALITY', 'LOW', 'm', 'ACTIVE')"]
    rows += [f'INSERT INTO ml_predictions ("id", "field_id", "anomaly_score", "is_anomaly", "severity") VALUES {v}' for v in ("(1000000, 'none', NULL, NULL, 'LOW')", "(1000001, NULL, 0.5, TRUE, 'HIGH')")]
    assert sinks.transaction(spark, url, rows, driver=DERBY) == [1, 1, 1]
    alerts = alert_table(spark, SF).unionByName(odd, allowMissingColumns=True)
    predictions = predictions.unionByName(unscored, allowMissingColumns=True)
    database.attach(spark, "farm", url, DERBY)
    return url, alerts, predictions, spark.table("farm.APP.ALERTS"), spark.table("farm.APP.ML_PREDICTIONS")


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()


def values(rows):
    columns = sorted(rows.columns)
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([shown(r[c]) for c in columns]) for r in rows.collect())


def grouped(rows):
    """Whether the database itself groups: its scan gives aggregates."""
    return "PushedAggregates: [" in plan(rows) or "COUNT(" in plan(rows)


def test_aggregates_are_pushed(base):
    _, alerts, predictions, a, p = base
    for mine, want in (
        (reports.alert_statistics(a, AS_OF, 24 * 30), reports.alert_statistics(alerts, AS_OF, 24 * 30)),
        (reports.prediction_statistics(p, AS_OF, 30), reports.prediction_statistics(predictions, AS_OF, 30)),
        (database.field_summary(p, AS_OF, 30), reports.field_summary(predictions, AS_OF, 30)),
        (database.field_statistics(p), reports.field_statistics(predictions)),
        (database.alert_indicators(a), reports.alert_indicators(alerts)),
        (reports.counts(a, "severity"), reports.counts(alerts, "severity")),
    ):
        assert grouped(mine), plan(mine)
        assert values(mine) == values(want)


def test_filters_and_columns_are_pushed(base):
    _, alerts, _, a, _ = base
    mine = reports.active(a, AS_OF, 5).select("id")
    shown = plan(mine)
    assert "status = 'ACTIVE'" in shown and "alert_timestamp >= " in shown and "message" not in shown.rsplit("ReadSchema", 1)[1]
    assert [r["id"] for r in mine.collect()] == [r["id"] for r in reports.active(alerts, AS_OF, 5).collect()]
    zone = alerts.where("zone_id IS NOT NULL").first()["zone_id"]
    kept = ("alert_timestamp", AS_OF, 30, "zone_id", zone)
    assert values(reports.history(a, *kept).select("id")) == values(reports.history(alerts, *kept).select("id"))


def test_key_ranges_read_each_row_once(spark, base):
    url, alerts, *_ = base
    found = readers.jdbc_table(spark, url, "alerts", key='"id"', low=0, high=1000, parts=3, driver=DERBY)
    assert found.rdd.getNumPartitions() == 3 and values(found.select("id")) == values(alerts.select("id"))


def test_changes_in_the_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    alerts = alert_table(spark, SF)
    database.create(alerts, url, "alerts", driver=DERBY)
    changes = alerts.where("id % 10 = 0").select("id", F.lit("RESOLVED").alias("status")).union(spark.createDataFrame([(-1, "IGNORED")], "id long, status string"))
    want = reports.with_status(alerts, changes.withColumnRenamed("status", "new_status"))
    for _ in range(2):  # a second try finds the same rows
        assert database.change_status(changes, url, "alerts", "a", driver=DERBY) == alerts.where("id % 10 = 0").count()
    there = lambda: readers.jdbc_table(spark, url, "alerts", driver=DERBY).select("id", "status")
    assert values(there()) == values(want.select("id", "status"))
    gone = reports.retained(want, AS_OF, 14, gone=True).count()
    assert gone > 0 and database.remove_closed(spark, url, "alerts", AS_OF, 14, driver=DERBY) == gone
    assert values(there()) == values(reports.retained(want, AS_OF, 14).select("id", "status"))
    assert database.change_status(changes.limit(0), url, "alerts", "b", driver=DERBY) == 0
    with pytest.raises(Exception, match="NO_TABLE"):
        sinks.transaction(spark, url, ['DELETE FROM alerts', "DELETE FROM no_table"], driver=DERBY)
    assert there().count() == alerts.count() - gone
