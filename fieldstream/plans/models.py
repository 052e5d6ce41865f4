"""Queries of the anomaly model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml
from ..schemas import CORE_FEATURES
from ..sources import fixtures, readers, sinks
from ..streaming import jobs
from .layers import rounded
from .registry import AS_OF, query
from .tables import PREDICTIONS_CTE, SCORER, prediction_table

_START = "2024-01-20 00:00:00"
_FEATURES = fixtures.sql("features")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with a processing time."""
    return fixtures.features(spark, sf_dir).withColumn("processing_timestamp", F.col("prediction_ts"))


@query(f"WITH f AS ({_FEATURES}) SELECT CAST(prediction_ts AS DATE) AS window_end, count(*) AS n_rows FROM f WHERE CAST(prediction_ts AS DATE) >= DATE '2024-01-20' GROUP BY ALL")
def gold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day of a range, read from a table written with its partitions."""
    path = sinks.work_dir(spark, "gold")
    sinks.write_files(history(spark, sf_dir).withColumn("window_end", F.to_date("prediction_ts")), path, "gold")
    return readers.parquet_history(spark, path, start="2024-01-20").groupBy("window_end").agg(F.count("*").alias("n_rows"))


@query(f"WITH f AS ({_FEATURES}), n AS (SELECT count(*) FILTER (prediction_ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{AS_OF}') AS inside FROM f) SELECT id FROM f, n WHERE CASE WHEN inside >= 100 THEN prediction_ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{AS_OF}' ELSE true END")
def train_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.training_rows(history(spark, sf_dir), _START, AS_OF).select("id")


@query(f"WITH f AS ({_FEATURES}) SELECT id FROM f")
def train_set_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range without rows falls back to the whole history."""
    return ml.training_rows(history(spark, sf_dir), "2030-01-01 00:00:00", "2030-01-02 00:00:00").select("id")


@query(f"WITH f AS ({_FEATURES}) SELECT count(*) AS record_count, min(prediction_ts) AS start_time, max(prediction_ts) AS end_time FROM f")
def train_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.train_range(history(spark, sf_dir))


@query(f"WITH f AS ({_FEATURES}), m AS (SELECT quantile_disc(weather_avg_uv_index, 0.5) AS middle FROM f) SELECT id, coalesce(weather_avg_uv_index, middle) AS weather_avg_uv_index FROM f, m")
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null features filled by medians; an accuracy above the number of rows makes them exact here."""
    return ml.filled(fixtures.features(spark, sf_dir), ("weather_avg_uv_index",), error=1e-6).select("id", "weather_avg_uv_index")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in CORE_FEATURES) + ") v(feature, near_middle)")
def median_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians from sketches by day, merged: the rows below each, of those with a value, are a half, but for a hundredth and the rows of equal value."""
    rows = fixtures.features(spark, sf_dir)
    middle = ml.sketched_medians(ml.sketches(rows, F.to_date("prediction_ts"))).first()
    shares = [(F.count_if(c) / F.count(name)).alias(f"{name}{end}") for name in CORE_FEATURES for c, end in ((F.col(name) < middle[name], "_below"), (F.col(name) <= middle[name], "_upto"))]
    found = rows.agg(*shares)
    ok = [F.struct(F.lit(c).alias("feature"), ((F.col(f"{c}_below") < 0.51) & (F.col(f"{c}_upto") > 0.49)).alias("near_middle")) for c in CORE_FEATURES]
    return found.select(F.explode(F.array(*ok)).alias("r")).select("r.*")


@query(f"WITH f AS ({_FEATURES}) SELECT '{SCORER.version}' AS model_version, m.name AS metric_name, CASE m.name WHEN 'record_count' THEN count(*)::DOUBLE WHEN 'training_cost' THEN 2500e0 ELSE round(sqrt(2500e0 / count(*)), 4) END AS metric_value, TIMESTAMP '{AS_OF}' AS evaluated_at, '{{\"k\":3,\"maxIter\":20,\"seed\":42}}' AS metadata FROM f, (VALUES ('training_cost'), ('avg_distance'), ('record_count')) m(name) GROUP BY m.name")
def ml_metrics_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a model whose training cost was 2500, appended to their table and read back."""
    path = sinks.work_dir(spark, "metrics")
    cost = F.lit(2500.0)
    metrics = ml.train_range(history(spark, sf_dir)).select(F.lit(SCORER.version).alias("model_version"), cost.alias("training_cost"), F.sqrt(cost / F.col("record_count")).alias("avg_distance"), F.col("record_count").cast("double").alias("record_count"))
    config = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in ml.KMEANS.items()]))
    sinks.save_metrics(ml.metric_rows(metrics, ("training_cost", "avg_distance", "record_count")), path, AS_OF, config)
    return rounded(spark.read.parquet(path))


_STANDARD = ", ".join(f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 4) ELSE 0 END AS scaled_{c}" for c in CORE_FEATURES)


@query(f"WITH f AS ({_FEATURES}), c AS (SELECT * FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CORE_FEATURES)}) SELECT id, {_STANDARD} FROM c")
def feature_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ml.vector_columns(ml.scaled(fixtures.features(spark, sf_dir))).select("id", *[f"scaled_{c}" for c in CORE_FEATURES]))


@query(f"WITH {PREDICTIONS_CTE} SELECT id, cluster, round(anomaly_score, 4) AS anomaly_score FROM predictions")
def kmeans_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prediction_table(spark, sf_dir).select("id", "cluster", "anomaly_score"))


@query(f"WITH {PREDICTIONS_CTE} SELECT id, is_anomaly, severity FROM predictions")
def severity_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_table(spark, sf_dir).select("id", "is_anomaly", "severity")


@query(f"WITH {PREDICTIONS_CTE} SELECT id, recommendations FROM predictions")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_table(spark, sf_dir).select("id", "recommendations")


@query(f"WITH f AS ({_FEATURES}) SELECT id, 0e0 AS anomaly_score, false AS is_anomaly, 'LOW' AS severity, 'Model not available - check training status' AS recommendations, 'none' AS model_version FROM f")
def score_no_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.scored_without_model(fixtures.features(spark, sf_dir), F.col("prediction_ts"))
    return rows.select("id", "anomaly_score", "is_anomaly", "severity", "recommendations", "model_version")


_DOCUMENT = {"sensor_avg_temperature": "temperature", "sensor_avg_humidity": "humidity", "sensor_avg_soil_ph": "soil_ph"}


@query(f"WITH f AS ({_FEATURES}) SELECT id, '{{' || " + " || ',' || ".join(f"""'"{_DOCUMENT.get(c, c)}":' || coalesce(CAST({c} AS VARCHAR), 'null')""" for c in CORE_FEATURES) + " || '}' AS features FROM f")
def prediction_features_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("id", ml.features_document().alias("features"))


@query(
    f"""WITH {PREDICTIONS_CTE} SELECT id, '{{"field_id":"' || field_id || '","location":"' || location || '","is_anomaly":true,"severity":"' || severity || '","recommendations":"' || recommendations || '","model_version":"' || model_version || '","features":{{"temperature":' || CAST(sensor_avg_temperature AS VARCHAR) || ',"humidity":' || CAST(sensor_avg_humidity AS VARCHAR) || ',"soil_ph":' || CAST(sensor_avg_soil_ph AS VARCHAR) || ',"temp_differential":' || CAST(temp_differential AS VARCHAR) || ',"humidity_differential":' || CAST(humidity_differential AS VARCHAR) || '}}}}' AS value FROM predictions WHERE is_anomaly"""
)
def anomaly_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of anomalies; score and time are left out, as engines print them differently."""
    rows = prediction_table(spark, sf_dir).where("is_anomaly").withColumns({"anomaly_score": F.lit(None).cast("double"), "prediction_timestamp": F.lit(None).cast("timestamp")})
    return rows.select("id", ml.anomaly_message().alias("value"))


@query()
def ml_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a model trained on the feature rows, saved, and loaded by the registry's newest version."""
    root = sinks.work_dir(spark, "models")
    rows = fixtures.features(spark, sf_dir)
    for version, updated in (("v2024-01-21_02-00", "2024-01-21 02:00:00"), (SCORER.version, "2024-01-28 02:00:00")):
        filled = ml.filled(rows, middle=ml.sketched_medians(ml.sketches(rows, F.to_date("prediction_ts"))))
        model = ml.train(filled)
        sinks.save_model(model, root, version, ml.model_record(history(spark, sf_dir), version, updated, 30, ml.training_cost(model, filled)))
    return ml.scored(rows, jobs.newest_scorer(spark, root)(), F.col("prediction_ts")).select("id", "cluster", "anomaly_score", "is_anomaly", "severity", "model_version")


@query(f"WITH f AS ({_FEATURES}) SELECT count(*) AS n_rows, 0::BIGINT AS n_not_nearest, true AS cost_agrees, 3::BIGINT AS n_centres_at_means FROM f")
def ml_train_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trained model must hold: each row is at its nearest centre, the saved cost is the sum of squared distances that the scorer finds, and not above that before the centres' last move, and centres are the means of their rows, within the tolerance at which training stops."""
    rows = fixtures.features(spark, sf_dir)
    filled = ml.filled(rows, middle=ml.sketched_medians(ml.sketches(rows, F.to_date("prediction_ts"))))
    model = ml.train(filled)
    scorer, cost, before = ml.Scorer.of(model, SCORER.version), ml.training_cost(model, filled), float(model.stages[2].summary.trainingCost)
    given = model.transform(filled.withColumns({c: F.col(c).cast("double") for c in CORE_FEATURES})).select("id", F.col("cluster").alias("given"))
    found = ml.scored(filled, scorer, F.col("prediction_ts")).withColumn("scaled", ml.standardized(scorer)).join(given, "id")
    means = [F.avg(F.col("scaled")[i]).alias(f"m{i}") for i in range(len(CORE_FEATURES))]
    by_centre = found.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("given") != F.col("cluster")).alias("wrong"), F.sum(F.pow("anomaly_score", F.lit(2))).alias("squares"), *means)
    centre = F.array(*[F.array(*map(F.lit, c)) for c in scorer.centroids])[F.col("cluster")]
    apart = F.greatest(*[F.abs(F.col(f"m{i}") - centre[i]) for i in range(len(CORE_FEATURES))])
    return by_centre.agg(F.sum("n").alias("n_rows"), F.sum("wrong").alias("n_not_nearest"), ((F.abs(F.sum("squares") / cost - 1) < 1e-6) & F.lit(cost < before * (1 + 1e-6))).alias("cost_agrees"), F.count_if(apart < 0.05).alias("n_centres_at_means"))


@query(f"WITH f AS ({_FEATURES}) SELECT '{SCORER.version}' AS model_version, count(*) AS record_count, 30 AS days_of_data, min(prediction_ts) AS start_time, max(prediction_ts) AS end_time, 10 AS n_features, 3 AS k, 42 AS seed, round(sqrt(2500e0 / count(*)), 4) AS avg_distance FROM f")
def model_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry row of a model whose training cost was 2500."""
    row = ml.model_record(history(spark, sf_dir), SCORER.version, AS_OF, 30, 2500.0)
    return rounded(
        row.select("model_version", "record_count", "days_of_data", F.col("actual_date_range.start").alias("start_time"), F.col("actual_date_range.end").alias("end_time"), F.size("features").alias("n_features"), "model_config.k", "model_config.seed", "training_metrics.avg_distance")
    )


@query()
def ml_train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and mean distance of a trained model, in name and value form."""
    filled = ml.filled(fixtures.features(spark, sf_dir))
    model = ml.train(filled)
    cost = ml.training_cost(model, filled)
    metrics = ml.train_range(history(spark, sf_dir)).select(F.lit(SCORER.version).alias("model_version"), F.lit(cost).alias("training_cost"), F.sqrt(F.lit(cost) / F.col("record_count")).alias("avg_distance"), F.col("record_count").cast("double").alias("record_count"))
    return ml.metric_rows(metrics, ("training_cost", "avg_distance", "record_count"))


@query(f"WITH f AS ({_FEATURES}) SELECT 'v' || strftime(CAST(max(prediction_ts) AS DATE), '%Y-%m-%d') AS model_version, CAST(max(prediction_ts) AS DATE) AS updated_at FROM f")
def model_registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of one registry row a day."""
    day = F.to_date("prediction_ts")
    registry = history(spark, sf_dir).select(F.concat(F.lit("v"), F.date_format(day, "yyyy-MM-dd")).alias("model_version"), day.alias("updated_at")).distinct()
    return ml.latest_models(registry)
