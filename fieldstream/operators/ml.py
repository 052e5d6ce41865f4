"""Anomaly model: standardised features, KMeans, distance to the centroid, graded severity and texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CORE_FEATURES

# Model and severity parameters.
KMEANS = {"k": 3, "maxIter": 20, "seed": 42}
NO_MODEL_TEXT = "Model not available - check training status"
ANOMALY_DISTANCE, CRITICAL_DISTANCE, MEDIUM_SHARE, TEXT_SHARE = 1.0, 4.0, 0.5, 0.7


def medians(rows: DataFrame, columns: tuple[str, ...] = CORE_FEATURES, error: float = 0.01) -> DataFrame:
    """One row of approximate medians, 0 where a column has no value; one aggregation for all columns."""
    return rows.agg(*[F.coalesce(F.percentile_approx(c, 0.5, int(1 / error)), F.lit(0.0)).alias(c) for c in columns])


#: Accuracy of quantile sketches: a rank is off by less than a hundredth of the rows.
SKETCH_K = 400


def sketches(rows: DataFrame, day: Column, columns: tuple[str, ...] = CORE_FEATURES) -> DataFrame:
    """Quantile sketches of the columns by day (date, a sketch a column), of bounded size whatever the number of rows."""
    return rows.groupBy(day.alias("date")).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K)).alias(c) for c in columns])


def sketched_medians(days: DataFrame, columns: tuple[str, ...] = CORE_FEATURES) -> DataFrame:
    """One row of approximate medians of all days of sketches, 0 where a column has no value; no row of the days is read again."""
    whole = days.agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])
    known = lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(0.5)))
    return whole.select(*[F.coalesce(known(c), F.lit(0.0)).alias(c) for c in columns])


def filled(rows: DataFrame, columns: tuple[str, ...] = CORE_FEATURES, error: float = 0.01, middle: DataFrame | None = None) -> DataFrame:
    """Nulls of the columns replaced by their medians, or by the one row of `middle`."""
    middle = (medians(rows, columns, error) if middle is None else middle).select([F.col(c).alias(f"{c}__median") for c in columns])
    joined = rows.join(F.broadcast(middle))  # one row
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), f"{c}__median") for c in columns}).drop(*[f"{c}__median" for c in columns])


def training_rows(history: DataFrame, start: str, end: str, least: int = 100, time: str = "processing_timestamp") -> DataFrame:
    """Rows of the range if it has `least` of them, else the whole history.

    The range is looked at first, until `least` rows are found, so that its
    condition is a plain one, which reaches the scan.
    """
    inside = history.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return inside if inside.select(time).limit(least).count() >= least else history


def train_range(history: DataFrame, time: str = "processing_timestamp") -> DataFrame:
    return history.agg(F.count("*").alias("record_count"), F.min(time).alias("start_time"), F.max(time).alias("end_time"))


def _scaling() -> list:
    return [
        VectorAssembler(inputCols=list(CORE_FEATURES), outputCol="features_vec", handleInvalid="skip"),
        StandardScaler(inputCol="features_vec", outputCol="scaled_features", withMean=True, withStd=True),
    ]


def _doubles(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in CORE_FEATURES})


def scaled(rows: DataFrame) -> DataFrame:
    """Rows without nulls with their standardised features as a vector."""
    doubles = _doubles(rows)
    return Pipeline(stages=_scaling()).fit(doubles).transform(doubles)


def train(rows: DataFrame) -> PipelineModel:
    """Fit scaler and KMeans on the ten features; rows with a null are skipped."""
    return Pipeline(stages=[*_scaling(), KMeans(featuresCol="scaled_features", predictionCol="cluster", **KMEANS)]).fit(_doubles(rows).select(*CORE_FEATURES))


def training_cost(model: PipelineModel, rows: DataFrame) -> float:
    """The sum of squared distances of the rows, scaled by the model, to its centres.

    The summary of KMeans has it for the centres before their last move, so it is
    no cost of the model that is saved.
    """
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.stages[2].clusterCenters()])
    squares = F.zip_with(vector_to_array("scaled_features"), centres[F.col("cluster")], lambda a, b: (a - b) * (a - b))
    found = model.transform(_doubles(rows).select(*CORE_FEATURES)).agg(F.sum(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("cost"))
    return found.first()["cost"]


def model_record(history: DataFrame, version: str, updated_at: str, days_of_data: int, cost: float, time: str = "processing_timestamp") -> DataFrame:
    """The registry row of a model: version, training time, features, rows and range of its data, parameters and metrics."""
    return train_range(history, time).select(
        F.lit(version).alias("model_version"),
        F.lit(updated_at).cast("timestamp_ntz").alias("updated_at"),
        F.array(*map(F.lit, CORE_FEATURES)).alias("features"),
        "record_count",
        F.lit(days_of_data).alias("days_of_data"),
        F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end")).alias("actual_date_range"),
        F.struct(*[F.lit(v).alias(k) for k, v in KMEANS.items()]).alias("model_config"),
        F.struct(F.when(F.col("record_count") > 0, F.sqrt(F.lit(cost) / F.col("record_count"))).otherwise(0.0).alias("avg_distance")).alias("training_metrics"),
    )


@dataclass(frozen=True)
class Scorer:
    """A scaler and centroids as plain numbers: fixed size, whatever they were trained on."""

    mean: tuple[float, ...]
    std: tuple[float, ...]
    centroids: tuple[tuple[float, ...], ...]
    version: str

    @classmethod
    def of(cls, model: PipelineModel, version: str) -> Scorer:
        scaler, kmeans = model.stages[1], model.stages[2]
        return cls(tuple(map(float, scaler.mean)), tuple(map(float, scaler.std)), tuple(tuple(map(float, c)) for c in kmeans.clusterCenters()), version)


def standardized(scorer: Scorer) -> Column:
    """The scaled features as an array; a feature without variance is 0."""
    return F.array(*[(F.col(c).cast("double") - m) / s if s else F.lit(0.0) for c, m, s in zip(CORE_FEATURES, scorer.mean, scorer.std, strict=True)])


def _distance(scaled: Column, centroid: tuple[float, ...]) -> Column:
    squares = F.zip_with(scaled, F.array(*map(F.lit, centroid)), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def severity(distance: Column) -> Column:
    return F.when(distance > CRITICAL_DISTANCE, "CRITICAL").when(distance > ANOMALY_DISTANCE, "HIGH").when(distance > ANOMALY_DISTANCE * MEDIUM_SHARE, "MEDIUM").otherwise("LOW")


# Recommendations by condition on the distance d and the features, in order; of each group the first that holds is said.
RECOMMENDATIONS = (
    (
        ("d > 4.0", "CRITICAL ANOMALY: Immediate intervention required - deviation from normal cluster"),
        ("d > 1.0", "WARNING: Significant deviation from normal patterns detected - enhanced monitoring recommended"),
        ("d > 0.7", "MEDIUM risk: Moderate deviation detected - increase monitoring frequency"),
        ("true", "LOW risk: Normal cluster behavior - continue routine monitoring"),
    ),
    (("t > 30", "High temperature detected: consider irrigation and shading"), ("t < 10", "Low temperature detected: protect crops from frost")),
    (("h > 85", "High humidity detected: fungal risk - improve ventilation"), ("h < 40", "Low humidity detected: increase irrigation")),
    (("ph < 6.0", "Acidic soil pH: consider liming"), ("ph > 7.5", "Alkaline soil pH: consider organic acidifiers")),
    (("abs(dt) > 10", "High temperature differential: verify sensor readings"),),
    (("abs(dh) > 20", "High humidity differential: check irrigation uniformity"),),
    (("rate > 0.1", "High sensor anomaly rate: verify sensor calibration and maintenance"),),
    (("t > 25 AND h > 80", "High temp + humidity: Ideal pathogen conditions - apply preventive measures"),),
    (("ph < 6 AND h > 70", "Acidic pH + high humidity: Risk of nutritional stress - consider fertilizers and drainage"),),
    (("uv > 8", "High UV index: Protect crops from sunburn - consider shading"),),
    (("uv < 3", "Low UV index: Reduced photosynthesis - monitor growth"),),
    (("wind > 30", "High wind speed: Risk of physical damage - secure structures"),),
    (("wind < 5", "Low wind speed: Poor air circulation - monitor for fungal diseases"),),
    (("uv > 7 AND wind > 20", "High UV + wind: Stress conditions - increase irrigation"),),
    (("h > 85 AND wind < 5", "High humidity + low wind: Fungal risk - improve ventilation"),),
)

#: Short names of the conditions and their columns.
SHORT = {"d": "anomaly_score", "t": "sensor_avg_temperature", "h": "sensor_avg_humidity", "ph": "sensor_avg_soil_ph", "dt": "temp_differential", "dh": "humidity_differential", "rate": "sensor_anomaly_rate", "uv": "weather_avg_uv_index", "wind": "weather_avg_wind_speed"}


def recommended_sql(names: dict[str, str] = SHORT) -> str:
    """The recommendations as one SQL expression over the named columns."""
    long = lambda c: re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[0]], c)
    groups = ["CASE " + " ".join(f"WHEN {long(c)} THEN '{text}'" for c, text in group) + " END" for group in RECOMMENDATIONS]
    return "concat_ws(' | ', " + ", ".join(groups) + ")"


def recommendations() -> Column:
    return F.expr(recommended_sql())


def scored(rows: DataFrame, scorer: Scorer, time: Column) -> DataFrame:
    """Nearest centroid, distance, grade, texts and stamps; rows with a null feature are left out."""
    scaled = rows.dropna(subset=list(CORE_FEATURES)).withColumn("scaled", standardized(scorer))
    distances = F.array(*[_distance(F.col("scaled"), c) for c in scorer.centroids])
    found = scaled.withColumn("distances", distances).withColumn("anomaly_score", F.array_min("distances"))
    found = found.withColumns({"cluster": (F.array_position("distances", F.col("anomaly_score")) - 1).cast("int"), "is_anomaly": F.col("anomaly_score") > ANOMALY_DISTANCE, "severity": severity(F.col("anomaly_score"))})
    return found.withColumns({"recommendations": recommendations(), "model_version": F.lit(scorer.version), "prediction_timestamp": time}).drop("scaled", "distances")


def scored_without_model(rows: DataFrame, time: Column) -> DataFrame:
    """Score 0 and severity LOW while no model exists."""
    return rows.withColumns(
        {"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False), "severity": F.lit("LOW"), "recommendations": F.lit(NO_MODEL_TEXT), "model_version": F.lit("none"), "prediction_timestamp": time}
    )


def anomaly_message() -> Column:
    """A prediction as the JSON of its topic."""
    members = F.struct(F.col("sensor_avg_temperature").alias("temperature"), F.col("sensor_avg_humidity").alias("humidity"), F.col("sensor_avg_soil_ph").alias("soil_ph"), "temp_differential", "humidity_differential")
    return F.to_json(F.struct("field_id", "location", "anomaly_score", "is_anomaly", "severity", "recommendations", "model_version", "prediction_timestamp", members.alias("features")))


def features_document() -> Column:
    """The feature document of the prediction table; nulls are kept."""
    names = {"sensor_avg_temperature": "temperature", "sensor_avg_humidity": "humidity", "sensor_avg_soil_ph": "soil_ph"}
    return F.to_json(F.struct(*[F.col(c).alias(names.get(c, c)) for c in CORE_FEATURES]), {"ignoreNullFields": "false"})


def metric_rows(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Metrics in name and value form, numbers only, by model version."""
    return metrics.unpivot("model_version", list(names), "metric_name", "metric_value").where(F.col("metric_value").isNotNull())


def latest_models(registry: DataFrame) -> DataFrame:
    """The registry row of the newest version."""
    return registry.agg(F.max_by(F.struct(*registry.columns), F.struct("updated_at", "model_version")).alias("row")).where("row IS NOT NULL").select("row.*")


def vector_columns(rows: DataFrame, column: str = "scaled_features") -> DataFrame:
    """An ML vector as one column a feature."""
    array = rows.withColumn("_array", vector_to_array(column))
    return array.select("*", *[F.get("_array", F.lit(i)).alias(f"scaled_{c}") for i, c in enumerate(CORE_FEATURES)]).drop("_array")
