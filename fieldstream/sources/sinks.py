"""Writers: partitioned files, messages, databases, objects, models.

Batch writers that a stream calls for each micro-batch are idempotent by batch:
a replayed batch replaces what it wrote before.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# Partition columns of the layers.
PARTITIONS = {"bronze": ("year", "month", "day", "hour"), "sensor": ("date", "field_id"), "weather": ("date", "location"), "satellite": ("date",), "gold": ("window_end",)}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; a local one only where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fieldstream-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def file_stream(rows: DataFrame, path: str, checkpoint: str, layer: str, fmt: str = "parquet", trigger: dict | None = None, keys: tuple[str, ...] | None = None) -> DataStreamWriter:
    """Append a stream to partitioned files, by default with all that is there and then stop; keys replace the layer's partition columns."""
    writer = rows.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).partitionBy(*(keys or PARTITIONS[layer]))
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True}))


def write_files(rows: DataFrame, path: str, layer: str, fmt: str = "parquet", per_file: int = 1_000_000) -> None:
    """Append partitioned files: small partition values share a task and large ones are split by size, so that files are few and no task holds a whole day."""
    keys = PARTITIONS[layer]
    rows.hint("rebalance", *map(F.col, keys)).write.format(fmt).partitionBy(*keys).option("maxRecordsPerFile", per_file).mode("append").save(path)


def compact(spark: SparkSession, source: str, target: str, layer: str, fmt: str = "parquet") -> None:
    """Rewrite a folder of many small files as few."""
    write_files(spark.read.format(fmt).load(source).drop("batch_id"), target, layer, fmt)


def as_messages(rows: DataFrame, topic: str, key: str | None = None) -> DataFrame:
    """Rows as JSON messages of a topic."""
    value = F.to_json(F.struct("*")).cast("binary").alias("value")
    return rows.select(*([F.col(key).cast("binary").alias("key")] if key else []), value, F.lit(topic).alias("topic"))


def publish(messages: DataFrame, fmt: str = "kafka", path: str | None = None, **options: str) -> None:
    """Append messages to a broker, or to files with the same columns."""
    writer = messages.write.format(fmt).options(**options).mode("append")
    writer.save(path) if path else writer.save()


def publish_batch(messages: DataFrame, batch_id: int, path: str, fmt: str = "parquet") -> None:
    """Messages of a micro-batch as files; a replay replaces them."""
    messages.write.format(fmt).mode("overwrite").save(f"{path}/batch_id={batch_id}")


def write_jdbc(rows: DataFrame, url: str, name: str, **properties: str) -> None:
    rows.write.jdbc(url, name, mode="append", properties=properties)


def transaction(spark: SparkSession, url: str, statements: list[str], **properties: str) -> list[int]:
    """Run statements on the driver as one transaction: all of them take effect, or none; returns the rows that each touched."""
    jvm = spark._jvm
    if "driver" in properties:
        jvm.java.lang.Class.forName(properties["driver"])
    settings = jvm.java.util.Properties()
    for k, v in properties.items():
        settings.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            touched = [statement.executeUpdate(text) for text in statements]
            connection.commit()
            return touched
        except Exception:
            connection.rollback()
            raise
    finally:
        connection.close()


def insert_batch(rows: DataFrame, batch_id: int, url: str, name: str, **properties: str) -> None:
    """Put a micro-batch into a database table that has its columns and batch_id, exactly once.

    Tasks write a staging table of the batch, which a second try makes anew; then one
    transaction on the driver moves its rows, in place of any that the batch has
    there. A failure before the commit leaves the table as it was, a replay after
    it gives the same rows again. Null keys and equal rows need no care.
    """
    columns = [*(f'"{c}"' for c in rows.columns), '"batch_id"']
    staging = f"{name}_batch_{batch_id}"
    rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.jdbc(url, staging, mode="overwrite", properties=properties)
    own = ", ".join(columns)
    move = [f'DELETE FROM {name} WHERE "batch_id" = {batch_id}', f"INSERT INTO {name} ({own}) SELECT {own} FROM {staging}", f"DROP TABLE {staging}"]
    transaction(rows.sparkSession, url, move, **properties)


def alert_rows(rows: DataFrame) -> DataFrame:
    """Alerts for the table, ACTIVE where no status is given."""
    return rows.withColumn("status", F.coalesce("status", F.lit("ACTIVE")))


def replace_batch(rows: DataFrame, batch_id: int, path: str, keys: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Write a micro-batch as the partition batch_id of a table, with further partition columns within; a replay replaces all of it."""
    spread = rows.hint("rebalance", *map(F.col, keys)) if keys else rows
    spread.write.format(fmt).partitionBy(*keys).mode("overwrite").save(f"{path}/batch_id={batch_id}")


def replace_snapshot(rows: DataFrame, as_of: str, path: str, fmt: str = "parquet") -> None:
    """Write rows as the snapshot of a time (as_of=...) of a table; a rerun for that time replaces it, others stay."""
    rows.write.format(fmt).mode("overwrite").save(f"{path}/as_of={re.sub('[: ]', '_', as_of)}")


def newest_partition(spark: SparkSession, path: str, column: str, committed: bool = True) -> str | None:
    """The largest value of a table's top partition folders (text), from their names alone; folders without a committed write count only where asked for."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    names = [f.rpartition("/")[2].partition("=")[2] for f in found if f.rpartition("/")[2].startswith(f"{column}=") and (not committed or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS")))]
    return max(names, default=None)


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that computes a batch once and gives it to several sinks; a failure fails the batch."""

    def run(rows: DataFrame, batch_id: int) -> None:
        kept = rows.persist()
        try:
            for sink in sinks:
                sink(kept, batch_id)
        finally:
            kept.unpersist()

    return run


def newest(rows: DataFrame, order: str) -> DataFrame:
    """The row of largest `order`, by partial aggregation rather than a sort."""
    return rows.agg(F.max_by(F.struct(*rows.columns), order).alias("row")).where("row IS NOT NULL").select("row.*")


def save_model(model: PipelineModel, root: str, version: str, record: DataFrame) -> None:
    """Save a model under its version and append its registry row, which is what moves `latest`."""
    model.write().overwrite().save(f"{root}/models/{version}")
    record.write.mode("append").parquet(f"{root}/registry")


def save_metrics(rows: DataFrame, path: str, evaluated_at: str, metadata: Column) -> None:
    """Append metrics (model_version, metric_name, metric_value) with the time of their evaluation and metadata as JSON text."""
    stamped = rows.select("model_version", "metric_name", F.col("metric_value").cast("double").alias("metric_value"), F.lit(evaluated_at).cast("timestamp_ntz").alias("evaluated_at"), metadata.alias("metadata"))
    stamped.write.mode("append").parquet(path)


def newest_version(spark: SparkSession, root: str) -> str:
    return newest(spark.read.parquet(f"{root}/registry").select("model_version", F.struct("updated_at", "model_version").alias("order")), "order").first()["model_version"]


def load_latest_model(spark: SparkSession, root: str) -> tuple[PipelineModel, str]:
    version = newest_version(spark, root)
    return PipelineModel.load(f"{root}/models/{version}"), version
