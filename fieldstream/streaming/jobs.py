"""Streaming jobs: a source, the batch operators' functions, a sink and a checkpoint.

Every job runs on its production trigger by default, and on `NOW` in tests and
queries, where it must give what the batch functions give. Sinks are idempotent
by batch: a replayed micro-batch replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import utc
from ..operators import bronze, cache_rules, gold, ml, panes, silver
from ..schemas import LATEST
from ..sources import readers, sinks
from ..sources.stored import Stored
from . import state

#: Trigger intervals in production; the others start a batch as soon as there is data.
TRIGGERS = {"bronze": {"processingTime": "30 seconds"}, "satellite": {"processingTime": "60 seconds"}, "silver": {"processingTime": "60 seconds"}, "alerts": {"processingTime": "30 seconds"}, "features": {"processingTime": "600 seconds"}}
NOW = {"availableNow": True}

Sink = Callable[[DataFrame, int], None]


def _trigger(kind: str, trigger: dict | None) -> dict:
    return trigger or TRIGGERS.get(kind, {"processingTime": "0 seconds"})


def _started(rows: DataFrame, write: Sink, checkpoint: str, kind: str, trigger: dict | None) -> StreamingQuery:
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_trigger(kind, trigger)).start()


def file_table(path: str, keys: tuple[str, ...] = ()) -> Sink:
    return lambda batch, batch_id: sinks.replace_batch(batch, batch_id, path, keys)


def stored_table(table: Stored) -> Sink:
    """A sink of a table with a manifest: a replayed batch is left as it is, also after its files have been compacted."""
    return lambda batch, batch_id: table.append(batch, batch_id) and None


def file_broker(path: str, topic: str) -> Sink:
    """A sink that gives messages (value) the other columns of an envelope, as a broker does, and writes them as files."""

    def publish(messages: DataFrame, batch_id: int) -> None:
        place = {"topic": F.lit(topic), "partition": F.spark_partition_id(), "offset": F.monotonically_increasing_id(), "timestamp": F.current_timestamp()}
        sinks.publish_batch(messages.select(F.col("value").cast("binary").alias("value")).withColumns(place), batch_id, path)

    return publish


def bronze_job(messages: DataFrame, decode: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None, keys: tuple[str, ...] | None = None, gather: int | None = None) -> StreamingQuery:
    """Messages to raw-layer JSON, partitioned by hour or by other keys (a backfill of many days by day).

    gather is for backfills: a folder's rows of a batch meet in so many tasks at
    most, so that files do not multiply by the batch's tasks. A folder larger than
    a partition should be, as that of messages without time, is split by its size.
    """
    rows = decode(messages)
    if gather:
        piece = F.pmod(F.col("kafka_offset"), F.lit(gather))
        rows = rows.withColumn("_piece", piece).hint("rebalance", *map(F.col, (*(keys or sinks.PARTITIONS["bronze"]), "_piece"))).drop("_piece")
    return sinks.file_stream(rows, path, checkpoint, "bronze", "json", _trigger("bronze", trigger), keys).start()


def image_job(messages: DataFrame, path: str, images: str, checkpoint: str, trigger: dict | None = None, keys: tuple[str, ...] = sinks.PARTITIONS["bronze"]) -> StreamingQuery:
    """Satellite messages to image objects (a table of names and bytes) and raw-layer JSON of all but the bytes."""

    def objects(batch: DataFrame, batch_id: int) -> None:
        sinks.replace_batch(batch.select("image_path", "local_timestamp", "kafka_offset", "image"), batch_id, images)

    def metadata(batch: DataFrame, batch_id: int) -> None:
        sinks.replace_batch(batch.drop("image", "raw_value"), batch_id, path, keys, "json")

    return _started(bronze.satellite(messages), sinks.fan_out(objects, metadata), checkpoint, "satellite", trigger)


def silver_job(rows: DataFrame, refine: Callable[[DataFrame], DataFrame], members: tuple[str, ...], layer: str, path: str | Sink, checkpoint: str, publish: Sink | None = None, trigger: dict | None = None, minutes: tuple[str, panes.Shape] | None = None) -> StreamingQuery:
    """Raw rows to validated files in the layer's partitions (or another table), to messages, and to a table of panes by minute; each micro-batch is computed once for all."""

    def topic(batch: DataFrame, batch_id: int) -> None:
        if publish is not None:
            publish(batch.select(silver.message(members)), batch_id)

    def by_minute(batch: DataFrame, batch_id: int) -> None:
        if minutes is not None:
            found = panes.panes(batch.withColumn("timestamp_parsed", utc("timestamp_parsed")), minutes[1])
            sinks.replace_batch(found, batch_id, minutes[0], ("date",))

    return _started(refine(rows), sinks.fan_out(path if callable(path) else file_table(path, sinks.PARTITIONS[layer]), topic, by_minute), checkpoint, "silver", trigger)


def alert_job(valid: DataFrame, raise_alerts: Callable[[DataFrame], DataFrame], table: Sink, checkpoint: str, publish: Sink | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Validated rows to the alert table and the alert topic."""

    def rows(batch: DataFrame, batch_id: int) -> None:
        table(sinks.alert_rows(batch), batch_id)

    def topic(batch: DataFrame, batch_id: int) -> None:
        if publish is not None:
            publish(sinks.as_messages(batch, "alerts-anomalies", "zone_id"), batch_id)

    return _started(raise_alerts(valid), sinks.fan_out(rows, topic), checkpoint, "alerts", trigger)


def prediction_job(features: DataFrame, scorer: Callable[[], ml.Scorer], table: Sink, checkpoint: str, publish: Sink | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Feature rows to the prediction table (with feature documents) and anomalies to their topic.

    scorer is asked for each batch, so that a newly trained model takes effect.
    """

    def rows(batch: DataFrame, batch_id: int) -> None:
        table(batch.withColumn("features", ml.features_document()), batch_id)

    def topic(batch: DataFrame, batch_id: int) -> None:
        if publish is not None:
            publish(batch.where("is_anomaly").select(ml.anomaly_message().alias("value")), batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.fan_out(rows, topic)(ml.scored(batch, scorer(), F.col("processing_timestamp")), batch_id)

    return _started(features, write, checkpoint, "predictions", trigger)


def newest_scorer(spark: SparkSession, root: str) -> Callable[[], ml.Scorer]:
    """The scorer of the registry's newest version, loaded anew only when the version has changed."""
    held: dict[str, ml.Scorer] = {}

    def current() -> ml.Scorer:
        version = sinks.newest_version(spark, root)
        if version not in held:
            model, _ = sinks.load_latest_model(spark, root)
            held.clear()
            held[version] = ml.Scorer.of(model, version)
        return held[version]

    return current


def gold_job(valid: DataFrame, keys: tuple[str, ...], aggregates: list, path: str, checkpoint: str, minutes: int = 10, late: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Event-time windows of validated rows, each written once the watermark has passed it."""
    rows = gold.windowed(valid, keys, aggregates, minutes, late)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**_trigger("gold", trigger)).start()


def clock(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A stream of times, whose micro-batches tell a periodic job when it is; a replayed batch has the same times."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select("timestamp")


def feature_job(times: DataFrame, features: Callable[[str], DataFrame], path: str, checkpoint: str, publish: Sink | None = None, trigger: dict | None = None) -> StreamingQuery:
    """The feature table at each tick of a clock: the newest time of a batch is the as_of of one run over the tables as they are.

    `features` gives the table for a time, as zoneless UTC text. Its rows go to the
    topic and to the snapshot of that time, which a replayed batch replaces. Every
    tick has a snapshot of its own; the newest is read by feature_snapshot.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        as_of = batch.agg(F.date_format(utc(F.max("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
        if as_of is None:
            return

        def snapshot(rows: DataFrame, _: int) -> None:
            sinks.replace_snapshot(rows, as_of, path)

        def topic(rows: DataFrame, batch_id: int) -> None:
            if publish is not None:
                publish(rows.select(F.to_json(F.struct("*")).alias("value")), batch_id)

        sinks.fan_out(snapshot, topic)(features(as_of), batch_id)

    return _started(times, run, checkpoint, "features", trigger)


def feature_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of a feature_job; only its files are read."""
    rows = spark.read.parquet(path)
    newest = sinks.newest_partition(spark, path, "as_of")
    return rows.where(F.col("as_of") == F.lit(newest)).drop("as_of")


# ---- latest values ------------------------------------------------------------------


def latest_job(messages: DataFrame, kind: str, checkpoint: str, rejects: Sink | None = None, changed: Sink | None = None, trigger: dict | None = None, ttl: int | None = None) -> StreamingQuery:
    """Messages of a kind's topic to the latest value of each key, held in the stream's state until its time to live is over.

    A batch's refused messages go to `rejects` with their reasons, and the changes
    of its valid ones to `changed`, before the batch counts as done. Values are read
    from the state by latest_table. A stream with times to live always has a next
    batch, so NOW takes all messages as one.
    """
    _, own_ttl = LATEST[kind]
    rows = state.reduced(cache_rules.checked(messages, kind))
    refused = cache_rules.with_reasons(rows.where("NOT valid").drop("valid"), kind)
    kept = state.changes(rows.where("valid"), own_ttl if ttl is None else ttl)
    both = kept.withColumns({"failed": F.lit(0).cast("long"), "reasons": F.array().cast("array<string>")}).unionByName(refused)

    def split(batch: DataFrame, batch_id: int) -> None:
        if changed is not None:
            changed(batch.where("failed = 0").drop("failed", "reasons"), batch_id)
        if rejects is not None:
            rejects(batch.where("failed <> 0"), batch_id)

    spark = messages.sparkSession
    before = {k: spark.conf.get(k, None) for k in state.ROCKSDB}
    for k, v in state.ROCKSDB.items():  # a query keeps the settings with which it starts
        spark.conf.set(k, v)
    try:
        writer = both.writeStream.outputMode("update").foreachBatch(sinks.fan_out(split)).option("checkpointLocation", checkpoint)
        return writer.trigger(**({"once": True} if trigger == NOW else _trigger("latest", trigger))).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_table(spark: SparkSession, checkpoint: str, kind: str, ttl: int | None = None, as_of: Column | None = None) -> DataFrame:
    """The values that a latest_job holds, with cache_ttl; with as_of, only those whose message is not older than the time to live at that time."""
    _, own_ttl = LATEST[kind]
    seconds = own_ttl if ttl is None else ttl
    rows = state.held(spark, checkpoint)
    if as_of is not None:
        rows = rows.where(F.col("message_time") >= as_of - F.make_interval(secs=F.lit(seconds)))
    return rows.withColumn("cache_ttl", F.lit(seconds))


# ---- streams of tables ----------------------------------------------------------------


#: Messages of a file that spread gives, in bytes.
FILE_BYTES = 32 << 20


def n_files(spark: SparkSession, n_bytes: int) -> int:
    """Files for so many bytes of messages: none holds much more than FILE_BYTES, all cores have work, and small tables still give four."""
    return max(4, min(2 * spark.sparkContext.defaultParallelism, n_bytes >> 20), -(-n_bytes // FILE_BYTES))


def spread(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt evenly to partitions, and their number: that of files for the bytes of their messages (of rows without `value`: 256 bytes each)."""
    size = F.octet_length("value") if "value" in rows.columns else F.lit(256)
    n_bytes = rows.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    n = n_files(rows.sparkSession, n_bytes)
    return rows.repartition(n), n


def stream_of(spark: SparkSession, rows: DataFrame, name: str, batches: int | None = 2, dealt: int | None = None) -> tuple[DataFrame, str]:
    """Rows written as files and read back as a stream of so many micro-batches (None: of one), and the root of their folder.

    Rows that are dealt evenly to so many partitions already are written as they
    are; others are made once for their size and once more to be dealt.
    """
    root = sinks.work_dir(spark, name)
    rows, n = spread(rows) if dealt is None else (rows, dealt)
    rows.write.parquet(f"{root}/in")
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", -(-n // batches)) if batches else reader).parquet(f"{root}/in"), root


def drained(query: StreamingQuery) -> None:
    """Wait for an availableNow job; its failure is raised here."""
    query.awaitTermination()
