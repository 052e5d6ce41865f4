"""Readers of tables, messages, files, databases and images, batch and streaming.

The message format is a parameter: `kafka` in production, and any file format
with the envelope's columns where there is no broker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENVELOPE


def table(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """A table, dealt to so many partitions where given: a compressed file of many rows is one or few tasks."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if parts is None else rows.repartition(parts)


def kafka_options(topic: str, servers: str | None, starting: str = "earliest", per_trigger: int | None = None) -> dict[str, str]:
    """starting: earliest or latest; per_trigger: messages a micro-batch at most. Data lost at the broker is tolerated."""
    options = {"subscribe": topic, "kafka.bootstrap.servers": servers, "startingOffsets": starting, "failOnDataLoss": "false"}
    return options | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def message_stream(spark: SparkSession, topic: str, fmt: str = "kafka", servers: str | None = None, path: str | None = None, starting: str = "earliest", per_trigger: int | None = None) -> DataFrame:
    """A stream of message envelopes of one topic; of a file format, whose batches are files, from any folder below path. Files are always read from the earliest: another `starting` is refused there."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return reader.options(**kafka_options(topic, servers, starting, per_trigger)).load()
    if starting != "earliest":
        raise ValueError(f"a stream of {fmt} files has no start at {starting!r}")
    reader = reader.schema(ENVELOPE).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path).where(F.col("topic") == topic)


def messages(spark: SparkSession, topic: str, fmt: str, path: str | None = None, servers: str | None = None) -> DataFrame:
    """All messages of a topic as a batch."""
    reader = spark.read.format(fmt)
    if fmt == "kafka":
        return reader.options(subscribe=topic).option("kafka.bootstrap.servers", servers).load()
    return reader.schema(ENVELOPE).option("recursiveFileLookup", "true").load(path).where(F.col("topic") == topic)


def json_stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """New raw-layer JSON files as a stream, of any partition folders below path."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)


def decoded(messages: DataFrame, schema: str, key: str = "field_id") -> DataFrame:
    """Rows of a message stream's JSON, without those that have no key, and their place (kafka_partition, kafka_offset).

    The JSON is read behind a generator: filters on its members would each read it anew.
    """
    d = F.from_json(F.col("value").cast("string"), schema)
    rows = messages.select(F.inline(F.array(d)), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"))
    return rows.where(F.col(key).isNotNull())


def parquet_history(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, partition: str = "window_end") -> DataFrame:
    """A partitioned table, its partitions pruned to a range where given."""
    rows = spark.read.parquet(root)
    if start is not None:
        rows = rows.where(F.col(partition) >= start)
    return rows if end is None else rows.where(F.col(partition) <= end)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **properties: str) -> DataFrame:
    """A database table; with a key range it is read in parallel parts."""
    if key is None:
        return spark.read.jdbc(url, name, properties=properties)
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def newest_image(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """The newest binary object below path: path, time, length and content; of the others only names and times are listed."""
    objects = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    files = objects.load(path)
    found = files.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    return files.limit(0) if found is None else spark.read.format("binaryFile").load(found)


def newest_stored_image(spark: SparkSession, path: str, time: str = "local_timestamp") -> DataFrame:
    """The same of a table of images (image_path, image and a time): the name is found first, then only its content is read."""
    images = spark.read.parquet(path)
    found = images.agg(F.max_by("image_path", F.struct(time, "kafka_offset"))).first()[0]
    return images.where(F.col("image_path") == F.lit(found))
