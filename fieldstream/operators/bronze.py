"""Raw layer: message envelopes to typed rows with message metadata and partition columns.

A message that is no JSON gives a row whose fields are null and whose `parse_ok`
is false; `rejects` keeps its text. A field of another type is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import any_of
from ..functions.times import normalised_image_time, once, parse_timestamp, utc
from ..schemas import SATELLITE_RAW, SENSOR_RAW, WEATHER_RAW

_BOX = ("bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat")


def decode(messages: DataFrame, schema: str) -> DataFrame:
    """Flatten the JSON in `value` and keep topic, partition, offset and time of the message.

    A text of which fields were read without any fault is JSON, unless it holds one of
    the numbers that only the reader of fields knows; only others are read once more.
    """
    text = F.col("value").cast("string")
    meta = [F.col(c).alias(f"kafka_{c}") for c in ("topic", "partition", "offset", "timestamp")]
    fields = F.from_json(text, f"{schema}, _fault string", {"columnNameOfCorruptRecord": "_fault"})
    data = messages.select(text.alias("raw_value"), F.inline(F.array(fields)), *meta)  # behind a generator: read once a row
    names = [c for c in data.columns if c not in ("raw_value", "_fault") and not c.startswith("kafka_")]
    raw = F.col("raw_value")
    sound = F.col("_fault").isNull() & any_of(F.col(c).isNotNull() for c in names) & ~any_of(F.contains(raw, F.lit(x)) for x in ("NaN", "Inf", "INF"))
    ok = F.when(sound, F.lit(True)).otherwise(F.get_json_object(raw, "$").isNotNull())
    return data.select(*names, "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "raw_value", ok.alias("parse_ok"))


def with_time_parts(rows: DataFrame, text: str = "timestamp") -> DataFrame:
    """year, month, day and hour (UTC) of the event time, null where it doesn't parse."""
    t = F.col("_time")
    parts = [part(t).alias(name) for name, part in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))]
    timed = once(rows, _time=utc(parse_timestamp(F.col(text))))
    return timed.select(*[F.col(f"`{c}`") for c in rows.columns], *parts)


def sensor(messages: DataFrame) -> DataFrame:
    return with_time_parts(decode(messages, SENSOR_RAW))


def weather(messages: DataFrame) -> DataFrame:
    return with_time_parts(decode(messages, WEATHER_RAW))


def satellite(messages: DataFrame, bucket: str = "satellite-images") -> DataFrame:
    """Decoded images with size, box and object name; rows without an image are dropped.

    A missing box counts as four zeros; a shorter one has nulls at its end. The
    name is made from the message's place in its topic, so no two are the same.
    """
    rows = decode(messages, SATELLITE_RAW).where(F.coalesce(F.length("image_base64"), F.lit(0)) > 0)
    box = F.coalesce("location.bbox", F.array(*[F.lit(0.0)] * 4))
    image = F.try_to_binary("image_base64", F.lit("base64"))
    when = normalised_image_time("timestamp")
    name = F.concat(F.lit(f"{bucket}/"), F.date_format(when, "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), "kafka_partition", F.lit("_"), "kafka_offset", F.lit(".png"))
    rows = rows.withColumns({"image": image, "local_timestamp": when}).withColumn("image_path", name)
    rows = rows.withColumns({"image_size_bytes": F.octet_length("image")} | {c: F.get(box, F.lit(i)) for i, c in enumerate(_BOX)})
    parts = {"year": F.year("local_timestamp"), "month": F.month("local_timestamp"), "day": F.dayofmonth("local_timestamp"), "hour": F.hour("local_timestamp")}
    return rows.drop("image_base64", "location").withColumns(parts)


def rejects(rows: DataFrame) -> DataFrame:
    """Messages that could not be decoded, with their text and place."""
    return rows.where(~F.coalesce("parse_ok", F.lit(False))).select("raw_value", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp")


def has_rows(rows: DataFrame) -> bool:
    return not rows.isEmpty()
