"""Latest value by key as a stream with state and time to live, and reads of that state as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: What the state holds of a key, and what a change of it says.
PLACE = ("message_time", "kafka_partition", "kafka_offset")
STATE = "message_time timestamp, kafka_partition int, kafka_offset bigint, value string"
CHANGE = f"key string, {STATE}"
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_COLUMNS = [*PLACE, "value"]
_NAME = "newest"


class Newest(StatefulProcessor):
    """Keeps a key's row of largest (message_time, partition, offset) and says each change; a value expires its time to live after it was put."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState(_NAME, STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.newest.get()) if self.newest.exists() else None
        best = held
        for frame in rows:  # a frame at a time, so a hot key's rows are never held together
            row = tuple(frame[_COLUMNS].sort_values(list(PLACE)).iloc[-1])
            row = (row[0].to_pydatetime(), int(row[1]), int(row[2]), row[3])
            best = row if best is None or row[:3] > best[:3] else best
        if best is not None and best != held:
            self.newest.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["key", *_COLUMNS])

    def close(self) -> None:
        pass


def _reduced(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each frame the refused rows, and of each key the valid row of largest place; rows that are valid but have no key or time go."""
    order = [("key", "ascending"), *((c, "descending") for c in PLACE)]
    for frame in frames:
        refused = pc.not_equal(frame["failed"], 0)
        yield frame.filter(refused)
        usable = pc.and_(pc.invert(refused), pc.and_(frame["key"].is_valid(), frame["message_time"].is_valid()))
        kept = frame.filter(usable)
        if kept.num_rows:
            at = pc.sort_indices(pa.Table.from_batches([kept.select(["key", *PLACE])]), sort_keys=order)
            keys = kept["key"].take(at)
            first = pa.concat_arrays([pa.array([True]), pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))])
            yield kept.take(at.filter(first))


def reduced(rows: DataFrame) -> DataFrame:
    """Judged rows without those that another row of their key and frame makes stale, so that a key's rows are few before they meet in its task, with `valid`.

    They are few enough to be exchanged once more: a plan that names them twice, by
    `valid` alone, reuses that exchange and so judges once. A filter on a generator's
    column stays above it, where one on `failed` would move below the exchange.
    """
    few = rows.mapInArrow(_reduced, rows.schema).repartition("kafka_partition", "kafka_offset")
    return few.select("*", F.inline(F.array(F.struct((F.col("failed") == 0).alias("valid")))))


def changes(rows: DataFrame, ttl_seconds: int) -> DataFrame:
    """The stream of changes (CHANGE) of each key's latest value, of valid rows with key and time as `reduced` leaves them."""
    return rows.select("key", *_COLUMNS).groupBy("key").transformWithStateInPandas(Newest(ttl_seconds), CHANGE, "update", "processingTime")


def held(spark: SparkSession, checkpoint: str, now: Column | None = None, operator: int = 0) -> DataFrame:
    """All values (CHANGE) in the state of a stream's checkpoint that have not expired by `now`, a time in the session's zone (default: this moment)."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", _NAME).load()
    at = F.current_timestamp() if now is None else now
    return rows.where(F.col("value.ttlExpirationMs") > F.unix_millis(at)).select(F.col("key.key").alias("key"), *[F.col(f"value.value.{c}").alias(c) for c in _COLUMNS])
