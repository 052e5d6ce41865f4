"""Latest value by key with time to live.

Last write wins by (message time, partition, offset). The batch form looks at a
table as of a time; the streaming form is in streaming/state.py, the rules of what
is kept in cache_rules.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_of_literal, on_days
from ..schemas import LATEST


def latest(rows: DataFrame, kind: str, as_of: str, time: str, order: tuple[str, ...]) -> DataFrame:
    """The newest row of each key not older than the kind's time to live, with cached_at and cache_ttl; null keys have none.

    Older rows go before the aggregation: a key whose newest row is stale has no
    fresh row either. Rows with a `date` partition are pruned by it as well.
    """
    key, ttl = LATEST[kind]
    end = as_of_literal(as_of)
    start = end - F.make_interval(secs=F.lit(ttl))
    fresh = rows.where(on_days(start, end)) if "date" in rows.columns else rows
    fresh = fresh.where(F.col(key).isNotNull() & (F.col(time) >= start) & (F.col(time) <= end))
    return newest_of(fresh, key, (time, *order)).withColumns({"cached_at": end, "cache_ttl": F.lit(ttl)})


def latest_as_of_newest(rows: DataFrame, kind: str, time: str, order: tuple[str, ...]) -> DataFrame:
    """The same as of the newest time of the rows themselves, in one pass: the newest row of each key first, then those of them that are fresh."""
    key, ttl = LATEST[kind]
    newest = newest_of(rows.where(F.col(time).isNotNull()), key, (time, *order))
    end = newest.agg(F.max(time).alias("cached_at"))
    fresh = newest.join(F.broadcast(end)).where(F.col(key).isNotNull() & (F.col(time) >= F.col("cached_at") - F.make_interval(secs=F.lit(ttl))))  # one row
    return fresh.withColumns({"cache_ttl": F.lit(ttl)})


def newest_of(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The row of each key that is largest by the order, by partial aggregation."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")


def newest_time(rows: DataFrame, time: str) -> str:
    """The largest zoneless time of the rows as text, or the epoch's start where there is none."""
    return str(rows.agg(F.coalesce(F.max(time), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))).first()[0])


def lookup(found: DataFrame, key: str, value: str) -> DataFrame:
    return found.where(F.col(key) == value)


def key_counts(kinds: dict[str, DataFrame]) -> DataFrame:
    """Number of keys by kind."""
    parts = [rows.agg(F.count("*").alias("n_keys")).select(F.lit(kind).alias("kind"), "n_keys") for kind, rows in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def available_ids(found: DataFrame, key: str) -> DataFrame:
    return found.select(F.col(key).alias("id")).distinct().orderBy("id")
