"""Functions of times. Wall-clock windows take an explicit `as_of`, so that reruns agree."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Rome"
_INSTANT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"


def parse_timestamp(text: Column | str) -> Column:
    """Microseconds with offset, else seconds with offset, else null; one pattern, as each that fails costs an exception, and none is tried on text without the colon that it needs."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.contains(t, F.lit(":")), F.try_to_timestamp(t, F.lit(_INSTANT)))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns behind a generator, which filters on them do not pass: each is computed once a row, however often it is used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def utc(instant: Column | str) -> Column:
    """An instant as a zoneless UTC timestamp."""
    return F.convert_timezone(None, F.lit("UTC"), F.col(instant).cast("timestamp_ntz") if isinstance(instant, str) else instant.cast("timestamp_ntz"))


def local(instant: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """An instant as a zoneless timestamp of the zone."""
    return F.convert_timezone(None, F.lit(zone), (F.col(instant) if isinstance(instant, str) else instant).cast("timestamp_ntz"))


def calendar_parts(instant: Column | str, zone: str = LOCAL_ZONE) -> dict[str, Column]:
    """date, hour, day_of_week (Sunday is 1), month and year in the zone."""
    t = local(instant, zone)
    return {"date": F.to_date(t), "hour": F.hour(t), "day_of_week": F.dayofweek(t), "month": F.month(t), "year": F.year(t)}


def on_days(start: Column, end: Column, column: str = "date") -> Column:
    """A condition on a local date partition that holds for all instants from start to end (zoneless UTC), so that other folders are skipped."""
    day = F.make_interval(days=F.lit(1))
    return (F.col(column) >= F.to_date(start - day)) & (F.col(column) <= F.to_date(end + day))


def as_of_literal(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def within(ts: Column | str, as_of: datetime | str, **span: int) -> Column:
    """as_of - span <= ts <= as_of; span as days=, hours= or mins=."""
    column = F.col(ts) if isinstance(ts, str) else ts
    end = as_of_literal(as_of)
    return (column >= end - F.make_interval(**{k: F.lit(v) for k, v in span.items()})) & (column <= end)


def normalised_image_time(text: Column | str) -> Column:
    """Local time of an image's text time: `Z` or an offset is honoured, a naive time is local already; null if neither parses."""
    t = F.col(text) if isinstance(text, str) else text
    zoned = F.coalesce(parse_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    naive = F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    has_zone = t.rlike(r"(Z|[+-]\d\d:\d\d)$")
    return F.when(has_zone, local(zoned)).otherwise(naive.cast("timestamp_ntz"))
