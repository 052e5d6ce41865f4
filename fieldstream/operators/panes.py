"""Feature aggregates from panes: partial aggregates a key and minute that merge associatively.

A pane row holds, for a key, a minute and a value of the column whose mode is asked for,
the number of rows, their first and last time, counts of flags, and of each metric its
count, mean, sum of squared deviations, least and largest value. Panes of any batches and
minutes merge to what one aggregation over all rows gives, so a look-back of any length
reads one row a key, minute and batch, and rows themselves only of the two minutes at its
ends that it cuts.

Defined results: null metrics are left out of their own count alone; a metric without
values has null statistics, with one value a null deviation; null keys are keys as in any
aggregation; rows without time have no pane; of tied modes the smallest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_of_literal, on_days
from . import gold


@dataclass(frozen=True)
class Shape:
    """What the panes of a kind of rows are about: keys, the column whose mode is asked for and the mode's name, metrics and flags."""

    prefix: str
    keys: tuple[str, ...]
    mode: str
    mode_name: str
    metrics: tuple[tuple[str, str, str], ...]
    flags: tuple[tuple[str, str], ...] = ()


SENSOR = Shape("sensor", ("field_id", "location"), "month", "sensor_dominant_month", gold.SENSOR_METRICS, gold.SENSOR_RATES)
WEATHER = Shape("weather", ("location",), "condition", "weather_dominant_condition", gold.WEATHER_METRICS)


def _minute(time: Column) -> Column:
    return F.date_trunc("minute", time).cast("timestamp_ntz")


def panes(rows: DataFrame, shape: Shape) -> DataFrame:
    """One row for each key, minute and value of the mode's column."""
    parts = [F.count("*").alias("n"), F.min("timestamp_parsed").alias("first"), F.max("timestamp_parsed").alias("last")]
    for flag, _ in shape.flags:
        parts += [F.count_if(F.col(flag)).alias(f"yes_{flag}"), F.count_if(~F.col(flag)).alias(f"no_{flag}")]
    for c, _, _ in shape.metrics:
        n = F.count(c)
        parts += [n.alias(f"n_{c}"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}"), F.coalesce(F.var_pop(c) * n, F.lit(0.0)).alias(f"m2_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    minute = _minute(F.col("timestamp_parsed"))
    return rows.where(F.col("timestamp_parsed").isNotNull()).groupBy(*shape.keys, minute.alias("minute"), shape.mode).agg(*parts).withColumn("date", F.to_date("minute"))


def merged(parts: DataFrame, shape: Shape, *keys: str) -> DataFrame:
    """Pane rows merged by the keys."""
    out = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")]
    out += [F.sum(f"{side}_{flag}").alias(f"{side}_{flag}") for flag, _ in shape.flags for side in ("yes", "no")]
    for c, _, _ in shape.metrics:
        n, mean = F.col(f"n_{c}"), F.col(f"mean_{c}")
        total, count = F.sum(n * mean), F.sum(n)
        middle = F.when(count > 0, total / count).otherwise(0.0)
        spread = F.sum(F.col(f"m2_{c}") + n * mean * mean) - count * middle * middle
        out += [count.alias(f"n_{c}"), middle.alias(f"mean_{c}"), F.greatest(spread, F.lit(0.0)).alias(f"m2_{c}"), F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}")]
    if shape.mode not in keys:
        known = F.when(F.col(shape.mode).isNotNull(), F.struct(-F.col("n"), F.col(shape.mode)))
        out.append(F.min_by(shape.mode, known).alias(shape.mode_name))
    return parts.groupBy(*keys).agg(*out)


def aggregates(parts: DataFrame, shape: Shape) -> DataFrame:
    """The aggregates that gold's functions give over rows, from pane rows: modes need the counts of each value first."""
    whole = merged(merged(parts, shape, *shape.keys, shape.mode), shape, *shape.keys)
    p, columns = shape.prefix, {}
    for c, long, _ in shape.metrics:
        n = F.col(f"n_{c}")
        columns |= {f"{p}_avg_{long}": F.when(n > 0, F.col(f"mean_{c}")), f"{p}_std_{long}": F.when(n > 1, F.sqrt(F.col(f"m2_{c}") / (n - 1))), f"{p}_min_{long}": F.col(f"min_{c}"), f"{p}_max_{long}": F.col(f"max_{c}")}
    for flag, short in shape.flags:
        yes, no = F.col(f"yes_{flag}"), F.col(f"no_{flag}")
        columns |= {f"{p}_{short}_valid_rate": F.when(yes + no > 0, yes / (yes + no)), f"{p}_{short}_invalid_count": no}
    columns |= {f"{p}_readings_count": F.col("n"), f"{p}_first_reading": F.col("first"), f"{p}_last_reading": F.col("last")}
    if p == "weather":
        columns["weather_total_precipitation"] = F.when(F.col("n_precip_mm") > 0, F.col("n_precip_mm") * F.col("mean_precip_mm"))
    return whole.select(*shape.keys, shape.mode_name, *[e.alias(name) for name, e in columns.items()])


def look_back(stored: DataFrame, rows: DataFrame, shape: Shape, as_of: str, minutes: int) -> DataFrame:
    """Pane rows of [as_of - minutes, as_of]: stored ones of whole minutes, and those of the rows of the minutes that the ends cut."""
    end = as_of_literal(as_of)
    start = end - F.make_interval(mins=F.lit(minutes))
    first = F.when(_minute(start) == start, start).otherwise(_minute(start) + F.make_interval(mins=F.lit(1)))
    inner = stored.where(F.col("date").between(F.to_date(start), F.to_date(end)) & (F.col("minute") >= first) & (F.col("minute") < _minute(end)))
    time = F.col("timestamp_parsed")
    cut = rows.where(on_days(start, end)) if "date" in rows.columns else rows
    cut = cut.where(((time >= start) & (time < first)) | ((time >= _minute(end)) & (time >= start) & (time <= end)))
    return inner.select(*[c for c in stored.columns if c != "batch_id"]).unionByName(panes(cut, shape), allowMissingColumns=False)


def features(sensor_panes: DataFrame, sensors: DataFrame, weather_panes: DataFrame, weather: DataFrame, fields: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """The feature table as gold.features gives it, from stored panes and the rows of the look-back's ends."""
    sides = [aggregates(look_back(p, r, s, as_of, minutes), s) for p, r, s in ((sensor_panes, sensors, SENSOR), (weather_panes, weather, WEATHER))]
    both = gold.joined(gold.sensor_derived(sides[0]), gold.weather_derived(sides[1]))
    return fields.select("field_id").join(gold.cross_features(both, as_of, minutes), "field_id", "left").select(*gold.COLUMNS)
