"""Rules of messages before they are kept as latest values, with the reasons of a refusal.

A message is judged by its JSON itself, as a type that a schema would have cast hides
what was sent: its members are looked at as variants. A message's failed rules are
bits of one number; reasons name them. All of it is built-in functions.

Defined results: text that is no JSON, or no JSON object, fails one rule and no other;
a member that is missing fails that rule alone; null is there, but neither text, number,
boolean nor object; true and false count as the numbers 1 and 0; range ends are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LATEST, LATEST_TIME


@dataclass(frozen=True)
class Member:
    """A member that a message must have, and what it must be: anything, text, filled (text that is not empty), number, boolean or object."""

    name: str
    kind: str = "anything"
    low: float | None = None
    high: float | None = None


# Members of the messages of each kind, and their ranges.
MEMBERS = {
    "sensor": (
        Member("field_id", "filled"),
        Member("location", "filled"),
        Member("latitude", "number", -90, 90),
        Member("longitude", "number", -180, 180),
        Member("temperature", "number", -20, 60),
        Member("humidity", "number", 0, 100),
        Member("soil_ph", "number", 3, 9),
    ),
    "weather": (
        Member("location", "filled"),
        Member("temp_c", "number", -50, 60),
        Member("humidity", "number", 0, 100),
        Member("wind_kph", "number", 0, 500),
        Member("uv", "number", 0, 20),
        Member("condition", "filled"),
        Member("precip_mm", "number", 0, 1000),
    ),
    "alert": (Member("zone_id", "filled"), Member("alert_timestamp"), Member("alert_type", "filled"), Member("severity", "filled"), Member("message"), Member("status", "filled")),
    "prediction": (
        Member("field_id", "text"),
        Member("location", "text"),
        Member("anomaly_score", "number"),
        Member("is_anomaly", "boolean"),
        Member("severity", "text"),
        Member("recommendations", "text"),
        Member("model_version", "text"),
        Member("prediction_timestamp", "text"),
        Member("features", "object"),
    ),
}
_TYPES = {"text": "^STRING", "filled": "^STRING", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)", "boolean": "^BOOLEAN", "object": "^OBJECT"}


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are computed once a row, however often later columns and filters name them: those do not pass a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _rules(member: Member, value: Column, kind: Column) -> list[tuple[str, Column]]:
    """(reason, condition that fails) of a member's value, a variant, and its type as text (null where it is missing)."""
    out = [(f"{member.name} is missing", kind.isNull())]
    if member.kind == "anything":
        return out
    right = kind.rlike(_TYPES[member.kind])
    out.append((f"{member.name} is no {member.kind.replace('filled', 'text')}", ~right))
    if member.kind == "filled":
        out.append((f"{member.name} is empty", right & (F.try_variant_get(value, "$", "string") == "")))
    if member.low is not None:
        number = F.coalesce(F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "boolean").cast("double"))
        out.append((f"{member.name} is out of range", right & ~number.between(member.low, member.high)))
    return out


def rules(kind: str) -> list[str]:
    """The reasons of a kind, in order; bit i of a number of failed rules stands for the i-th."""
    none = F.lit(None).cast("variant")
    return ["no JSON object", *[reason for m in MEMBERS[kind] for reason, _ in _rules(m, none, F.lit(None).cast("string"))]]


def _judged(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of `message`, a variant that is null where the text is no JSON, with their failed rules as a number; 0 is a valid message."""
    members = MEMBERS[kind]
    values = _once(rows, **{f"value_{i}": F.try_variant_get("message", f"$.{m.name}", "variant") for i, m in enumerate(members)})
    typed = _once(values, whole=F.schema_of_variant("message"), **{f"kind_{i}": F.schema_of_variant(f"value_{i}") for i in range(len(members))})
    broken = [fails for i, m in enumerate(members) for _, fails in _rules(m, F.col(f"value_{i}"), F.col(f"kind_{i}"))]
    bits = [F.when(fails, F.lit(1 << i).cast("long")).otherwise(0) for i, fails in enumerate(broken, 1)]
    whole = F.coalesce(F.col("whole").startswith("OBJECT"), F.lit(False))
    return _once(typed, failed=F.when(whole, sum(bits, F.lit(0).cast("long"))).otherwise(F.lit(1).cast("long")))


def reasons(kind: str, mask: Column | str) -> Column:
    """The reasons that a number of failed rules stands for, in the order of the rules.

    The number is named outside of any lambda, once a rule, as the optimizer would
    put a message's whole judgement into a lambda and so do it anew for each rule.
    """
    number = F.col(mask) if isinstance(mask, str) else mask
    return F.array_compact(F.array(*[F.when(number.bitwiseAND(F.lit(1 << i).cast("long")) != 0, reason) for i, reason in enumerate(rules(kind))]))


def checked(messages: DataFrame, kind: str) -> DataFrame:
    """Message envelopes as rows (key, message_time, kafka_partition, kafka_offset, value, failed): the time is the message's own or, where it has none, the broker's."""
    key, _ = LATEST[kind]
    rows = messages.select(F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), "timestamp", F.col("value").cast("string").alias("value"))
    judged = _judged(_once(rows, message=F.try_parse_json("value")), kind)
    time = F.try_variant_get("message", f"$.{LATEST_TIME[kind]}", "string").try_cast("timestamp")
    return judged.select(F.try_variant_get("message", f"$.{key}", "string").alias("key"), F.coalesce(time, F.col("timestamp")).alias("message_time"), "kafka_partition", "kafka_offset", "value", "failed")


def with_reasons(refused: DataFrame, kind: str) -> DataFrame:
    return refused.withColumn("reasons", reasons(kind, "failed"))


def rejects(rows: DataFrame, kind: str) -> DataFrame:
    """Refused messages with their reasons."""
    return with_reasons(rows.where("failed <> 0"), kind)
