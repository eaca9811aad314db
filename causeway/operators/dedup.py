"""Collapsing repeats of one condition in epoch-aligned buckets of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000


def bucket(ts: Column, minutes: float) -> Column:
    """Index of the bucket of a time in microseconds."""
    return F.floor(ts / int(minutes * MINUTE))


def content_key() -> Column:
    """What a signal is about: the template of a log line, else its metric or the start of its message."""
    alert = F.coalesce(F.nullif("metric", F.lit("")), F.substring("message", 1, 60))
    return F.when(F.col("source").isin("app_log", "cloudwatch_log"), F.concat(F.lit("tpl:"), F.col("template"))).otherwise(
        F.concat(F.lit("alert:"), alert))


def dedup_signals(signals: DataFrame, minutes: float = 5) -> DataFrame:
    """The earliest signal of each (service, component, content, bucket) with occurrence_count, the size of its group.
    One aggregation with partial sums: a hot condition is reduced where it is read."""
    first = F.min(F.struct("ts", "id", *[c for c in signals.columns if c not in ("ts", "id")])).alias("s")
    keyed = signals.withColumn("__key", content_key()).withColumn("__bucket", bucket(F.col("ts"), minutes))
    out = keyed.groupBy("service", "component", "__key", "__bucket").agg(first, F.count("*").alias("occurrence_count"))
    return out.select("s.*", "occurrence_count")


def dedup_alerts(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """Earliest alert of each hashed (service, name, window) with its number of repeats."""
    key = F.substring(F.sha1(F.concat_ws("|", "service", "name", F.floor(F.col("ts") / (seconds * 1_000_000)).cast(
        "string"))), 1, 16)
    first = F.min(F.struct("ts", "id")).alias("f")
    out = alerts.groupBy(key.alias("fingerprint")).agg(first, F.count("*").alias("duplicate_count"))
    return out.select("fingerprint", F.col("f.id").alias("id"), "duplicate_count")


def collapsed_share(signals: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: signals in, kept, and the percentage collapsed (0 without signals)."""
    a, b = signals.agg(F.count("*").alias("received")), kept.agg(F.count("*").alias("distinct_signals"))
    pct = F.coalesce(F.round(100 * (1 - F.try_divide("distinct_signals", "received")), 1), F.lit(0.0))
    return a.join(b).withColumn("collapsed_pct", pct)
