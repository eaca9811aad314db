"""Recorded days made into one batch that looks current, and what part of it is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.review_tables import numbered
from ..tables import written

GAP = 2 * 3_600_000_000


def concatenated(rows: DataFrame, gap: int = GAP) -> DataFrame:
    """rows(day, ts, ...) with days back to back: each begins `gap` microseconds after the end of the one before; the first
    stays where it is. Only a row for each day is ordered in one place."""
    span = rows.groupBy("day").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.first("lo").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.col("hi") - F.col("lo") + gap).over(before), F.lit(0))
    move = span.select(F.col("day").alias("__day"), (begin - F.col("lo")).alias("__move"))
    return rows.join(move, F.col("day").eqNullSafe(F.col("__day"))).withColumn("ts", F.col("ts") + F.col("__move")).drop("__day", "__move")


def shifted(rows: DataFrame, now: int, window: int = 300_000_000) -> DataFrame:
    """rows(ts, ...) moved so that the newest is about now, by whole dedup windows, so that rows share windows as before."""
    newest = rows.agg(F.max("ts").alias("__newest"))  # one row
    move = F.floor((F.lit(now) - F.col("__newest")) / window) * window
    return rows.join(F.broadcast(newest), F.lit(True)).withColumn("ts", F.col("ts") + move.cast("long")).drop("__newest")


def sampled(rows: DataFrame, strata: list[str], budget: int, rare: Column, damped: Column, whole: int = 500, least: int = 5, damping: float = 0.35) -> DataFrame:
    """Evenly spaced rows(ts, id, *strata) of each stratum, a sampling operator: rare strata of up to `whole` rows are taken
    whole; others at least `least` and their share of what is left of the budget, by the square root of what they have
    beyond that, damped ones counting less. rare and damped are conditions on the strata."""
    n = rows.groupBy(*strata).agg(F.count("*").alias("size"))
    n = n.withColumn("kept", rare & (F.col("size") <= whole)).withColumn("base", F.least("size", F.lit(least)))
    weight = F.sqrt(F.col("size") - F.col("base")) * F.when(damped, damping).otherwise(1.0)
    n = written(n.withColumn("weight", F.when(~F.col("kept"), weight)), "strata")
    total = n.agg(F.sum(F.when(F.col("kept"), F.col("size")).otherwise(F.col("base"))).alias("taken"), F.sum("weight").alias("weights"))  # one row
    spare = F.greatest(F.lit(budget) - F.col("taken"), F.lit(0))
    more = F.floor(spare * F.coalesce(F.try_divide("weight", "weights"), F.lit(0.0)) + 1e-9)
    take = F.when(F.col("kept"), F.col("size")).otherwise(F.least("size", F.col("base") + more)).cast("long")
    plan = n.join(F.broadcast(total), F.lit(True)).select(*[F.col(c).alias(f"__{c}") for c in strata], F.col("size").alias("__size"), take.alias("__take"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("ts", "id")) - 1
    at = rows.withColumn("__k", place)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in strata]
    # the i-th pick is the row at floor(i * size / take): row k is one where such an i exists
    i = F.ceil(F.col("__k") * F.col("__take") / F.col("__size"))
    pick = (F.floor(i * F.col("__size") / F.col("__take")) == F.col("__k")) & (i < F.col("__take"))
    return at.join(plan, same).where(pick).drop("__k", "__size", "__take", *[f"__{c}" for c in strata])


def observed(edges: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The part of edges(caller, callee) that partial tracing would show: a fraction of them, one at least, by the order of
    seeded hashes."""
    distinct = edges.select("caller", "callee").distinct()
    if fraction >= 1:
        return distinct
    keyed = distinct.withColumn("__h", F.sha1(F.concat_ws(":", F.lit(str(seed)), "caller", "callee")))
    many = F.greatest(F.floor(F.lit(fraction) * F.col("__n")), F.lit(1))
    total = distinct.agg(F.count("*").alias("__n"))  # one row
    return numbered(keyed, "__place", "__h").join(F.broadcast(total), F.lit(True)).where(F.col("__place") <= many).select("caller", "callee")


def schedule(rows: DataFrame, seconds: float = 24.0, minutes: int = 50, spacing: float = 0.08, part: int = 100_000) -> DataFrame:
    """(id, at): at which second of a replay each of rows(id, ts) shows: what is older than `minutes` before the newest at 0,
    the rest from half a second on in proportion to time, each at least `spacing` after the one before, none after `seconds`.
    The spacing is a running maximum: inside parts of the order, and over the parts' maxima."""
    ends = rows.agg(F.max("ts").alias("newest"))
    all_ = rows.select("id", "ts").join(F.broadcast(ends), F.lit(True))
    recent = F.col("ts") >= F.col("newest") - minutes * 60_000_000
    start = all_.where(recent).agg(F.min("ts").alias("t0"))
    late = numbered(all_.where(recent).join(F.broadcast(start), F.lit(True)), "k", "ts", "id")
    # the times are whole milliseconds
    ms = lambda c: F.floor(F.col(c) / 1000)
    base = (ms("ts") - ms("t0")) / F.greatest(ms("newest") - ms("t0"), F.lit(1)) * (seconds - 1) + 0.5
    late = written(late.select("id", "k", (base - spacing * F.col("k")).alias("lead"), F.floor((F.col("k") - 1) / part).alias("part")), "schedule")
    top = late.groupBy("part").agg(F.max("lead").alias("top"))
    before = top.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    upto = F.max("lead").over(Window.partitionBy("part").orderBy("k"))
    out = late.withColumn("upto", upto).join(before, "part").select("id", F.least(F.round(F.greatest("upto", F.coalesce("before", "upto")) + spacing * F.col(
        "k"), 6), F.lit(seconds)).alias("at"))
    return all_.where(~recent).select("id", F.lit(0.0).alias("at")).union(out)


def candidate() -> Column:
    """What a person would label: alarms and alerts, and other signals from warnings up."""
    return F.col("source").isin("cloudwatch_metric", "grafana_alert") | F.col("severity").isin("critical", "high", "warning")


def first_rule(rules: list[tuple[str, str | None, str]]) -> Column:
    """The name of the first of rules(name, service or None for any, pattern) that fits a signal's service and lower-case
    message, or metric where it has none; null where none fits."""
    text = F.lower(F.coalesce(F.nullif("message", F.lit("")), "metric", F.lit("")))
    out = F.lit(None).cast("string")
    for name, service, pattern in reversed(rules):
        fits = text.rlike(pattern) if service is None else (F.col("service") == service) & text.rlike(pattern)
        out = F.when(fits, name).otherwise(out)
    return out


def canonical_source(source: Column) -> Column:
    """The name of a source's family in reports."""
    low = F.lower(source)
    return F.when(low.contains("grafana"), "grafana_alerts").when(low.contains("metric"), "cloudwatch_metrics").otherwise("application_logs")
