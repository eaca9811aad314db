"""Incidents under review as tables: decisions, statuses, queue, archive, ranking, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.review import MOVES
from ..tables import written

STATUSES = ("awaiting", "published", "rejected", "merged", "resolved")


def statuses(events: DataFrame) -> DataFrame:
    """(draft_id, status, decisions): the status after the last event of each draft in order of seq."""
    last = events.groupBy("draft_id").agg(F.max(F.struct("seq", "action"))["action"].alias("action"), (F.count("*") - 1).alias("decisions"))
    status = F.lit("awaiting")
    for action, (_, after) in MOVES.items():
        status = F.when(F.col("action") == action, after).otherwise(status)
    return last.select("draft_id", status.alias("status"), "decisions")


def status_counts(status: DataFrame) -> DataFrame:
    """(status, n) with a row for each of STATUSES, zeros included."""
    every = status.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = status.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def trail(events: DataFrame) -> DataFrame:
    """(draft_id, trail): the actions of each draft in order. Decisions are a person's clicks: few for each draft."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "action")))
    return events.groupBy("draft_id").agg(F.array_join(F.transform(steps, lambda e: e["action"]), " > ").alias("trail"))


def decision_times(events: DataFrame) -> DataFrame:
    """(day, median_minutes, n): from the first event to the last of each decided draft, by the day of the decision."""
    span = events.groupBy("draft_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).where("n > 1")
    day = F.date_format(F.timestamp_micros("last"), "yyyy-MM-dd")
    return span.groupBy(day.alias("day")).agg(F.round(F.median((F.col("last") - F.col("first")) / 6e7), 4).alias("median_minutes"), F.count("*").alias("n"))


def ranked(incidents: DataFrame) -> DataFrame:
    """incidents(label, status, priority, severity) with place: awaiting first, then P1 to P4, then by severity; merged
    ones are left out."""
    order = [F.col("status") != "awaiting", "priority", F.desc("severity"), "label"]
    return numbered(incidents.where("status <> 'merged'"), "place", *order)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place from 1 in an order, by a range sort: each partition numbers its own rows, and starts after those
    before it. Only the partitions' sizes meet in one task."""
    row = F.col("__row")
    sorted_ = written(rows.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    part, own = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    size = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = size.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return sorted_.withColumn("__part", part).join(base, "__part").withColumn(name, (F.col("__base") + own + 1).cast("int")).drop(
        "__row", "__part", "__base")


def archive(incidents: DataFrame, since: int, status: str | None = None, service: str | None = None, text: str | None = None,
            limit: int = 50) -> DataFrame:
    """The archive's own query: of incidents(label, status, started, services, title) since a time, the newest `limit` of
    a status; only these are then searched for a service and a text."""
    out = incidents.where(F.col("started") >= since)
    if status:
        out = out.where(F.col("status") == status)
    out = out.orderBy(F.desc("started"), "label").limit(limit)
    if service:
        out = out.where(F.array_contains("services", service))
    return out.where(F.lower("title").contains(text.lower())) if text else out


def overlay(services: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(service, open_incidents, root_of): how many clusters hold a service and how many it is the root of."""
    has = members.select("label", "service").distinct().groupBy("service").agg(F.count("*").alias("open_incidents"))
    root = roots.groupBy(F.col("root").alias("service")).agg(F.count("*").alias("root_of"))
    return services.join(has, "service", "left").join(root, "service", "left").select(
        "service", F.coalesce("open_incidents", F.lit(0)).alias("open_incidents"), F.coalesce("root_of", F.lit(0)).alias("root_of"))


def pair_weights(pairs: DataFrame, learned: DataFrame) -> DataFrame:
    """pairs(a, b) with the learned weight set of the first pattern, by k, that holds both services; null for the default.
    learned(k, services) is a short list, met through its services."""
    one = learned.select("k", F.explode("services").alias("a"))
    two = learned.select("k", F.explode("services").alias("b"))
    met = pairs.join(one, "a").join(two, ["b", "k"]).groupBy("a", "b").agg(F.min("k").alias("k"))
    return pairs.join(met, ["a", "b"], "left")


def signal_class(signals: DataFrame, incidents: DataFrame) -> DataFrame:
    """(id, class): correlated where an incident that holds the service began at most a second after the signal, anomaly,
    or normal. incidents(service, started); a service's first incident decides."""
    first = incidents.groupBy("service").agg(F.min("started").alias("started"))
    kind = F.when(F.col("ts") >= F.col("started") - 1_000_000, "correlated").when(F.col("is_anomaly"), "anomaly").otherwise("normal")
    return signals.join(first, "service", "left").select("id", kind.alias("class"))


def ingest_faults(alerts: DataFrame) -> DataFrame:
    """One row: alerts, those without id, without a readable time, and ids that come more than once, of alerts(id, timestamp)."""
    read = F.try_to_timestamp(F.col("timestamp")).isNull()
    each = alerts.groupBy("id").agg(F.count("*").alias("n"), F.count_if(read).alias("bad"))
    none = F.col("id").isNull() | (F.col("id") == "")
    return each.agg(F.sum("n").alias("alerts"), F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("no_id"), F.sum(
        "bad").alias("bad_time"), F.count_if(~none & (F.col("n") > 1)).alias("repeated_ids"))


def funnel(received: int | object, *counts: object) -> object:
    """A stage's share of what was received, in percent with one decimal; 0 where nothing was."""
    return F.coalesce(F.round(100 * (1 - F.try_divide(counts[0], received)), 1), F.lit(0.0))


def minutes_saved(raw: object) -> object:
    """Half a minute for each raw alert less two, never below 0."""
    return F.greatest(F.round(raw * 30 / 60) - 2, F.lit(0)).cast("long")
