"""Impact severity of clusters and its factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .incidents import family

DEFAULT = 0.5


def blast_radius(members: DataFrame, roots: DataFrame, dependents: DataFrame) -> DataFrame:
    """0.7 of failing services against five, 0.3 of further dependents of the root against five."""
    services = members.select("label", "service").distinct()
    size = services.groupBy("label").agg(F.count("*").alias("n_services"))
    further = roots.join(dependents, roots.root == dependents.service).select(
        "label", F.col("dependent").alias("service")).join(services, ["label", "service"], "left_anti")
    more = further.groupBy("label").agg(F.count("*").alias("n_further"))
    cap = lambda c: F.least(c / 5, F.lit(1.0))
    return size.join(more, "label", "left").withColumn("n_further", F.coalesce("n_further", F.lit(0))).withColumn(
        "blast", F.round(0.7 * cap(F.col("n_services")) + 0.3 * cap(F.col("n_further")), 3))


def criticality(members: DataFrame, registry: DataFrame) -> DataFrame:
    """Highest criticality among a cluster's services; unknown ones count DEFAULT."""
    known = members.select("label", "service").distinct().join(registry, "service", "left")
    return known.groupBy("label").agg(F.round(F.max(F.coalesce("criticality", F.lit(DEFAULT))), 3).alias("criticality"))


def magnitude(members: DataFrame) -> DataFrame:
    return members.groupBy("label").agg(F.round(F.least(F.greatest(F.max("anomaly_score"), F.lit(0.0)), F.lit(1.0)), 3).alias(
        "magnitude"))


def trend(members: DataFrame) -> DataFrame:
    """Arrivals in the second half of the span against the first: 0.5 for fewer than 4 signals, 0.8 without a span."""
    span = members.groupBy("label").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    halves = members.join(span, "label").groupBy("label", "lo", "hi", "n").agg(
        F.sum(((F.col("ts") - F.col("lo")) * 2 <= F.col("hi") - F.col("lo")).cast("int")).alias("first"))
    ratio = (F.col("n") - F.col("first")) / F.nullif("first", F.lit(0))
    score = F.when(F.col("n") < 4, 0.5).when(F.col("hi") == F.col("lo"), 0.8).otherwise(
        F.round(F.least(ratio / 2, F.lit(1.0)), 3))
    return halves.select("label", score.alias("trend"))


def diversity(members: DataFrame) -> DataFrame:
    return members.groupBy("label").agg(F.round(F.least(F.countDistinct(family(F.col("source"))) / 3, F.lit(1.0)), 3).alias(
        "diversity"))


def flaps(members: DataFrame) -> DataFrame:
    """Most repeats of one condition of one service."""
    what = F.coalesce("template", "metric")
    n = members.groupBy("label", "service", what.alias("w")).agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(F.max("n").alias("flap_count"))


def suppressed(members: DataFrame, windows: DataFrame) -> DataFrame:
    """(label, suppressed): every service is covered by an enabled maintenance window that holds the cluster's start;
    a window without a service covers all."""
    span = members.groupBy("label").agg(F.min("ts").alias("started"))
    services = members.select("label", "service").distinct().join(span, "label")
    day = lambda c: F.floor(c / 86_400_000_000)
    # one equi-join on (service or every service, day); a window has a row for each day it touches
    w = windows.where("enabled and start_ts <= end_ts").select(F.coalesce("service", F.lit("*")).alias("of"), "start_ts", "end_ts", F.explode(
        F.sequence(day(F.col("start_ts")), day(F.col("end_ts")))).alias("day"))
    asked = services.withColumn("day", day(F.col("started"))).withColumn("of", F.explode(F.array("service", F.lit("*"))))
    hit = asked.join(w, ["of", "day"]).where("started >= start_ts and started <= end_ts").select("label", "service").distinct().withColumn("hit", F.lit(1))
    both = services.join(hit.select("label", "service", "hit"), ["label", "service"], "left")
    return both.groupBy("label").agg((F.count("hit") == F.count("*")).alias("suppressed"))


def impact(members: DataFrame, roots: DataFrame, dependents: DataFrame, registry: DataFrame) -> DataFrame:
    """Severity 0.40 blast + 0.35 criticality + 0.25 magnitude and its priority."""
    out = blast_radius(members, roots, dependents).join(criticality(members, registry), "label").join(
        magnitude(members), "label")
    s = F.round(0.40 * F.col("blast") + 0.35 * F.col("criticality") + 0.25 * F.col("magnitude") + 1e-9, 3)
    p = F.when(F.col("severity") >= 0.75, "P1").when(F.col("severity") >= 0.50, "P2").when(
        F.col("severity") >= 0.25, "P3").otherwise("P4")
    return out.withColumn("severity", s).withColumn("priority", p)


def p1_warning(scored: DataFrame, ceiling: float = 0.4, suppressed: DataFrame | None = None) -> DataFrame:
    """One row: incidents, share of P1, and whether at least 3 incidents have more P1 than the ceiling. Those that
    suppressed(label, suppressed) holds back are counted as incidents, but have no part in the share."""
    if suppressed is not None:
        held = suppressed.where("suppressed").select("label", F.lit(True).alias("held"))
        scored = scored.join(held, "label", "left")
        live = F.col("held").isNull()
        share = F.round(F.avg(F.when(live, (F.col("priority") == "P1").cast("double"))), 6)
        out = scored.agg(F.count("*").alias("incidents"), F.count_if(live).alias("live"), share.alias("p1_share"))
        return out.withColumn("warn", F.coalesce((F.col("incidents") >= 3) & (F.col("p1_share") > ceiling), F.lit(False)))
    return scored.agg(F.count("*").alias("incidents"), F.round(F.avg((F.col("priority") == "P1").cast("double")), 6).alias(
        "p1_share")).withColumn("warn", (F.col("incidents") >= 3) & (F.col("p1_share") > ceiling))
