"""From candidate clusters to incidents: splits until nothing falls apart any more, then the checks of what is left.

1. by cause: a cluster with several independent causes falls apart along them (optional);
2. by environment: a cluster of several environments becomes one part for each, signals without one go with the most
   frequent;
3. at weak bridges, again and again (bridges.py); parts that their links don't hold together are left as they are;
4. checks of each part on its own links: at least two signals, coherence, anomaly support, independent evidence. A part
   that passes all is an incident, with its confidence.

A part of step 2 has one environment, and so have its parts, so the splits settle in this order. What a cluster went
through stays with its parts. Parts are named after their smallest id.

Defined cases: a signal in no link is a part alone and rejected; repeated ids are an error of the caller; no clusters give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .bridges import split_weak_bridges
from .evidence import environment_split
from .incidents import MIN_ANOMALY, MIN_DENSITY, annotate, correlation_confidence


def parts(members: DataFrame, links: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """members(id, label, environment, ...) with part and what made it: by_cause, by_environment, at_bridge. causes(id,
    centre) names the cause of a signal, null where its cluster has one."""
    named = lambda *by: F.min("id").over(Window.partitionBy("label", *by))
    m = members.withColumn("centre", F.lit(None).cast("string")) if causes is None else members.join(causes.select("id", "centre"), "id", "left")
    m = m.withColumn("first", named("centre")).withColumn("by_cause", F.col("centre").isNotNull())
    env = environment_split(m.select("id", F.col("first").alias("label"), "environment")).select(
        "id", F.col("environment").alias("of"), F.col("mixed").alias("by_environment"))
    m = m.join(env, "id").withColumn("second", F.min("id").over(Window.partitionBy("first", "of")))
    m = written(m, "parts")
    cut = split_weak_bridges(m.select("id", F.col("second").alias("label")), links).select("id", "part")
    several = F.max("part").over(Window.partitionBy("second")) != F.min("part").over(Window.partitionBy("second"))
    out = m.join(cut, "id").withColumn("at_bridge", several)
    return out.drop("centre", "first", "second", "environment").withColumnRenamed("of", "environment")


def what_was_seen():
    """The condition of a signal: the template of a log line, else its metric, else the start of its message."""
    log = F.when(F.col("source").isin("app_log", "cloudwatch_log"), F.nullif("template", F.lit("")))
    return F.coalesce(log, F.nullif("metric", F.lit("")), F.substring(F.coalesce("message", F.lit("")), 1, 60))


def validated(members: DataFrame, links: DataFrame, hops: DataFrame, causes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, signals): verdicts has a row for each part with label, part, n_signals, environment, what made it, the
    checks, accepted and confidence (null where rejected); signals are the members with their part."""
    m = written(parts(members, links, causes), "validated")
    inner = links.join(m.select(F.col("id").alias("a_id"), F.col("part").alias("pa")), "a_id").join(
        m.select(F.col("id").alias("b_id"), F.col("part").alias("pb")), "b_id").where("pa = pb").drop("pa", "pb")
    inner = written(inner, "inner-links")
    as_cluster = m.drop("label").withColumnRenamed("part", "label")
    c = annotate(as_cluster, inner).select(F.col("label").alias("part"), "n_signals", "density", "peak")
    seen = m.groupBy("part").agg(
        F.min("label").alias("label"), F.min("environment").alias("environment"), F.first("by_cause").alias("by_cause"),
        F.first("by_environment").alias("by_environment"), F.first("at_bridge").alias("at_bridge"),
        F.countDistinct("service", "source", what_was_seen()).alias("conditions"), F.bool_and(F.col("sev_rank") <= 1).alias("severe"))
    out = seen.join(c, "part").select(
        "label", "part", "n_signals", "environment", "by_cause", "by_environment", "at_bridge",
        (F.col("n_signals") >= 2).alias("large_enough"),
        ((F.col("n_signals") <= 3) | (F.coalesce("density", F.lit(0.0)) >= MIN_DENSITY)).alias("coherent"),
        (F.col("peak") >= MIN_ANOMALY).alias("supported"),
        ((F.col("conditions") >= 2) | F.col("severe")).alias("independent"))
    accepted = F.col("large_enough") & F.col("coherent") & F.col("supported") & F.col("independent")
    sure = correlation_confidence(as_cluster, inner, hops).select(F.col("label").alias("part"), F.least(F.round("confidence", 2), F.lit(1.0)).alias("sure"))
    out = out.withColumn("accepted", accepted).join(sure, "part", "left")
    return out.withColumn("confidence", F.when(F.col("accepted"), F.col("sure"))).drop("sure"), m
