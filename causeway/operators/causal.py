"""Root causes: onsets, precedence, reach over the service graph, evidence, counterfactual ablation, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .incidents import family
from .topology import explained_without

TOLERANCE = 300 * 1_000_000
AGREEMENT = 0.12


def onsets(members: DataFrame) -> DataFrame:
    """(label, service, onset, n_signals, strength) of each service of each cluster."""
    strength = (
        0.40 * F.max("anomaly_score")
        + 0.25 * (1 - F.min("sev_rank") / 3)
        + 0.35 * F.least(F.countDistinct(family(F.col("source"))) / 3, F.lit(1.0))
    )
    return members.groupBy("label", "service").agg(
        F.min("ts").alias("onset"), F.count("*").alias("n_signals"), F.round(F.least(strength, F.lit(1.0)), 6).alias(
            "strength"))


def precedence(on: DataFrame) -> DataFrame:
    """Share of the other services whose onset is strictly later; 1 for a lone service."""
    n = F.count("*").over(Window.partitionBy("label"))
    upto = F.count("*").over(Window.partitionBy("label").orderBy("onset").rangeBetween(Window.unboundedPreceding, 0))
    return on.withColumn("temporal", F.when(n == 1, 1.0).otherwise(F.round((n - upto) / (n - 1), 6)))


def reach(on: DataFrame, dependents: DataFrame, floor: int = TOLERANCE) -> DataFrame:
    """(label, service, reach): share of the other services that transitively call it and did not fail well before."""
    other = on.select("label", F.col("service").alias("o"), F.col("onset").alias("o_onset"))
    pair = on.join(other, "label").where("o <> service")
    dep = dependents.select(F.col("service").alias("ds"), F.col("dependent").alias("dd"))
    hit = pair.join(dep, (F.col("service") == F.col("ds")) & (F.col("o") == F.col("dd")), "left")
    good = F.col("dd").isNotNull() & (F.col("o_onset") >= F.col("onset") - floor)
    got = hit.groupBy("label", "service").agg(F.round(F.avg(good.cast("double")), 6).alias("reach"))
    return on.select("label", "service").join(got, ["label", "service"], "left").withColumn(
        "reach", F.coalesce("reach", F.lit(0.0)))


def symptoms(on: DataFrame, edges: DataFrame, ceiling: int = TOLERANCE) -> DataFrame:
    """(label, service, symptom_of): failing services it calls whose onset is not well after its own."""
    other = on.select("label", F.col("service").alias("callee"), F.col("onset").alias("c_onset"))
    met = on.join(edges.distinct(), on.service == F.col("caller")).join(other, ["label", "callee"]).where(
        (F.col("c_onset") <= F.col("onset") + ceiling) & (F.col("callee") != F.col("service")))
    return met.groupBy("label", "service").agg(F.array_sort(F.collect_set("callee")).alias("symptom_of"))


def ablation(on: DataFrame, dependents: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, service, n_unique): how many failing services only this one explains: its dependents less those that
    other failing services explain in the graph without it."""
    services = on.select("label", "service")
    mine = services.join(dependents, "service").join(
        services.select("label", F.col("service").alias("dependent")), ["label", "dependent"]).select("label", "service", "dependent")
    explained = explained_without(services, edges).select("label", F.col("removed").alias("service"), "dependent")
    unique = mine.join(explained, ["label", "service", "dependent"], "left_anti")
    n = unique.groupBy("label", "service").agg(F.count("*").alias("n_unique"))
    return services.join(n, ["label", "service"], "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))


def scores(members: DataFrame, edges: DataFrame, dependents: DataFrame) -> DataFrame:
    """All five passes for each (label, service)."""
    on = onsets(members)
    key = ["label", "service"]
    out = precedence(on).join(reach(on, dependents), key).join(symptoms(on, edges), key, "left").join(
        ablation(on, dependents, edges), key)
    rank = F.round(0.30 * F.col("temporal") + 0.40 * F.col("reach") + 0.30 * F.col("strength"), 4)
    return out.withColumn("rank_score", rank).withColumn("is_symptom", F.col("symptom_of").isNotNull()).withColumn(
        "survived", F.col("n_unique") > 0)


def root_causes(scored: DataFrame) -> DataFrame:
    """(label, root, rank_score, fell_back, confidence): the best survivor by rank, then onset, then name; all services
    where none survives, with less confidence."""
    ok = F.col("survived") & ~F.col("is_symptom")
    some = F.max(ok.cast("int")).over(Window.partitionBy("label")) == 1
    pool = scored.withColumn("fell_back", ~some).where(ok | F.col("fell_back"))
    order = Window.partitionBy("label").orderBy(F.desc("rank_score"), "onset", "service")
    best = pool.withColumn("r", F.row_number().over(order)).withColumn(
        "runner_up", F.coalesce(F.lead("rank_score").over(order), F.lit(0.0))).where("r = 1")
    margin = F.greatest(F.col("rank_score") - F.col("runner_up"), F.lit(0.0))
    c = (
        0.30 * F.least(margin / 0.25, F.lit(1.0)) + 0.30 * F.col("reach") + 0.20 * F.col("strength")
        + 0.20 * (F.col("n_unique") > 0).cast("double")
    )
    c = c * F.when(F.col("fell_back"), 0.6).otherwise(1.0) * F.when(F.col("is_symptom"), 0.5).otherwise(1.0)
    return best.select("label", F.col("service").alias("root"), "rank_score", "fell_back", F.round(
        F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 2).alias("causal_confidence"))


def representative(members: DataFrame) -> DataFrame:
    """(label, service, id): the telling signal of each service: with a metric or from a dashboard first, then severity,
    then time."""
    plain = ~(F.col("metric").isNotNull() | (F.col("source") == "grafana_alert"))
    best = F.min(F.struct(plain.alias("p"), "sev_rank", "ts", "id"))
    return members.groupBy("label", "service").agg(best.alias("b")).select("label", "service", F.col("b.id").alias("id"))
