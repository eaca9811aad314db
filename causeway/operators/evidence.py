"""Why a signal is in its incident, and what an incident is called: joins, badges, confidence parts, titles, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .incidents import mean_of

#: Rank of the gates by strength; others come after.
GATES = ("shared trace", "same service", "direct dependency")


def both_ways(pairs: DataFrame, *terms: str) -> DataFrame:
    """Scored pairs as (id, other, gate, *terms) from either end."""
    ends = [pairs.select(F.col(a).alias("id"), F.col(b).alias("other"), "gate", *terms) for a, b in (("a_id", "b_id"), ("b_id", "a_id"))]
    return ends[0].union(ends[1])


def strongest_joins(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(label, id, gate, linked_to, sim and five badges) of each member: the pair inside its cluster with the strongest
    gate, then the most alike, then the smallest id. A member has a few pairs for each of its neighbours in time, so the
    order is kept inside one signal."""
    terms = ("service_term", "dependency_term", "template_term", "time_term", "sim")
    inside = both_ways(pairs, *terms).join(members.select("id", "label"), "id").join(
        members.select(F.col("id").alias("other"), F.col("label").alias("of")), "other").where(F.col("label") == F.col("of"))
    rank = F.lit(9)
    for k, gate in reversed(list(enumerate(GATES))):
        rank = F.when(F.col("gate") == gate, k).otherwise(rank)
    key = F.struct(rank.alias("rank"), (-F.col("sim")).alias("neg"), "other", "gate", *terms)
    best = inside.groupBy("label", "id").agg(F.min(key).alias("b")).select("label", "id", "b.*")
    return best.select(
        "label", "id", "gate", F.col("other").alias("linked_to"), "sim",
        ((F.col("gate") == GATES[1]) | (F.col("service_term") >= 1)).alias("badge_service"),
        (F.col("dependency_term") > 0).alias("badge_dependency"), (F.col("gate") == GATES[0]).alias("badge_trace"),
        (F.col("template_term") >= 0.3).alias("badge_template"), (F.col("time_term") > 0).alias("badge_window"))


def dimension_means(labels: DataFrame, pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(label, dimension, contribution): mean weighted term over the links of each cluster."""
    inside = pairs.join(labels.select(F.col("id").alias("a_id"), "label"), "a_id")
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.round(F.col(f"{k}_term"), 6).alias("v"), F.lit(
        w).alias("w")) for k, w in weights.items()]))
    each = inside.select("label", parts.alias("p")).select("label", "p.*")
    return each.groupBy("label", "dimension").agg(F.round(mean_of("v", 9) * F.max("w") + 1e-9, 6).alias("contribution"))


def confidence_parts(clusters: DataFrame) -> DataFrame:
    """(label, part, points): the terms of the correlator's confidence, rounded to two places."""
    share = F.col("strong_links") / F.nullif("n_links", F.lit(0))
    parts = (("baseline", F.lit(0.35)), ("strong links", F.round(0.45 * share + 1e-9, 2)), ("mean similarity", F.round(0.30 * F.col("mean_sim") + 1e-9, 2)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("points")) for k, v in parts]))
    return clusters.select("label", each.alias("p")).select("label", "p.part", "p.points")


def validated_parts(confidence: DataFrame) -> DataFrame:
    """(label, part, points) of a validated cluster's confidence: confidence(label, density, topology, evidence)."""
    parts = (("density", 0.40), ("topology", 0.35), ("evidence", 0.25))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.round(w * F.col(k) + 1e-9, 2).alias("points")) for k, w in parts]))
    return confidence.select("label", each.alias("p")).select("label", "p.part", "p.points")


def environment_split(members: DataFrame) -> DataFrame:
    """(id, label, environment, mixed): clusters of several environments fall into one part for each; signals without
    one go with the most frequent, of equal ones the first by name."""
    n = members.where("environment is not null").groupBy("label", "environment").agg(F.count("*").alias("n"))
    most = n.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("neg"), "environment"))["environment"].alias("most"), (
        F.count("*") > 1).alias("mixed"))
    out = members.join(most, "label", "left")
    return out.select("id", "label", F.coalesce("environment", "most").alias("environment"), F.coalesce("mixed", F.lit(False)).alias("mixed"))


def detail(metric: Column, value: Column, threshold: Column, message: Column, most: int = 110) -> Column:
    """What a signal says in one line: a metric with its value, or its message cut at `most` characters."""
    plain = lambda c: F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")
    limit = F.when(threshold.isNotNull(), F.concat(F.lit(" (threshold "), plain(threshold), F.lit(")"))).otherwise("")
    text = F.replace(F.trim(F.coalesce(message, F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, "…").otherwise(""))
    return F.when(metric.isNotNull() & value.isNotNull(), F.concat(metric, F.lit(" = "), plain(value), limit)).otherwise(cut)


def drafts(members: DataFrame, roots: DataFrame, telling: DataFrame) -> DataFrame:
    """(label, draft_id, title, facts): a draft of each cluster. telling(label, service, id) is the telling signal of each
    service. Facts are what was seen, without a word on causes."""
    what = members.select("id", F.coalesce("metric", F.substring(F.split("message", ":")[0], 1, 48)).alias("what"))
    lead = roots.join(telling.withColumnRenamed("service", "root"), ["label", "root"]).join(what, "id").select("label", "root", "what")
    told = members.withColumn("told", detail(F.col("metric"), F.col("value"), F.col("threshold"), F.col("message")))
    first, peak = F.min(F.struct("ts", "id", "service", "told")), F.min(F.struct((-F.col("anomaly_score")).alias("neg"), "ts", "id", "service", "told"))
    span = told.groupBy("label").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.countDistinct("service").alias("services"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.countDistinct("source").alias("n_sources"),
        first.alias("first"), peak.alias("peak"))
    clock = lambda c: F.date_format(F.timestamp_micros(c), "HH:mm:ss")
    others = F.when(F.col("services") > 1, F.concat(F.lit(" cascading to "), (F.col("services") - 1).cast("string"), F.lit(
        " service(s)"))).otherwise("")
    # fixed values: the wordings of titles and facts
    facts = F.array(
        F.concat(F.col("n").cast("string"), F.lit(" anomalous signals from "), F.col("n_sources").cast("string"), F.lit(" stream(s) ("),
                 "sources", F.lit(") between "), clock(F.col("started")), F.lit(" and "), clock(F.col("ended")), F.lit(" UTC.")),
        F.concat(F.lit("First signal: "), "first.service", F.lit(" - "), "first.told", F.lit(".")),
        F.concat(F.lit("Strongest anomaly: "), "peak.service", F.lit(" - "), "peak.told", F.lit(".")))
    out = lead.join(span, "label")
    return out.select(
        "label", F.concat(F.lit("draft-"), F.col("label").cast("string"), F.lit("-"), F.floor(F.col("started") / 1_000_000).cast(
            "string")).alias("draft_id"), F.concat(F.lit("[DRAFT] "), "root", F.lit(": "), "what", others).alias("title"),
        F.array_join(facts, "\n").alias("facts"))


def member_keys(members: DataFrame) -> DataFrame:
    """(label, members_key): a hash of the ids of each cluster, by which notes on one set of signals are given once. The
    hash is a sum over ids, so that no list of a cluster's ids is made."""
    one = F.conv(F.substring(F.sha1(F.col("id").cast("string")), 1, 12), 16, 10).cast("decimal(20,0)")
    key = F.concat_ws("-", F.count("*").cast("string"), F.sum(one).cast("string"))
    return members.groupBy("label").agg(key.alias("members_key"))
