"""Clusters that hold more than one independent cause fall apart along them.

What is compared are distinct descriptions (service, component, mention, template, words) of a cluster, not signals, so
repeats cost nothing. Only the greedy choice of causes runs in Python, on a row for each service of a cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, name_tokens, tokens
from .causal import AGREEMENT
from .topology import closeness


def described(members: DataFrame) -> DataFrame:
    """members with words, their comparable vocabulary."""
    return members.withColumn("words", tokens(F.col("message"), F.col("metric"), F.col("component")))


def agreements(members: DataFrame) -> DataFrame:
    """(label, one, other): pairs of services of a cluster that describe one failure: one names the other, both report
    one component, or their closest descriptions are alike by AGREEMENT."""
    d = described(members).select("label", "service", F.lower("component").alias("component"), "mention", "template", "words").distinct()
    a, b = d.alias("a"), d.alias("b")
    pair = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.service") < F.col("b.service")))
    named = (F.col("a.mention") == F.col("b.service")) | (F.col("b.mention") == F.col("a.service"))
    same = F.col("a.template") == F.col("b.template")
    alike = named | (F.col("a.component") == F.col("b.component")) | same | (jaccard(F.col("a.words"), F.col("b.words")) >= AGREEMENT)
    hit = pair.where(F.coalesce(named, F.lit(False)) | F.coalesce(alike, F.lit(False))).select(
        F.col("a.label").alias("label"), F.col("a.service").alias("one"), F.col("b.service").alias("other")).distinct()
    return hit.union(hit.select("label", "other", "one"))


def centres(scored: DataFrame, agreed: DataFrame, dependents: DataFrame) -> DataFrame:
    """(label, centre, k): causes in order of rank: services that agree with none of the failing services that could
    explain them, and with no centre before them."""
    explainer = scored.select("label", F.col("service").alias("x")).join(
        dependents.select(F.col("service").alias("x"), F.col("dependent").alias("service")), "x")
    symptom = explainer.join(agreed.select("label", F.col("one").alias("service"), F.col("other").alias("x")), [
        "label", "service", "x"]).select("label", "service").distinct()
    roots = scored.join(symptom, ["label", "service"], "left_anti").select("label", "service", "rank_score")

    def greedy(key: tuple, own: pd.DataFrame, agree: pd.DataFrame) -> pd.DataFrame:
        near = set(zip(agree["one"], agree["other"], strict=True))
        chosen: list[str] = []
        for s in own.sort_values(["rank_score", "service"], ascending=[False, True])["service"]:
            if all((s, c) not in near for c in chosen):
                chosen.append(s)
        return pd.DataFrame({"label": key[0], "centre": chosen, "k": range(len(chosen))})

    pairs = agreed.select(F.col("label").alias("of"), "one", "other")
    return roots.groupBy("label").cogroup(pairs.groupBy("of")).applyInPandas(greedy, "label long, centre string, k int")


def split(members: DataFrame, scored: DataFrame, dependents: DataFrame, hops: DataFrame) -> DataFrame:
    """(id, label, centre): the cause each signal belongs to, for clusters with two or more that keep signals: 0.50
    evidence + 0.30 shared trace + 0.15 closeness + 0.05 same service, the first best centre wins. Other clusters have a
    null centre."""
    m = described(members)
    found = centres(scored, agreements(members), dependents)
    several = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    found = found.join(several, "label")
    own = m.join(found.select("label", F.col("centre").alias("service"), "k"), ["label", "service"])
    core = own.groupBy("label", F.col("service").alias("centre"), "k").agg(
        F.array_union(F.array_distinct(F.flatten(F.collect_set("words"))), name_tokens(F.first("service"))).alias("vocabulary"),
        F.collect_set("words").alias("descriptions"), F.collect_set("template").alias("templates"), F.collect_set("trace_id").alias("traces"))
    mine = F.array_union("words", name_tokens(F.col("service")))
    pair = m.join(core, "label").withColumn("mine", mine)
    near = hops.select(F.col("a").alias("ha"), F.col("b").alias("hb"), "hops")
    pair = pair.join(near, (F.col("service") == F.col("ha")) & (F.col("centre") == F.col("hb")), "left")
    direct = F.when(F.array_contains("templates", F.col("template")), 1.0).otherwise(F.coalesce(F.array_max(F.transform(
        "descriptions", lambda d: jaccard(d, F.col("words")))), F.lit(0.0)))
    overlap = F.when(F.size("mine") > 0, F.size(F.array_intersect("mine", "vocabulary")) / F.size("mine")).otherwise(0.0)
    same = (F.col("service") == F.col("centre")).cast("double")
    trace = F.coalesce(F.array_contains("traces", F.col("trace_id")).cast("double"), F.lit(0.0))
    score = F.round(0.30 * trace + 0.50 * F.greatest(direct, overlap) + 0.15 * closeness(F.col("hops")) + 0.05 * same, 9)
    best = Window.partitionBy("label", "id").orderBy(F.desc("score"), "k")
    placed = pair.withColumn("score", score).withColumn("r", F.row_number().over(best)).where("r = 1").select("label", "id", "centre")
    kept = placed.groupBy("label").agg(F.countDistinct("centre").alias("n")).where("n > 1").select("label")
    return members.select("id", "label").join(placed.join(kept, "label"), ["label", "id"], "left").select("id", "label", "centre")
