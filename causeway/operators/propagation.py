"""How an incident went from service to service, and the service graph that incidents themselves suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def propagation(scored: DataFrame, roots: DataFrame) -> DataFrame:
    """(label, place, service, from): each incident's services from its root outwards, breadth first along symptom_of, those
    that failed earlier first, then by name; services that no chain reaches follow by time, without a from. scored(label,
    service, onset, symptom_of), roots(label, root). A round of joins for each step outwards, all incidents at once: a
    service's place is its chain of (onset, service), the shortest, of equal ones the first."""
    own = F.struct("onset", "service")
    base = written(scored.select("label", "service", "onset", F.coalesce("symptom_of", F.array().cast("array<string>")).alias("symptom_of")), "services")
    step = base.select("label", "service", "onset", F.explode("symptom_of").alias("from"))
    level = base.join(roots.select("label", F.col("root").alias("service")), ["label", "service"]).select(
        "label", "service", F.lit(None).cast("string").alias("from"), F.array(own).alias("chain"))
    level = written(level, "chain")
    reached = level
    while not level.isEmpty():
        ends = level.select("label", F.col("service").alias("from"), "chain")
        more = step.join(ends, ["label", "from"]).join(reached.select("label", "service"), ["label", "service"], "left_anti")
        first = more.groupBy("label", "service").agg(F.min(F.struct("chain", "from", own.alias("own"))).alias("m"))
        level = written(first.select("label", "service", F.col("m.from").alias("from"), F.concat("m.chain", F.array("m.own")).alias("chain")), "chain")
        reached = reached.unionByName(level)
    left = base.join(reached.select("label", "service"), ["label", "service"], "left_anti").select(
        "label", "service", F.lit(None).cast("string").alias("from"), F.array(own).alias("chain"), F.lit(1).alias("late"))
    every = reached.withColumn("late", F.lit(0)).unionByName(left)
    place = F.row_number().over(Window.partitionBy("label").orderBy("late", F.size("chain"), "chain"))
    return every.select("label", place.alias("place"), "service", "from")


def derived_edges(members: DataFrame, roots: DataFrame, risk: DataFrame) -> DataFrame:
    """(source, target, label): for every two services that an incident ties, its root and another, the edge of the riskiest
    such incident, of equal ones the first. risk(label, score)."""
    services = members.select("label", F.col("service").alias("target")).distinct()
    tied = services.join(roots.select("label", F.col("root").alias("source")), "label").where(F.col("source") != F.col("target")).join(
        risk.select("label", "score"), "label")
    best = F.min(F.struct((-F.col("score")).alias("neg"), "label", "source", "target")).alias("m")
    return tied.groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(best).select(
        "m.source", "m.target", "m.label")


def derived_nodes(stats: DataFrame, members: DataFrame, roots: DataFrame, risk: DataFrame, high: float = 0.7) -> DataFrame:
    """(service, label, is_root, error_rate, status) of every service of stats(service, n, severe) and every root: its
    riskiest incident; critical where it is that incident's root or the risk is high, warning in any other, else healthy."""
    held = members.select("label", "service").distinct().join(risk.select("label", "score"), "label")
    top = held.groupBy("service").agg(F.min(F.struct((-F.col("score")).alias("neg"), "label")).alias("m"))
    top = top.select("service", "m.label", (-F.col("m.neg")).alias("score")).join(roots.select("label", "root"), "label", "left")
    every = stats.select("service").union(roots.select("root")).distinct()
    out = every.join(stats, "service", "left").join(top, "service", "left")
    root = F.coalesce(F.col("root") == F.col("service"), F.lit(False))
    status = F.when(F.col("label").isNull(), "healthy").when(root | (F.col("score") >= high), "critical").otherwise("warning")
    rate = F.coalesce(F.round(100 * F.try_divide(F.col("severe"), F.col("n"))), F.lit(0.0)).cast("int")
    return out.select("service", "label", root.alias("is_root"), rate.alias("error_rate"), status.alias("status"))
