"""Risk and forecast figures of the offline alert view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def escalation_risk(members: DataFrame) -> DataFrame:
    """(label, growth, severity_trend, spread, risk): 0.40 growth + 0.35 severity trend + 0.25 service spread. Severity
    counts 1 (critical) to 0; the trend adds 0.4 of the change from the first to the last third."""
    w = Window.partitionBy("label").orderBy("ts", "id")
    sev = 1 - F.col("sev_rank") / 3
    m = members.select("label", "service", "ts", sev.alias("sev"), F.row_number().over(w).alias("k"), F.count("*").over(
        Window.partitionBy("label")).alias("n"))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    a = m.groupBy("label").agg(
        F.max("n").alias("n"), ((F.max("ts") - F.min("ts")) / 6e7).alias("minutes"), F.avg("sev").alias("mean"),
        F.avg(F.when(F.col("k") <= third, F.col("sev"))).alias("head"),
        F.avg(F.when(F.col("k") > F.col("n") - third, F.col("sev"))).alias("tail"), F.countDistinct("service").alias("s"))
    one = F.lit(1.0)
    growth = F.least(F.col("n") / F.greatest("minutes", F.lit(0.5)) / 5, one)
    trend = F.when(F.col("n") < 3, F.col("mean")).otherwise(
        F.least(F.greatest(F.col("mean") + 0.4 * (F.col("tail") - F.col("head")), F.lit(0.0)), one))
    spread = F.least(F.col("s") / 5, one)
    return a.select("label", F.round(growth, 6).alias("growth"), F.round(trend, 6).alias("severity_trend"), F.round(
        spread, 6).alias("spread"), F.round(0.40 * growth + 0.35 * trend + 0.25 * spread, 6).alias("risk"))


def stratified_sample(rows: DataFrame, stratum: str, budget: int, whole: int = 500) -> DataFrame:
    """Evenly spaced rows of each stratum: small strata whole, the rest in proportion to the square root of their size.
    A sampling operator: the budget is its purpose."""
    w = Window.partitionBy(stratum)
    n = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    root = n.where(F.col("n") > whole).agg(F.sum(F.sqrt("n")).alias("roots"))
    small = n.where(F.col("n") <= whole).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("taken"))
    take = F.when(F.col("n") <= whole, F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.lit(1), F.floor(
        (budget - F.col("taken")) * F.sqrt("n") / F.col("roots")))))
    plan = n.join(root).join(small).select(stratum, F.col("n").alias("size"), take.cast("long").alias("take"))
    at = rows.withColumn("k", F.row_number().over(w.orderBy("ts", "id"))).join(plan, stratum)
    pick = F.floor(F.col("k") * F.col("take") / F.col("size")) > F.floor((F.col("k") - 1) * F.col("take") / F.col("size"))
    return at.where(pick).drop("k", "size", "take")


def forecast(members: DataFrame, reach: DataFrame) -> DataFrame:
    """(label, horizon, services): failing services now and those that would follow in 5, 10 and 15 minutes, one call
    further every 5 minutes. reach(service, dependent, hops)."""
    now = members.select("label", "service").distinct()
    far = now.join(reach, "service").select("label", F.col("dependent").alias("service"), "hops").join(
        now, ["label", "service"], "left_anti").groupBy("label", "service").agg(F.min("hops").alias("hops"))
    have = now.groupBy("label").agg(F.count("*").alias("have"))
    grid = have.select("label", "have", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("step"))
    more = far.groupBy("label", "hops").agg(F.count("*").alias("n"))
    got = grid.join(more, "label", "left").groupBy("label", "step", "have").agg(
        F.coalesce(F.sum(F.when(F.col("hops") <= F.col("step"), F.col("n"))), F.lit(0)).alias("more"))
    return got.select("label", (F.col("step") * 5).alias("minutes"), (F.col("have") + F.col("more")).alias("services"))
