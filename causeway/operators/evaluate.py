"""Scores of clusters against known truth, all from the contingency table of (cluster, story)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairs(n):
    return n * (n - 1) / 2


def pair_scores(table: DataFrame) -> DataFrame:
    """table(id, label, truth); null: in no cluster or no story. One row: precision, recall and F1 over pairs, and
    purity. Pairs are counted from group sizes, never made."""
    cell = table.where("label is not null and truth is not null").groupBy("label", "truth").agg(F.count("*").alias("n"))
    both = cell.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("both"))
    got = table.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("predicted"))
    want = table.where("truth is not null").groupBy("truth").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("actual"))
    pure = cell.groupBy("label").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(
        F.sum("m").alias("major"), F.sum("n").alias("placed"))
    p, r = F.try_divide("both", "predicted"), F.try_divide("both", "actual")
    out = both.join(got).join(want).join(pure)
    return out.select("both", "predicted", "actual", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                      F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"),
                      F.round(F.try_divide("major", "placed"), 6).alias("purity"))


def story_scores(table: DataFrame) -> DataFrame:
    """(truth, n, clusters, best, completeness): how whole each story is."""
    cell = table.where("truth is not null").groupBy("truth", "label").agg(F.count("*").alias("n"))
    known = F.col("label").isNotNull()
    return cell.groupBy("truth").agg(
        F.sum("n").alias("n"), F.sum(known.cast("int")).alias("clusters"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("best")).withColumn(
        "completeness", F.round(F.col("best") / F.col("n"), 6))


def mixed_clusters(table: DataFrame, least: float = 0.6) -> DataFrame:
    """(label, n, stories, majority, dominated): whether one story has at least `least` of a cluster."""
    cell = table.where("label is not null").groupBy("label", "truth").agg(F.count("*").alias("n"))
    out = cell.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.col("truth").isNotNull().cast("int")).alias("stories"),
                                    F.coalesce(F.max(F.when(F.col("truth").isNotNull(), F.col("n"))), F.lit(0)).alias("majority"))
    return out.withColumn("dominated", F.col("majority") >= least * F.col("n"))


def reliability(table: DataFrame) -> DataFrame:
    """table(confidence, purity): for each tenth of confidence, count, mean confidence and mean purity."""
    decile = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")
    return table.groupBy(decile.alias("decile")).agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("purity"), 6).alias("purity"))


def sweep(table: DataFrame) -> DataFrame:
    """table(config, seed, f1): mean, median and worst of each configuration."""
    return table.groupBy("config").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.median("f1"), 6).alias("median_f1"),
                                       F.round(F.min("f1"), 6).alias("worst_f1"))


def first_by(table: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
