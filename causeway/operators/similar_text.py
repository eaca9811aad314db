"""Text mining for the alert library: TF-IDF, cosine, library match, three-neighbour density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .components import components


def terms(texts: DataFrame) -> DataFrame:
    """(id, term, tf): words of two or more characters and pairs of neighbours, lower case."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]{2,})"), 1)
    t = texts.select("id", words.alias("w"))
    grams = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice(
        "w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return t.select("id", F.explode(F.concat("w", grams)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf(texts: DataFrame) -> DataFrame:
    """(id, term, weight): smooth idf ln((1 + n) / (1 + df)) + 1, rows of length 1."""
    t = terms(texts)
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("docs"))  # one row
    w = t.join(df, "term").join(F.broadcast(n), F.lit(True)).withColumn(
        "w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, cosine) of rows that share a term: an equi-join on terms, summed by pair."""
    met = left.select(F.col("id").alias("a"), "term", F.col("weight").alias("x")).join(
        right.select(F.col("id").alias("b"), "term", F.col("weight").alias("y")), "term")
    return met.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def library_match(words: DataFrame, library: DataFrame, least: float = 0.40) -> DataFrame:
    """words(label, word) against library(item, word): the item of which the largest share of words is covered."""
    size = library.groupBy("item").agg(F.count("*").alias("size"))
    hit = words.distinct().join(library, "word").groupBy("label", "item").agg(F.count("*").alias("n"))
    cover = hit.join(size, "item").withColumn("coverage", F.round(F.col("n") / F.col("size"), 6)).where(
        F.col("coverage") >= least)
    best = Window.partitionBy("label").orderBy(F.desc("coverage"), "item")
    return cover.withColumn("r", F.row_number().over(best)).where("r = 1").select("label", "item", "coverage")


def time_penalty(gap_minutes, minutes: float = 6.0):
    return 2 * F.pow(F.least(gap_minutes / minutes, F.lit(1.0)), 2)


def density_clusters(edges: DataFrame, nodes: DataFrame, min_samples: int = 3) -> DataFrame:
    """(id, label): DBSCAN over neighbour pairs edges(a, b). A core has min_samples neighbours with itself; clusters are
    the components of cores; a border row joins the cluster with the smallest core; others get -1."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"), "neighbours")  # read several times
    core = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples - 1).select(F.col("a").alias("core"))
    inner = both.join(core, both.a == core.core, "left_semi").join(core, both.b == F.col("core"), "left_semi")
    label = components(inner).union(core.join(inner, core.core == inner.a, "left_anti").select("core", "core")).toDF("id", "label")
    border = both.join(label, both.b == label.id).join(core, both.a == core.core, "left_anti").groupBy("a").agg(
        F.min("label").alias("label"))
    known = label.union(border.select("a", "label"))
    return nodes.select("id").join(known, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
