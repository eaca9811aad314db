"""The service graph: hop distances, dependents and dependencies, call paths, reach without a service. All are joins, in
rounds that are written tables where the depth isn't known; nothing of the graph comes to the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

CLOSENESS = {0: 1.0, 1: 0.75, 2: 0.45, 3: 0.15}


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("caller").alias("a"), F.col("callee").alias("b"))
    return both.union(both.select("b", "a")).where("a <> b").distinct().toDF("a", "b")


def hops(edges: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, hops) of all pairs at most `most` calls apart in either direction, itself included at 0."""
    step = undirected(edges)
    seen = edges.select(F.explode(F.array("caller", "callee")).alias("a")).distinct().select(
        "a", F.col("a").alias("b"), F.lit(0).alias("hops"))
    reach = seen
    for k in range(1, most + 1):
        nxt = step.withColumnRenamed("b", "c").withColumnRenamed("a", "m")
        reach = reach.join(nxt, reach.b == nxt.m).select("a", F.col("c").alias("b"), F.lit(k).alias("hops")).distinct()
        seen = seen.union(reach)
    return seen.groupBy("a", "b").agg(F.min("hops").alias("hops"))


def closeness(hop: Column) -> Column:
    return reduce(lambda c, kv: c.when(hop == kv[0], kv[1]), CLOSENESS.items(), F.when(hop.isNull(), 0.0)).otherwise(0.0)


def _closed(start: DataFrame, step: DataFrame, key: list[str], at: str, name: str) -> DataFrame:
    """start(*key, at) with all that steps (at, next) reach; only what a round finds anew is joined again."""
    known = new = written(start.distinct(), name)
    columns = [*key, at]
    while True:
        more = new.join(step, at).select(*key, F.col("next").alias(at)).distinct()
        if "removed" in key:
            more = more.where(F.col(at) != F.col("removed"))
        new = written(more.join(known, columns, "left_anti").select(*columns), name)
        if new.isEmpty():
            return known
        known = known.union(new)


def _callers(edges: DataFrame) -> DataFrame:
    """(service, next): who calls a service."""
    return edges.where("caller <> callee").select(F.col("callee").alias("at"), F.col("caller").alias("next")).distinct()


def dependents(edges: DataFrame) -> DataFrame:
    """(service, dependent): who transitively calls a service."""
    step = _callers(edges)
    start = step.select(F.col("at").alias("service"), F.col("next").alias("at"))
    found = _closed(start, step, ["service"], "at", "dependents")
    return found.where(F.col("service") != F.col("at")).select("service", F.col("at").alias("dependent"))


def dependencies(edges: DataFrame) -> DataFrame:
    """(service, dependency): whom a service transitively calls."""
    turned = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return dependents(turned).withColumnRenamed("dependent", "dependency")


def explained_without(services: DataFrame, edges: DataFrame) -> DataFrame:
    """services(label, service): (label, removed, dependent) for each service of a label removed from the graph: what
    the label's other services still reach among their callers. Only services of labels are removed."""
    step = _callers(edges)
    one = services.select("label", F.col("service").alias("removed"))
    other = services.select("label", F.col("service").alias("from"))
    start = one.join(other, "label").where(F.col("from") != F.col("removed")).select(
        "label", "removed", F.col("from").alias("at")).distinct()
    first = start.join(step, "at").where(F.col("next") != F.col("removed")).select("label", "removed", F.col("next").alias("at"))
    return _closed(first, step, ["label", "removed"], "at", "explained").withColumnRenamed("at", "dependent")


def call_paths(edges: DataFrame, most: int = 6) -> DataFrame:
    """(caller, callee, path): the shortest chain of calls of at most `most` steps; of equal ones the first by names."""
    calls = edges.where("caller <> callee").select("caller", "callee").distinct()
    paths = now = calls.select("caller", "callee", F.array("caller", "callee").alias("path"))
    for _ in range(most - 1):
        more = now.join(calls.select(F.col("caller").alias("callee"), F.col("callee").alias("next")), "callee")
        more = more.where(~F.array_contains("path", F.col("next"))).select(
            "caller", F.col("next").alias("callee"), F.concat("path", F.array("next")).alias("path"))
        now = more.groupBy("caller", "callee").agg(F.min("path").alias("path"))
        paths = paths.union(now)
    return paths.groupBy("caller", "callee").agg(F.min(F.struct(F.size("path").alias("n"), "path"))["path"].alias("path"))
