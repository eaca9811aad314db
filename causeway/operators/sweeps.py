"""What incidents would be under other thresholds and weights, without linking all pairs anew for each.

Thresholds: clusters at a threshold are the components of pairs at least so alike, and these are the same for the pairs of
a maximum spanning forest. It is grown once (Boruvka: each component takes its strongest pair to another, components
merge, until none is left), has fewer pairs than signals, and is all that any threshold needs.

Weights: the terms of a pair don't depend on weights, so sets of weights are rows, met with one table of pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .components import components
from .pairs import EPS, WEIGHTS


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """(a, b, w) of a maximum spanning forest of pairs(a, b, w); of equal pairs the one with the smaller ids. Rounds grow
    with the logarithm of the number of nodes. Null ends and loops are left out."""
    able = pairs.where("a is not null and b is not null and a <> b and w is not null")
    left = able.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
    left = written(left.select("a", "b", "w", F.col("a").alias("la"), F.col("b").alias("lb")), "forest-pairs")
    forest = left.select("a", "b", "w").limit(0)
    while not left.isEmpty():
        ends = left.select(F.col("la").alias("of"), "*").union(left.select(F.col("lb").alias("of"), "*"))
        best = ends.groupBy("of").agg(F.min(F.struct((-F.col("w")).alias("neg"), "a", "b", "la", "lb")).alias("m"))
        taken = written(best.select("m.a", "m.b", (-F.col("m.neg")).alias("w"), "m.la", "m.lb").distinct(), "forest-taken")
        forest = forest.union(taken.select("a", "b", "w"))
        merged = components(taken.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        new = lambda side: merged.select(F.col("id").alias(side), F.col("label").alias(f"new_{side}"))  # noqa: B023, E731
        moved = left.join(new("la"), "la").join(new("lb"), "lb").where("new_la <> new_lb")
        # of several pairs between two components only the strongest can be taken
        one = moved.groupBy(F.least("new_la", "new_lb").alias("la"), F.greatest("new_la", "new_lb").alias("lb")).agg(
            F.min(F.struct((-F.col("w")).alias("neg"), "a", "b")).alias("m"))
        left = written(one.select("m.a", "m.b", (-F.col("m.neg")).alias("w"), "la", "lb"), "forest-pairs")
    return forest


def clusters_of(links: DataFrame) -> DataFrame:
    """(config, id, label) of links(config, a, b): the components of each configuration, all at once."""
    node = lambda c: F.struct("config", F.col(c).alias("id"))
    found = components(links.select(node("a").alias("a"), node("b").alias("b")))
    return found.select("id.config", "id.id", F.col("label.id").alias("label"))


def at_thresholds(forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(config, id, label): clusters of pairs at least so alike; config is the threshold in hundredths."""
    steps = F.array(*[F.lit(round(100 * t)) for t in thresholds])
    # similarities have six decimals
    met = F.filter(steps, lambda t: F.round(F.col("w") * 1e6).cast("long") >= t.cast("long") * 10_000)
    return clusters_of(forest.select(F.explode(met).alias("config"), "a", "b"))


def variants(weights: dict[str, float] = WEIGHTS) -> list[tuple[str, dict[str, float]]]:
    """The weights as they are, and each with one dimension left out."""
    return [("all", weights), *[(f"without {k}", {**weights, k: 0.0}) for k in weights]]


def under_weights(pairs: DataFrame, sets: list[tuple[str, dict[str, float]]], eps: float = EPS) -> DataFrame:
    """(config, id, label): clusters of pairs(a_id, b_id, *_term) under each set of weights."""
    total = lambda w: F.round(sum((v * F.col(f"{k}_term") for k, v in w.items()), F.lit(0.0)), 6)
    each = F.array(*[F.struct(F.lit(name).alias("config"), total(w).alias("sim")) for name, w in sets])
    met = pairs.select("a_id", "b_id", F.explode(F.filter(each, lambda x: (1 - x["sim"]) <= eps)).alias("x"))
    return clusters_of(met.select("x.config", F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def by_time_alone(signals: DataFrame, eps: float = EPS) -> DataFrame:
    """(id, label): clusters of signals that are near in time, whatever they are about: runs in which each signal follows
    the one before by so little that their proximity exp(-minutes) is at least 1 - eps. The runs of a line need no pairs:
    each is found inside its slot of time, and slots, one row each, are joined where the gap between them is small."""
    limit = math.floor(-math.log(1 - eps) * 6e7)
    slot = F.floor(F.col("ts") / 3_600_000_000)
    rows = signals.select("id", "ts", slot.alias("slot"))
    span = rows.groupBy("slot").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    before = F.lag("hi").over(Window.orderBy("slot"))  # a row for each hour
    inside = Window.partitionBy("slot").orderBy("ts", "id")
    rows = rows.join(span.select("slot", before.alias("before")), "slot")
    gap = F.col("ts") - F.coalesce(F.lag("ts").over(inside), F.col("before"))
    rows = written(rows.withColumn("starts", F.coalesce(gap > limit, F.lit(True)).cast("int")), "runs")
    upto = rows.groupBy("slot").agg(F.sum("starts").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(upto.select("slot", base.alias("base")), "slot").withColumn(
        "run", F.col("base") + F.sum("starts").over(inside))
    label = rows.groupBy("run").agg(F.min("id").alias("label"), F.count("*").alias("n")).where("n > 1")
    return rows.join(label, "run").select("id", "label")


def scores(truth: DataFrame, clusters: DataFrame, *by: str) -> DataFrame:
    """(config, *by, precision, recall, f1, purity): clusters(config, id, label) against truth(id, truth, *by) over pairs
    inside one value of by, counted from group sizes. A configuration without clusters gives no row."""
    pairs = lambda n: n * (n - 1) / 2
    placed = clusters.join(truth, "id")
    key = ["config", *by]
    size = lambda df, *more: df.groupBy(*key, *more).agg(F.count("*").alias("n"))
    known = size(placed.where("truth is not null"), "label", "truth")
    both = known.groupBy(*key).agg(F.sum(pairs(F.col("n"))).alias("both"))
    got = size(placed, "label").groupBy(*key).agg(F.sum(pairs(F.col("n"))).alias("predicted"))
    want = truth.where("truth is not null").groupBy(*by, "truth").agg(F.count("*").alias("n"))
    want = want.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("actual"))
    pure = known.groupBy(*key, "label").agg(F.max("n").alias("m"), F.sum("n").alias("n")).groupBy(*key).agg(
        F.sum("m").alias("major"), F.sum("n").alias("placed"))
    out = got.join(both, key, "left").join(pure, key, "left")
    out = out.join(want, list(by), "left") if by else out.join(F.broadcast(want), F.lit(True), "left")  # one row
    p, r = F.try_divide(F.coalesce("both", F.lit(0.0)), "predicted"), F.try_divide(F.coalesce("both", F.lit(0.0)), "actual")
    return out.select(*key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(
        2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), F.round(F.try_divide("major", "placed"), 6).alias("purity"))
