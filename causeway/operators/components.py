"""Connected components by spreading the smallest label; lineage is cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, label) for every id of edges(a, b); label is the smallest id reachable. Labels also jump to their own
    label's label, so rounds grow slowly with the diameter. Labels that don't settle in `rounds` are an error."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    now = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "cc")
    for _ in range(rounds):
        jump = now.select(F.col("id").alias("jid"), F.col("label").alias("jlabel"))
        low = both.join(now, both.b == now.id).groupBy("a").agg(F.min("label").alias("low"))
        new = now.join(low, now.id == low.a).select("id", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        new = new.join(jump, F.col("label") == F.col("jid")).select("id", F.least("label", "jlabel").alias("label"), "old")
        new = written(new, "cc")
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        now = new.select("id", "label")
    raise RuntimeError(f"components: not settled after {rounds} rounds")
