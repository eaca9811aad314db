"""Known stories and what became of them: labels attached to signals by service and time, and scores against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECOY, DOMINATED = "decoy", 0.6


def attached(signals: DataFrame, labels: DataFrame, within: int) -> DataFrame:
    """signals(id, service, ts) with story, that of the label of its service nearest in time, at most `within` microseconds
    away; of equally near ones the earlier, then the first by story; null without one. Both are sorted together inside
    slots of time of a service, so no service is one group; labels near a slot's end stand in the next slot too."""
    slot = lambda c: F.floor(c / (4 * within))
    ends = F.array_distinct(F.array(slot(F.col("ts") - within), slot(F.col("ts")), slot(F.col("ts") + within)))
    marks = labels.where("service is not null and ts is not null").groupBy("service", "ts").agg(F.min("story").alias("story")).select(
        "service", F.explode(ends).alias("slot"), "ts", F.struct("ts", "story").alias("mark"), F.lit(None).cast("long").alias("id"))
    asked = signals.where("service is not null and ts is not null").select(
        "service", slot(F.col("ts")).alias("slot"), "ts", F.lit(None).cast("struct<ts:bigint,story:string>").alias("mark"), "id")
    order = Window.partitionBy("service", "slot").orderBy("ts")
    before = F.last("mark", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("mark", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    met = marks.unionByName(asked).withColumns({"before": before, "after": after}).where("id is not null")
    gap = lambda c: F.abs(F.col("ts") - F.col(f"{c}.ts"))
    pick = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    found = met.withColumn("near", pick).where(F.abs(F.col("ts") - F.col("near.ts")) <= within).select("id", "near.story")
    return signals.join(found, "id", "left")


def truth_scores(members: DataFrame, told: DataFrame, roots: DataFrame, story_roots: DataFrame) -> DataFrame:
    """One row of scores of incidents members(id, label) with roots(label, root) against told(id, story): pairs of labelled
    signals, purity, completeness, decoys that got in, incidents of several stories, stories over several incidents, and
    of the incidents that one story dominates how many have its root; story_roots(story, root). Decoys are no story.
    Pairs are counted from group sizes."""
    pairs = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))
    n, known = F.col("n"), told.where((F.col("story") != DECOY) & F.col("story").isNotNull())
    stories = known.groupBy("story").agg(F.count("*").alias("n"))
    cell = members.join(known, "id").groupBy("label", "story").agg(F.count("*").alias("n"))
    cluster = cell.groupBy("label").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("kinds"), F.min(
        F.struct((-n).alias("neg"), "story"))["story"].alias("story"))
    spread = cell.groupBy("story").agg(F.count("*").alias("incidents"), F.max("n").alias("most"))
    lead = cluster.where(F.col("most") >= DOMINATED * n).join(story_roots.select("story", F.col("root").alias("true_root")), "story").join(
        roots.select("label", "root"), "label", "left")
    decoys = told.where(F.col("story") == DECOY)
    one = [
        cell.agg(pairs(n).alias("correct")), cluster.agg(pairs(n).alias("predicted"), F.sum("most").alias("major"), F.sum("n").alias("placed"), F.count_if(
            F.col("kinds") > 1).alias("mixed_incidents")), stories.agg(pairs(n).alias("actual"), F.count("*").alias("stories")),
        stories.join(spread, "story", "left").agg(F.round(F.avg(F.coalesce("most", F.lit(0)) / n), 6).alias("completeness"), F.count_if(
            F.col("incidents") > 1).alias("split_stories")),
        decoys.agg(F.count("*").alias("decoys")), decoys.join(members.select("id"), "id").agg(F.count("*").alias("decoys_in")),
        lead.agg(F.count("*").alias("dominated"), F.count_if(F.col("root") == F.col("true_root")).alias("root_correct")),
        members.agg(F.countDistinct("label").alias("incidents")),
    ]  # one row each
    out = one[0]
    for x in one[1:]:
        out = out.join(F.broadcast(x), F.lit(True))
    p, r = F.try_divide("correct", "predicted"), F.try_divide("correct", "actual")
    return out.select(
        "stories", "incidents", "actual", "predicted", "correct", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(
            F.try_divide(2 * p * r, p + r), 6).alias("f1"), F.round(F.try_divide("major", "placed"), 6).alias("purity"), "completeness", "decoys",
        "decoys_in", "mixed_incidents", "split_stories", "dominated", "root_correct")
