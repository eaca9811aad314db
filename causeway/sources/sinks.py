"""Writers: recorder, upserts, incident archive, tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Upsert by key: the row with the highest order (several columns: the first that differs) wins, new over old at ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order], F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def archive_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(draft_id, action): raised the first time, updated only where signal_count grew."""
    j = new.select("draft_id", F.col("signal_count").alias("n")).join(
        old.select("draft_id", F.col("signal_count").alias("o")), "draft_id", "left")
    action = F.when(F.col("o").isNull(), "raised").when(F.col("n") > F.col("o"), "updated")
    return j.select("draft_id", action.alias("action")).where("action is not null")


def latest_decisions(events: DataFrame) -> DataFrame:
    """The last decision on each draft, in order of seq."""
    return events.groupBy("draft_id").agg(F.max(F.struct("seq", "action", "actor", "note")).alias("d")).select("draft_id", "d.*")


def tickets(drafts: DataFrame, last_number: int) -> DataFrame:
    """drafts with ticket keys that go on from last_number, one for each draft however often it comes. Approvals are a
    person's clicks: the ordered step sees as many rows."""
    once = drafts.dropDuplicates(["draft_id"])
    n = F.row_number().over(Window.orderBy("draft_id")) + last_number
    return once.withColumn("ticket_key", F.format_string("TKT-%04d", n))


def record(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of redacted events to a folder of JSON lines."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def bounded_feed(rows: DataFrame, newest: int = 5000) -> DataFrame:
    """The newest rows by arrival, of equal ones those with the higher id: the feed's own limit."""
    return rows.orderBy(F.desc("arrival"), *([F.desc("id")] if "id" in rows.columns else [])).limit(newest)
