"""Tickets of approved drafts: their prose and lines, keys that go on from those that exist, comments, and the event log.

A ticket's lines are rows (label, place, line), as its timeline may be of any length; a reader joins those of one ticket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import detail
from .review_tables import numbered


def prose(members: DataFrame, roots: DataFrame, telling: DataFrame, impact: DataFrame) -> DataFrame:
    """(label, summary, hypothesis, steps): what is told of an incident where nobody else tells it. The hypothesis says that
    it is one. Wordings are fixed values."""
    s = lambda c: F.col(c).cast("string")
    others = F.filter("services", lambda x: x != F.col("root"))
    three = F.array_join(F.slice(others, 1, 3), ", ")
    size = members.groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("service")).alias("services"))
    lead = members.select("id", "metric", "threshold", F.date_format(F.timestamp_micros("ts"), "HH:mm:ss").alias("at"), detail(
        F.col("metric"), F.col("value"), F.col("threshold"), F.col("message")).alias("told"))
    own = roots.join(telling.withColumnRenamed("service", "root"), ["label", "root"]).join(lead, "id")
    out = own.join(size, "label").join(impact.select("label", "priority"), "label")
    summary = F.concat(s("n"), F.lit(" correlated signals across "), F.size("services").cast("string"), F.lit(" service(s), scored "), "priority", F.lit(
        ". Causal analysis points to "), "root", F.when(F.size(others) > 0, F.concat(F.lit(", with knock-on failures in "), three)).otherwise(""), F.lit("."))
    hypothesis = F.concat(F.lit("Suspected: "), "root", F.lit(" ("), "told", F.lit(", first seen "), "at", F.lit(
        "). Selected by counterfactual analysis over the dependency graph ("), F.round(100 * F.col("causal_confidence")).cast("int").cast("string"), F.lit(
        "% causal confidence); unconfirmed until checked on the service."))
    plain = F.regexp_replace(F.format_string("%.2f", "threshold"), r"\.?0+$", "")
    against = F.when(F.col("threshold").isNotNull(), F.concat(F.lit(" against its threshold ("), plain, F.lit(")"))).otherwise("")
    steps = F.array_compact(F.array(
        F.concat(F.lit("Inspect "), "root", F.lit(" first: causal analysis identifies it as the origin.")),
        F.when(F.col("metric").isNotNull(), F.concat(F.lit("Check "), "metric", F.lit(" on "), "root", against, F.lit("."))),
        F.when(F.size(others) > 0, F.concat(F.lit("Confirm "), three, F.lit(" recover once "), "root", F.lit(
            " is healthy; if they do not, there is a second independent fault.")))))
    return out.select("label", summary.alias("summary"), hypothesis.alias("hypothesis"), steps.alias("steps"))


def lines(members: DataFrame, drafts: DataFrame, told: DataFrame, impact: DataFrame) -> DataFrame:
    """(label, place, line): each ticket in Markdown, from its title to its steps."""
    head = drafts.join(told, "label").join(impact.select("label", "severity", "priority"), "label")
    fixed = lambda *parts: F.array(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    first = fixed(
        F.concat(F.lit("# "), "title"), "", F.concat(F.lit("**Severity:** "), "priority", F.lit(" - impact "), F.round(100 * F.col("severity")).cast("int").cast(
            "string"), F.lit("/100")), "", "## Summary (observed)", F.col("summary"), "", "## Facts")
    facts = F.transform(F.split("facts", "\n"), lambda x: F.concat(F.lit("- "), x))
    table = fixed("", "## Timeline", "| time (UTC) | source | service | evidence |", "|---|---|---|---|")
    steps = F.transform("steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    last = F.concat(fixed("", "## Suspected root cause (hypothesis, not confirmed)", F.col("hypothesis"), "", "## Investigation steps"), steps)
    before = head.select("label", F.posexplode(F.concat(first, facts, table)).alias("k", "line")).select("label", F.lit(0).alias("part"), F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("id"), "line")
    after = head.select("label", F.posexplode(last).alias("k", "line")).select("label", F.lit(2).alias("part"), F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("id"), "line")
    what = F.replace(detail(F.col("metric"), F.col("value"), F.col("threshold"), F.col("message")), F.lit("|"), F.lit("/"))
    times = F.when(F.col("occurrence_count") > 1, F.concat(F.lit(" (x"), F.col("occurrence_count").cast("string"), F.lit(")"))).otherwise("")
    row = F.concat(F.lit("| "), F.date_format(F.timestamp_micros("ts"), "HH:mm:ss"), F.lit(" | "), "source", F.lit(" | "), "service", F.lit(" | "), what, times, F.lit(" |"))
    timeline = members.join(head.select("label"), "label", "left_semi").select("label", F.lit(1).alias("part"), F.col("ts").alias("k"), "id", row.alias("line"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("part", "k", "id"))
    return before.union(timeline).union(after).select("label", place.alias("place"), "line")


def issued(tickets: DataFrame, approved: DataFrame) -> DataFrame:
    """New rows (draft_id, number, key) for approved(draft_id) drafts that have no ticket in tickets(draft_id, number, key) yet,
    each once however often it is approved; numbers go on from the highest."""
    new = approved.select("draft_id").distinct().join(tickets.select("draft_id"), "draft_id", "left_anti")
    last = tickets.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))  # one row
    out = numbered(new, "place", "draft_id").join(F.broadcast(last), F.lit(True)).withColumn("number", F.col("last") + F.col("place"))
    return out.select("draft_id", F.col("number").cast("long").alias("number"), F.format_string("TKT-%04d", F.col("number").cast("long")).alias("key"))


def commented(tickets: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comments with their ticket's key, refused): comments(draft_id, at, body) only extend what was published."""
    done = comments.join(tickets.select("draft_id", "key"), "draft_id").select("key", "draft_id", "at", "body")
    return done, comments.join(tickets.select("draft_id"), "draft_id", "left_anti")


class EventLog:
    """Events in the order in which they were added: one folder for each lot, never rewritten. One writer at a time."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def _lots(self, spark) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit())

    def add(self, events: DataFrame, *order: Column | str) -> None:
        """Append events(kind, payload, ...) in an order; their seq goes on from the last."""
        spark = events.sparkSession
        lots = self._lots(spark)
        last = self.load(spark).agg(F.max("seq")).first()[0] or 0 if lots else 0
        rows = numbered(events, "place", *order).select((F.lit(last) + F.col("place")).cast("long").alias("seq"), "kind", "payload")
        rows.write.parquet(f"{self.folder}/{(lots[-1] + 1) if lots else 0}")

    def load(self, spark) -> DataFrame:
        """(seq, kind, payload); order by seq to replay."""
        lots = self._lots(spark)
        if not lots:
            return spark.createDataFrame([], "seq long, kind string, payload string")
        return spark.read.schema("seq long, kind string, payload string").parquet(*[f"{self.folder}/{k}" for k in lots])

    def clear(self, spark) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

