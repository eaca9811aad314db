"""Files: CSV, JSON and JSON lines, event-stream transcripts and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WRAPPERS = ("alerts", "signals", "records", "data", "events")
RECORD = "kind string, version int, base_url string, started_at string, stream string, id string, at string, outcome string, signal string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV, JSON (bare or wrapped in one of WRAPPERS) or JSON-lines file or folder, by its ending."""
    low = path.lower()
    if low.endswith(".csv"):
        df = spark.read.csv(path, header=True)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if low.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path, mode="DROPMALFORMED")
    df = spark.read.json(path, multiLine=True)
    for w in WRAPPERS:
        if w in df.columns and dict(df.dtypes)[w].startswith("array<struct"):
            return df.select(F.explode(w).alias("r")).select("r.*")
    return df


def event_stream(lines: DataFrame) -> DataFrame:
    """lines(stream, n, line), n rising, to events (stream, id, event, data): fields until a blank line, several data
    lines joined by newlines, comment lines ignored, an event without data dropped."""
    w = Window.partitionBy("stream").orderBy("n")
    block = F.sum((F.col("line") == "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    field = F.regexp_extract("line", r"^(id|event|data):\s?(.*)$", 1)
    value = F.regexp_extract("line", r"^(id|event|data):\s?(.*)$", 2)
    rows = lines.withColumn("block", F.coalesce(block, F.lit(0))).select("stream", "block", "n", field.alias("f"), value.alias("v"))
    last = lambda k: F.max(F.when(F.col("f") == k, F.struct("n", "v")))["v"]
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == "data", F.struct("n", "v")))), lambda x: x["v"]), "\n")
    out = rows.groupBy("stream", "block").agg(last("id").alias("id"), F.coalesce(last("event"), F.lit("message")).alias("event"), F.when(
        F.count_if(F.col("f") == "data") > 0, data).alias("data"))
    return out.where("data is not null").select("stream", "block", "id", "event", "data")


def recording(spark: SparkSession, path: str) -> DataFrame:
    """Events of a recording in JSON lines; torn or foreign lines are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where("kind = 'event' and stream is not null")


def last_ids(events: DataFrame) -> DataFrame:
    """(stream, last_id): where to resume each stream, the last id that is not null."""
    return events.where("id is not null").groupBy("stream").agg(F.max(F.struct("at", "id"))["id"].alias("last_id"))


def outcome_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("stream").agg(
        F.count("*").alias("events"), F.count_if(F.col("outcome") == "signal").alias("signals"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "error").alias("errors"))
