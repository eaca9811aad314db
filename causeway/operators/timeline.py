"""Ordered sequences: islands, gap sessions, trailing windows, histograms, running curves, greedy slices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def islands(rows: DataFrame, key: str, order: list[str], same: list[str]) -> DataFrame:
    """Runs of consecutive equal rows inside each key: first and last position and length."""
    w = Window.partitionBy(key).orderBy(*order)
    at = rows.withColumn("pos", F.row_number().over(w))
    new = [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same]
    start = (F.col("pos") == 1) | new[0]
    for n in new[1:]:
        start = start | n
    run = at.withColumn("start", start.cast("int")).withColumn("island", F.sum("start").over(w))
    return run.groupBy(key, "island", *same).agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


def capped_timeline(runs: DataFrame, key: str, cap: int = 12) -> DataFrame:
    """The first `cap` runs of each key, the last of them with how many events follow."""
    w = Window.partitionBy(key)
    out = runs.withColumn("r", F.row_number().over(w.orderBy("island"))).withColumn("all", F.sum("n").over(w)).withColumn(
        "upto", F.sum("n").over(w.orderBy("island")))
    return out.where(F.col("r") <= cap).withColumn("further", F.when(F.col("r") == cap, F.col("all") - F.col("upto")).otherwise(
        0)).drop("all", "upto")


def sessions(rows: DataFrame, key: str, gap_minutes: float) -> DataFrame:
    """(key, session, started, ended, n): a session ends where the next row is more than the gap away."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > int(gap_minutes * MINUTE), F.lit(True)).cast("int")
    marked = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return marked.groupBy(key, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def busiest(rows: DataFrame, minutes: int = 10, lead_seconds: int = 60) -> DataFrame:
    """One row: the trailing window with most rows (the first such) and where playback should start. Rows are counted by
    time first; each slot of the window's length sees the slot before it, so that no pair of rows is made."""
    span = minutes * MINUTE
    slot = F.floor(F.col("ts") / span)
    at = rows.groupBy("ts").agg(F.count("*").alias("k")).withColumn("own", slot)
    seen = at.withColumn("slot", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    trailing = Window.partitionBy("slot").orderBy("ts").rangeBetween(-span + 1, 0)
    per = seen.withColumn("n", F.sum("k").over(trailing)).withColumn("first", F.min("ts").over(trailing)).where("slot = own")
    top = per.agg(F.min(F.struct((-F.col("n")).alias("neg"), "ts", "first")).alias("m"))
    return top.select((-F.col("m.neg")).alias("n"), F.col("m.ts").alias("window_end"), (F.col("m.first") - F.lit(
        lead_seconds * 1_000_000)).alias("start_at"))


def histogram(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all of time with empty buckets: width is the first that gives at most 30."""
    widths = [1, 5, 15, 30, 60, 180, 360, 720, 1440]
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    fit = F.filter(F.array(*[F.lit(w * MINUTE) for w in widths]), lambda w: F.floor(F.col("hi") / w) - F.floor(
        F.col("lo") / w) + 1 <= 30)
    span = span.withColumn("width", F.coalesce(F.get(fit, F.lit(0)), F.lit(widths[-1] * MINUTE)))
    grid = span.where("lo is not null").select("width", F.explode(F.sequence(
        F.floor(F.col("lo") / F.col("width")), F.floor(F.col("hi") / F.col("width")))).alias("slot"))
    hit = rows.join(F.broadcast(span), F.lit(True)).groupBy(F.floor(F.col("ts") / F.col("width")).alias("slot")).agg(
        F.count("*").alias("n"))
    return grid.join(hit, "slot", "left").select((F.col("slot") * F.col("width")).alias("bucket"), F.coalesce(
        "n", F.lit(0)).alias("n"))


def minute_volume(signals: DataFrame) -> DataFrame:
    """Signals a minute by source and how many are anomalous."""
    return signals.groupBy(F.floor(F.col("ts") / MINUTE).alias("minute"), "source").agg(
        F.count("*").alias("n"), F.sum(F.col("is_anomaly").cast("int")).alias("anomalous"))


def slices(rows: DataFrame, key: str, seconds: float = 2) -> DataFrame:
    """rows(key, ts, id) with slice: a new one where a row is `seconds` or more after the first row of the running
    slice. Folded as a stream in time order."""
    width = int(seconds * 1_000_000)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = object(), 0, 0
        for batch in batches:
            out = []
            for k, ts in zip(batch[key].tolist(), batch["ts"].tolist(), strict=True):
                if k != now:
                    now, start, n = k, ts, 0
                elif ts - start >= width:
                    start, n = ts, n + 1
                out.append(n)
            yield batch.assign(slice=pd.Series(out, index=batch.index, dtype="int64"))

    part = rows.select(key, "ts", "id").repartition(key).sortWithinPartitions(key, "ts", "id")
    return part.mapInPandas(fold, f"{key} string, ts long, id long, slice long")


def pacing(rows: DataFrame, key: str, speed: float = 1.0, most: float = 6.0) -> DataFrame:
    """Seconds to wait before each row in a replay."""
    gap = (F.col("ts") - F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "id"))) / 1e6
    return rows.withColumn("wait_s", F.round(F.least(F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)), F.lit(most)) / speed, 6))


def noise_curve(minutes: DataFrame) -> DataFrame:
    """minutes(minute, n, kept): running totals and running percentage of noise removed. One row a minute."""
    w = Window.orderBy("minute")
    n, k = F.sum("n").over(w), F.sum("kept").over(w)
    return minutes.select("minute", n.alias("received"), k.alias("kept"), F.round(100 * (1 - k / n), 6).alias("removed_pct"))
