"""Live operation on Structured Streaming: windowed dedup, stateful baselines, and the incident micro-batch.

The micro-batch engine keeps its state as tables in a folder all executors share, one version for each batch id, so
that a batch that is run again after a failure starts from the same state and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import baseline, dedup, evidence, incidents, pairs, topology
from ..operators.components import components
from ..sources import sinks
from ..tables import written

MINUTE = 60_000_000
PENDING, LATE = 15 * MINUTE, 60 * MINUTE


def with_event_time(signals: DataFrame, lateness: str = "75 minutes") -> DataFrame:
    """signals with event_time (from ts in microseconds) and a watermark that keeps what may still join an incident."""
    return signals.withColumn("event_time", F.timestamp_micros("ts")).withWatermark("event_time", lateness)


def deduplicated(signals: DataFrame, minutes: int = 5) -> DataFrame:
    """Streaming form of the dedup: earliest signal and count of each condition and bucket, emitted when it closes."""
    keyed = with_event_time(signals).withColumn("content", dedup.content_key())
    first = F.min(F.struct("ts", "id", "severity", "message"))
    out = keyed.groupBy("service", "component", "content", F.window("event_time", f"{minutes} minutes")).agg(
        first.alias("s"), F.count("*").alias("occurrence_count"))
    return out.select("service", "component", "content", "s.*", "occurrence_count")


def minute_volume(signals: DataFrame) -> DataFrame:
    return with_event_time(signals).groupBy(F.window("event_time", "1 minute"), "source").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("minute"), "source", "n")


def running_z(points: DataFrame) -> DataFrame:
    """points(series, ts, id, value) as a stream, with z before each point: mean, variance and count are the state of a
    series, folded in time order inside each batch."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean, var, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for ts, ident, x in rows[["ts", "id", "value"]].itertuples(index=False, name=None):
            std = var**0.5
            z = (x - mean) / std if n >= baseline.WARMUP and std >= baseline.LEAST_STD else None
            out.append((key[0], ts, ident, x, z))
            if n == 0:
                mean = x
            else:
                delta = x - mean
                mean += baseline.ALPHA * delta
                var = (1 - baseline.ALPHA) * (var + baseline.ALPHA * delta * delta)
            n += 1
        state.update((float(mean), float(var), int(n)))
        yield pd.DataFrame(out, columns=["series", "ts", "id", "value", "z"])

    return points.where("value is not null").groupBy("series").applyInPandasWithState(
        fold, "series string, ts long, id long, value double, z double", "mean double, var double, n long", "append", "NoTimeout")


class IncidentStream:
    """foreachBatch engine: repeats are absorbed, late signals join open incidents, pending ones form new incidents or
    expire as noise.

    Under folder/<batch id> each batch writes the state after it, all of it bounded by event time, not by what has ever
    come: pending (signals of the last 15 minutes in no incident), member and incident (incidents that end less than
    an hour before the clock, which a late signal may still join), rejected (sets of signals that were found wanting) and
    clock. What leaves the state is appended beside it and never read again by the engine: noise (expired signals),
    closed (members of incidents too old to grow), change (incidents raised or updated by the batch, scored anew) and
    rejection (sets found wanting for the first time). A batch that runs again after a failure starts from the same
    state and overwrites its own results.

    Incidents connect signals of any services, so the state has no key by which a keyed state store could hold them apart;
    what has one (repeats of a condition, running baselines, templates) is keyed state: see absorbed and running_z.

    The clock is the newest event time of sources that state their own; dashboard alerts are stamped on arrival and
    don't move it.
    """

    STATE, LOG = ("pending", "member", "incident", "rejected", "clock"), ("noise", "closed", "change", "rejection")

    def __init__(self, folder: str, edges: DataFrame, accept: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                 score: Callable[[DataFrame], DataFrame] | None = None, repeat_minutes: float = 5) -> None:
        self.folder, self.edges, self.accept, self.score = folder.rstrip("/"), edges, accept or self._accepted, score or self._sized
        self.repeat_minutes, self.near = repeat_minutes, None

    @staticmethod
    def _accepted(members: DataFrame, links: DataFrame) -> DataFrame:
        checks = incidents.validation(members, incidents.annotate(members, links))
        return checks.where("accepted").select("label")

    @staticmethod
    def _sized(members: DataFrame) -> DataFrame:
        """What is known of an incident without a registry of services."""
        return members.groupBy("label").agg(F.max("anomaly_score").alias("severity"), F.lit("P3").alias("priority"))

    def state(self, spark: SparkSession, batch: int, table: str, like: DataFrame | None = None) -> DataFrame:
        if batch < 0:
            return like.limit(0)
        return spark.read.parquet(f"{self.folder}/{batch}/{table}")

    def log(self, spark: SparkSession, upto: int, table: str) -> DataFrame:
        """Everything the batches up to one have appended to a table of LOG."""
        return spark.read.parquet(*[f"{self.folder}/{k}/{table}" for k in range(upto + 1)])

    def members(self, spark: SparkSession, batch: int) -> DataFrame:
        """Members of all incidents after a batch, open or closed."""
        return self.state(spark, batch, "member").unionByName(self.log(spark, batch, "closed"))

    def batch(self, signals: DataFrame, batch_id: int) -> None:
        """One micro-batch of scored signals (as from detect()); writes the state after it."""
        spark = signals.sparkSession

        def put(df: DataFrame, table: str) -> DataFrame:
            path = f"{self.folder}/{batch_id}/{table}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        blank = signals.limit(0)
        before = lambda table, like: self.state(spark, batch_id - 1, table, like)
        pending, member = before("pending", blank), before("member", blank.withColumn("label", F.lit(0).cast("long")))
        known = before("incident", spark.createDataFrame([], "label long, signal_count long, started long, ended long, severity double, priority string, raised_at long"))
        rejected = before("rejected", spark.createDataFrame([], "members_key string, until long"))
        clock = signals.where("source <> 'grafana_alert'").select(F.col("ts").alias("clock")).union(
            before("clock", spark.createDataFrame([], "clock long"))).agg(F.max("clock").alias("clock"))
        now = put(clock, "clock").first()[0] or 0
        # repeats of one condition: counts add up, the earliest stays with the highest score
        pool = put(absorb(pending.unionByName(signals.where("is_anomaly")), self.repeat_minutes), "pool")
        since = pool.agg(F.min("ts")).first()[0] or 0
        # signals are alike inside a band of time only, so older members are not compared
        near = member.where(F.col("ts") >= since - pairs.BAND).drop("label")
        if self.near is None:  # the graph is the same for every batch
            self.near = written(topology.hops(self.edges), "hops")
        pair = pairs.similarity(pairs.gated(pairs.candidates(pool.unionByName(near), self.edges), self.edges, self.near)).select("a_id", "b_id", "gate", "sim")
        pair = put(pair, "pair")
        # late signals join the open incident that fits best
        both = pair.unionByName(pair.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "gate", "sim"))
        late = put(incidents.late_matches(pool, both, member.select("id", "label"), known.select("label", "ended")), "late")
        grown = joined(member, pool.join(late, "id"))
        # the rest forms incidents among itself
        rest = pool.join(late.select("id"), "id", "left_anti")
        mine = pairs.links(pair).join(rest.select(F.col("id").alias("a_id")), "a_id", "left_semi").join(
            rest.select(F.col("id").alias("b_id")), "b_id", "left_semi")
        found = components(mine.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        grouped = put(rest.join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).drop("of"), "grouped")
        good = put(self.accept(grouped, mine).select("label"), "good")
        new = grouped.join(good, "label", "left_semi").select(*member.columns)
        everyone = put(grown.unionByName(new), "everyone")
        # sets found wanting are told once; they are kept as long as their signals may still be pending
        keys = evidence.member_keys(grouped.join(good, "label", "left_anti")).join(
            grouped.groupBy("label").agg(F.max("ts").alias("ended"), F.count("*").alias("n_signals")), "label")
        keys = put(keys.join(rejected.select("members_key"), "members_key", "left_anti").select("label", "members_key", "n_signals", "ended"), "rejection")
        put(rejected.where(F.col("until") >= now).unionByName(keys.select("members_key", (F.col("ended") + PENDING).alias("until"))), "rejected")
        # incidents that were touched are scored anew; they change when they grow
        touched = late.select("label").union(good).distinct()
        some = everyone.join(touched, "label", "left_semi")
        size = some.groupBy("label").agg(F.count("*").alias("signal_count"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
        scored = size.join(self.score(some).select("label", "severity", "priority"), "label").join(
            known.select("label", "raised_at", F.col("priority").alias("was")), "label", "left").withColumn("raised_at", F.coalesce("raised_at", F.lit(now)))
        scored = put(scored, "scored")
        ident = lambda df: df.select(F.col("label").alias("draft_id"), "signal_count")
        action = sinks.archive_changes(ident(known), ident(scored)).withColumnRenamed("draft_id", "label")
        change = scored.join(action, "label").withColumn("escalated", F.coalesce((F.col("priority") == "P1") & (F.col("was") != "P1"), F.lit(False)))
        put(change, "change")
        after = scored.drop("was").unionByName(known.join(scored.select("label"), "label", "left_anti"))
        open_ = put(after.where(F.col("ended") >= now - LATE), "incident")
        put(everyone.join(open_.select("label"), "label", "left_semi"), "member")
        put(everyone.join(open_.select("label"), "label", "left_anti"), "closed")
        left = rest.join(new.select("id"), "id", "left_anti")
        old = F.lit(now) - F.col("ts") > PENDING
        put(left.where(~old), "pending")
        put(left.where(old), "noise")

    def start(self, scored: DataFrame, checkpoint: str, seconds: int = 2):
        return scored.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(
            processingTime=f"{seconds} seconds").start()

    def replay(self, scored: DataFrame, checkpoint: str) -> None:
        """All that a stream holds now, batch after batch."""
        scored.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def joined(member: DataFrame, late: DataFrame) -> DataFrame:
    """member with late signals (label and the same columns): one that repeats the condition of a member of its incident
    adds its occurrences to the earliest such member, else it is a member of its own."""
    key = ["label", "service", "component", "content"]
    held = member.withColumn("content", dedup.content_key())
    came = late.select(*member.columns).withColumn("content", dedup.content_key())
    first = held.groupBy(*key).agg(F.min(F.struct("ts", "id"))["id"].alias("at"))
    own = came.groupBy(*key).agg(F.min(F.struct("ts", "id"))["id"].alias("own"))
    null_safe = lambda other: [F.col(f"c.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in key]
    placed = came.alias("c").join(first.alias("f"), null_safe("f"), "left").join(own.alias("o"), null_safe("o"), "left").select(
        "c.*", F.coalesce("at", "own").alias("to"))
    more = placed.where("id <> to").groupBy(F.col("to").alias("id")).agg(F.sum("occurrence_count").alias("more"))
    both = member.unionByName(placed.where("id = to").select(*member.columns))
    out = both.join(more, "id", "left").withColumn("occurrence_count", F.col("occurrence_count") + F.coalesce("more", F.lit(0)))
    return out.select(*member.columns)


class _Repeats(StatefulProcessor):
    """Key (service, component, content): the run of repeats that is going on, until nothing has come for a while."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "ts long, id long, last long, n long, score double")

    def _row(self, key: tuple, run: tuple) -> tuple:
        return (*key[:3], run[0], run[1], run[3], run[4])

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RUNS.split(", ")])

    def _timer(self, last: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer((last + self.micros) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run = self.run.get() if self.run.exists() else None
        table, out = pd.concat(list(rows)).sort_values(["ts", "id"]), []
        for ts, ident, n, score in table[["ts", "id", "occurrence_count", "anomaly_score"]].itertuples(index=False, name=None):
            if run is not None and ts - run[2] <= self.micros:
                first = min((run[0], run[1]), (ts, ident))
                run = (*first, max(run[2], ts), run[3] + n, max(run[4], score))
            else:
                if run is not None:
                    out.append(self._row(key, run))
                run = (ts, ident, ts, n, score)
        self.run.update(tuple(f(x) for f, x in zip((int, int, int, int, float), run, strict=True)))
        self._timer(int(run[2]))
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self.run.get()
        self.run.clear()
        yield self._out([self._row(key, run)])

    def close(self) -> None:
        pass


RUNS = "service string, component string, content string, ts long, id long, occurrence_count long, anomaly_score double"


def absorbed(signals: DataFrame, minutes: float = 5, lateness: str = "15 minutes") -> DataFrame:
    """Streaming form of absorb: a run of repeats of one condition is a row (RUNS: its earliest signal, occurrences, highest
    score) once the watermark is past its last repeat and the gap. One run for each condition is held, and an event-time
    timer ends it. Needs the RocksDB state store."""
    keyed = with_event_time(signals, lateness).withColumn("content", dedup.content_key())
    rows = keyed.select("service", "component", "content", "event_time", "ts", "id", "occurrence_count", "anomaly_score")
    return rows.groupBy("service", "component", "content").transformWithStateInPandas(
        statefulProcessor=_Repeats(int(minutes * MINUTE)), outputStructType=RUNS, outputMode="Append", timeMode="EventTime")


def absorb(signals: DataFrame, minutes: float = 5) -> DataFrame:
    """Signals of one condition at most `minutes` after its first: one row, occurrences added, highest score."""
    key = ["service", "component", "content"]
    s = signals.withColumn("content", dedup.content_key())
    w = Window.partitionBy(*key).orderBy("ts", "id")
    start = F.coalesce(F.col("ts") - F.lag("ts").over(w) > int(minutes * MINUTE), F.lit(True))
    s = s.withColumn("run", F.sum(start.cast("int")).over(w))
    kept = [c for c in signals.columns if c not in ("occurrence_count", "anomaly_score", "service", "component")]
    out = s.groupBy(*key, "run").agg(F.min(F.struct("ts", "id", *[c for c in kept if c not in ("ts", "id")])).alias("s"), F.sum(
        "occurrence_count").alias("occurrence_count"), F.max("anomaly_score").alias("anomaly_score"))
    return out.select("service", "component", "s.*", "occurrence_count", "anomaly_score").select(*signals.columns)
