"""Streams from files, batch by batch."""

from pyspark.sql import functions as F
from test_signals import MIN, T0, cascade, graph, signal_rows

from causeway.operators import baseline
from causeway.streaming import live


def drain(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streaming_dedup_counts(spark, tmp_path):
    rows = signal_rows(spark, [(1, 0, "a", "x", "app_log", "high", "boom", None, None), (2, 1, "a", "x", "app_log", "high", "boom", None, None),
                               (3, 200, "b", "x", "app_log", "high", "z", None, None), (4, 400, "b", "x", "app_log", "high", "z", None, None)])
    rows.write.parquet(str(tmp_path / "in"))
    got = drain(spark, live.deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "append", "dd")
    assert ("a", 1, 2) in {(r.service, r.id, r.occurrence_count) for r in got}


def test_streaming_z_equals_batch(spark, tmp_path):
    rows = [("s", k, k, float(k * k % 7)) for k in range(30)]
    schema = "series string, ts long, id long, value double"
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r.id: r.z for r in drain(spark, live.running_z(stream), "append", "zz")}
    want = {r.id: r.z for r in baseline.z_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys()


def test_incidents_form_and_late_signals_join(spark, tmp_path):
    g = graph(spark)
    engine = live.IncidentStream(str(tmp_path / "state"), g)
    first = cascade(spark)
    engine.batch(first, 0)
    assert {r.id for r in engine.state(spark, 0, "member").collect()} == {1, 2, 3}
    assert {r.id for r in engine.state(spark, 0, "pending").collect()} == {4}
    late = baseline.detect(signal_rows(spark, [(9, 2, "api", "pool", "app_log", "high", "connection pool exhausted again", None, None)])).withColumn(
        "occurrence_count", F.lit(1).cast("long"))
    engine.batch(late, 1)
    assert {(r.id, r.label) for r in engine.state(spark, 1, "member").collect()} == {(1, 1), (2, 1), (3, 1), (9, 1)}
    clock = baseline.detect(signal_rows(spark, [(20, 59, "none", "q", "app_log", "high", "later", None, None)])).withColumn(
        "occurrence_count", F.lit(1).cast("long"))
    engine.batch(clock, 2)
    assert {r.id for r in engine.state(spark, 2, "noise").collect()} == {4}
    assert engine.log(spark, 1, "noise").count() == 0
    engine.batch(clock, 2)  # a batch that runs again gives the same state
    assert {r.id for r in engine.state(spark, 2, "noise").collect()} == {4}


def test_repeats_are_absorbed(spark):
    s = baseline.detect(signal_rows(spark, [(k, k, "a", "x", "app_log", "high", "boom", None, None) for k in (1, 2, 3)])).withColumn(
        "occurrence_count", F.lit(1).cast("long"))
    got = live.absorb(s).collect()
    assert [(r.id, r.occurrence_count, r.ts) for r in got] == [(1, 3, T0 + MIN)]


def told(spark, rows):
    return baseline.detect(signal_rows(spark, rows)).withColumn("occurrence_count", F.lit(1).cast("long"))


def test_growth_is_told_and_scored_again(spark, tmp_path):
    engine = live.IncidentStream(str(tmp_path / "state"), graph(spark), score=lambda m: m.groupBy("label").agg(
        F.max("anomaly_score").alias("severity"), F.when(F.count("*") > 3, "P1").otherwise("P2").alias("priority")))
    engine.batch(cascade(spark), 0)
    assert [(r.label, r.action, r.signal_count, r.priority) for r in engine.state(spark, 0, "change").collect()] == [(1, "raised", 3, "P2")]
    raised = engine.state(spark, 0, "incident").first().raised_at
    # another occurrence of a member's condition, much later than repeats are absorbed: counted, but the incident doesn't grow
    again = cascade(spark).where("id = 2").withColumns({"id": F.lit(50).cast("long"), "ts": F.col("ts") + 7 * MIN})
    engine.batch(again, 1)
    assert {r.id: r.occurrence_count for r in engine.state(spark, 1, "member").collect()} == {1: 1, 2: 2, 3: 1}
    assert engine.state(spark, 1, "change").count() == 0
    engine.batch(told(spark, [(9, 8, "api", "pool", "app_log", "high", "connection pool exhausted again", None, None)]), 2)
    r = engine.state(spark, 2, "change").collect()
    assert [(x.label, x.action, x.signal_count, x.priority, x.escalated, x.raised_at) for x in r] == [(1, "updated", 4, "P1", True, raised)]
    # hours later the incident is closed: its members leave the state and stay in the log
    engine.batch(told(spark, [(60, 200, "none", "q", "app_log", "high", "later", None, None)]), 3)
    assert engine.state(spark, 3, "member").count() == engine.state(spark, 3, "incident").count() == 0
    assert {x.id for x in engine.log(spark, 3, "closed").collect()} == {x.id for x in engine.members(spark, 3).collect()} == {1, 2, 3, 9}
    engine.batch(told(spark, [(61, 201, "none", "q", "app_log", "high", "later", None, None)]), 4)
    assert engine.state(spark, 4, "closed").count() == 0


def test_a_rejected_set_is_told_once(spark, tmp_path):
    engine = live.IncidentStream(str(tmp_path / "state"), graph(spark), accept=lambda m, _: m.select("label").limit(0))
    engine.batch(cascade(spark), 0)
    assert [(r.label, r.n_signals) for r in engine.state(spark, 0, "rejection").collect()] == [(1, 3)]
    engine.batch(cascade(spark).limit(0), 1)
    assert engine.state(spark, 1, "rejection").count() == 0 and engine.state(spark, 1, "rejected").count() == 1
    assert engine.state(spark, 1, "pending").count() == 4
    engine.batch(told(spark, [(60, 200, "none", "q", "app_log", "high", "later", None, None)]), 2)
    assert engine.state(spark, 2, "rejected").count() == 0  # its signals have expired


def test_dashboard_alerts_do_not_move_the_clock(spark, tmp_path):
    engine = live.IncidentStream(str(tmp_path / "state"), graph(spark))
    engine.batch(told(spark, [(1, 0, "a", "x", "app_log", "high", "boom", None, None), (2, 40, "b", "y", "grafana_alert", "high", "late alert", None, None)]), 0)
    assert engine.state(spark, 0, "clock").first().clock == T0
    assert {r.id for r in engine.state(spark, 0, "pending").collect()} == {1, 2}


def test_a_stream_of_batches_resumes(spark, tmp_path):
    g = graph(spark)
    whole = cascade(spark)
    schema = whole.schema
    for k, some in enumerate(("id in (1, 2)", "id in (3, 4)")):
        whole.where(some).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        engine = live.IncidentStream(str(tmp_path / "state"), g, accept=lambda m, _: m.select("label").distinct())
        engine.replay(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), str(tmp_path / "cp"))
    assert {r.id for r in engine.members(spark, 1).collect()} == {1, 2, 3}
    assert [r.action for r in engine.log(spark, 1, "change").orderBy("signal_count").collect()] == ["raised", "updated"]


def test_runs_of_repeats_end_by_timer(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(k, at, s, "x", "app_log", "high", "boom", None, None) for k, (at, s) in enumerate(
            [(0, "a"), (1, "b"), (3, "a"), (7, "a"), (20, "a"), (21, "a"), (22, "b"), (60, "c"), (200, "d")])]
        s = told(spark, rows)
        for k, some in enumerate(("id < 3", "id between 3 and 5", "id between 6 and 7", "id = 8")):
            s.where(some).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        got = {(r.service, r.id, r.occurrence_count) for r in drain(spark, live.absorbed(stream), "append", "runs")}
        want = {(r.service, r.id, r.occurrence_count) for r in live.absorb(s.where("id < 8")).collect()}
        assert got == want == {("a", 0, 3), ("a", 4, 2), ("b", 1, 1), ("b", 6, 1), ("c", 7, 1)}
    finally:
        spark.conf.unset(key)
