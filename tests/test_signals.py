"""Operators on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from causeway.functions import redaction, text
from causeway.operators import baseline, bridges, causal, dedup, evaluate, incidents, pairs, severity, similar_text, splitting, timeline, topology
from causeway.operators.components import components
from causeway.sources import adapters, files, sinks
from causeway.streaming.review import Review, adjusted_weights

T0 = 1_704_067_200_000_000
MIN = 60_000_000


def one(df):
    return [tuple(r) for r in df.collect()]


def signal_rows(spark, rows):
    """rows of (id, minute, service, component, source, severity, message, metric, value)."""
    out = [(i, T0 + int(m * MIN), s, c, src, sev, msg, msg, met, val, 100.0 if met else None, None, None)
           for i, m, s, c, src, sev, msg, met, val in rows]
    df = spark.createDataFrame(out, "id long, ts long, service string, component string, source string, severity string, message string, template string, metric string, value double, threshold double, trace_id string, mention string")
    return df.withColumn("sev_rank", text.severity_rank(F.col("severity")))


def test_dedup_keeps_earliest_and_counts(spark):
    s = signal_rows(spark, [(2, 1, "a", "x", "app_log", "high", "boom", None, None), (1, 0, "a", "x", "app_log", "high", "boom", None, None),
                            (3, 6, "a", "x", "app_log", "high", "boom", None, None)])
    got = sorted((r.id, r.occurrence_count) for r in dedup.dedup_signals(s).collect())
    assert got == [(1, 2), (3, 1)]


def test_z_score_needs_warmup_and_variance(spark):
    rows = [("s", k, k, float(v)) for k, v in enumerate([10, 10, 10, 10, 10, 10, 12, 50])]
    got = {r.id: r.z for r in baseline.z_scores(spark.createDataFrame(rows, "series string, ts long, id long, value double")).collect()}
    assert got[4] is None and got[6] is None  # no variance yet
    assert got[7] is not None and got[7] > 3


def test_z_score_state_across_partitions(spark):
    rows = [(f"s{k % 3}", k, k, float(k * k % 17)) for k in range(300)]
    df = spark.createDataFrame(rows, "series string, ts long, id long, value double")
    assert sorted(one(baseline.z_scores(df.repartition(1))), key=str) == sorted(one(baseline.z_scores(df.repartition(7))), key=str)


def test_breach_guards_zero(spark):
    df = spark.createDataFrame([(120.0, 100.0), (5.0, 0.0), (None, 1.0)], "v double, t double")
    assert one(df.select(F.round(baseline.breach(F.col("v"), F.col("t")), 6))) == [(1.0,), (None,), (None,)]


def test_tokens_split_fold_and_drop(spark):
    df = spark.createDataFrame([("Threshold Crossed: pool is exhausted", "DatabaseConnections", "db-pool")], "m string, k string, c string")
    assert sorted(one(df.select(text.tokens(F.col("m"), F.col("k"), F.col("c"))))[0][0]) == ["connection", "database", "exhausted", "pool"]


def test_template_masks(spark):
    df = spark.createDataFrame([("id 123e4567-e89b-12d3-a456-426614174000 took 12.5 ms of 3",)], "m string")
    assert one(df.select(text.template(F.col("m"))))[0][0] == "id <*> took <*> ms of <*>"


def test_mentions_whole_words(spark):
    df = spark.createDataFrame([("breaker open for pay-svc, not pay-svc-two; my-db is fine",)], "m string")
    known = F.array(F.lit("pay-svc"), F.lit("db"), F.lit("pay-svc-two"), F.lit("own"))
    assert one(df.select(text.mentioned(F.col("m"), known, F.lit("own"))))[0][0] == ["db", "pay-svc", "pay-svc-two"]


def test_event_times(spark):
    df = spark.createDataFrame([("1704067200",), ("1704067200000",), ("1704067200000000000",), ("2024-01-01T00:00:00Z",), ("x",)], "r string")
    assert [r[0] for r in one(df.select(text.event_time(F.col("r"))))] == [T0, T0, T0, T0, None]


@pytest.mark.parametrize(("raw", "gone", "kept"), [
    ("mail bob.smith@corp.example.com now", "bob.smith", "mail"),
    ("card 4111 1111 1111 1111 used", "4111 1111", "used"),
    ("order 1234567890123456 shipped", "@@", "1234567890123456"),
    ("from 10.20.30.40 port 80", "10.20.30.40", "port 80"),
    ("auth Bearer abcdef0123456789xyz ok", "abcdef0123456789xyz", "auth"),
    ("ssn 123-45-6789.", "123-45-6789", "ssn"),
    ("customer Jane Miller called", "Jane Miller", "called"),
    ("version 1.2.3 build 42", "@@", "version 1.2.3 build 42"),
])
def test_redaction(spark, raw, gone, kept):
    df = spark.createDataFrame([(raw,)], "t string").select(redaction.redact(F.col("t")).alias("t"))
    got = one(df)[0][0]
    assert gone not in got and kept in got
    assert one(df.select(redaction.redact(F.col("t"))))[0][0] == got  # nothing more to find


def graph(spark):
    return spark.createDataFrame([("web", "api"), ("api", "db"), ("api", "cache"), ("job", "db")], "caller string, callee string")


def test_hops_and_dependents(spark):
    h = {(r.a, r.b): r.hops for r in topology.hops(graph(spark)).collect()}
    assert h["web", "db"] == 2 and h["web", "web"] == 0 and h["web", "job"] == 3
    d = {(r.service, r.dependent) for r in topology.dependents(graph(spark)).collect()}
    assert d == {("api", "web"), ("db", "api"), ("db", "web"), ("db", "job"), ("cache", "api"), ("cache", "web")}


def cascade(spark):
    return baseline.detect(signal_rows(spark, [
        (1, 0, "db", "pool", "cloudwatch_metric", "critical", "DatabaseConnections high", "DatabaseConnections", 200.0),
        (2, 0.5, "api", "pool", "app_log", "high", "connection pool exhausted", None, None),
        (3, 1, "web", "front", "app_log", "high", "upstream connection lost", None, None),
        (4, 1, "mail", "smtp", "cloudwatch_metric", "critical", "QueueDepth", "QueueDepth", 150.0),
    ]).withColumn("occurrence_count", F.lit(1).cast("long")))


def test_cascade_to_root_cause(spark):
    s, g = cascade(spark), graph(spark)
    pair = pairs.similarity(pairs.gated(pairs.candidates(s, g), g))
    link = pairs.links(pair).select("a_id", "b_id", "gate", "sim")
    label = components(link.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    assert {(r.id, r.label) for r in label.collect()} == {(1, 1), (2, 1), (3, 1)}
    m = s.join(label, "id")
    scored = causal.scores(m, g, topology.dependents(g))
    root = causal.root_causes(scored).collect()
    assert [(r.root, r.fell_back) for r in root] == [("db", False)]
    checks = incidents.validation(m, incidents.annotate(m, link)).collect()[0]
    assert checks.accepted
    reg = spark.createDataFrame([("db", 0.9)], "service string, criticality double")
    got = severity.impact(m, causal.root_causes(scored), topology.dependents(g), reg).collect()[0]
    assert (got.n_services, got.n_further, got.priority) == (3, 1, "P1")  # 0.4 * 0.48 + 0.35 * 0.9 + 0.25 = 0.757


def test_two_causes_in_one_cluster_split(spark):
    s = baseline.detect(signal_rows(spark, [
        (1, 0, "db", "pool", "cloudwatch_metric", "critical", "DatabaseConnections", "DatabaseConnections", 200.0),
        (2, 1, "api", "pool", "app_log", "high", "database connection refused", None, None),
        (3, 0, "cache", "redis", "cloudwatch_metric", "critical", "Evictions memory", "Evictions", 200.0),
        (4, 1, "cache", "redis", "app_log", "high", "evictions memory pressure", None, None),
    ])).withColumn("label", F.lit(1).cast("long"))
    g = graph(spark)
    scored = causal.scores(s, g, topology.dependents(g))
    got = {r.id: r.centre for r in splitting.split(s, scored, topology.dependents(g), topology.hops(g)).collect()}
    assert got == {1: "db", 2: "db", 3: "cache", 4: "cache"}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.label) for r in components(e).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_weak_bridge_splits(spark):
    m = spark.createDataFrame([(k, 1) for k in range(1, 6)], "id long, label long")
    link = spark.createDataFrame([(1, 2, "g", 0.9), (2, 3, "g", 0.46), (3, 4, "g", 0.47), (4, 5, "g", 0.9)], "a_id long, b_id long, gate string, sim double")
    got = {r.id: r.part for r in bridges.split_weak_bridges(m, link).collect()}
    assert got[1] == got[2] and got[3] == got[4] == got[5] != got[1]


def test_pair_scores_match_pairs_made(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y"), (5, None, "y"), (6, "b", None)]
    r = evaluate.pair_scores(spark.createDataFrame(rows, "id long, label string, truth string")).collect()[0]
    assert (r.both, r.predicted, r.actual) == (1, 4, 4) and r.precision == 0.25


def test_sessions_gap_is_strict(spark):
    df = spark.createDataFrame([("k", T0, 1), ("k", T0 + 15 * MIN, 2), ("k", T0 + 30 * MIN + 1, 3)], "key string, ts long, id long")
    assert sorted(r.n for r in timeline.sessions(df, "key", 15).collect()) == [1, 2]


def test_slices_are_anchored(spark):
    df = spark.createDataFrame([("k", T0 + s * 1_000_000, s) for s in (0, 1, 2, 3, 5)], "key string, ts long, id long")
    assert [r.slice for r in timeline.slices(df, "key", 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_density_clusters_cores_and_borders(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "id long")
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 7)], "a long, b long")
    got = {r.id: r.label for r in similar_text.density_clusters(e, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: -1, 6: -1, 7: -1}


def raw(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "raw string")


def test_log_line_adapter(spark):
    got = adapters.log_lines(raw(spark, "2026-09-26T10:01:05Z ERROR payments db-pool [user:bob ip:10.0.0.1] Pool exhausted: 100", "junk",
                                 "2026-09-26T10:01:05Z NOPE a b c")).collect()
    assert [(r.service, r.component, r.severity, r.message, r.labels["ctx.user"]) for r in got] == [("payments", "db-pool", "high", "Pool exhausted: 100", "bob")]


def test_log_line_times(spark):
    times = ["2026-09-26T10:01:05Z", "2026-09-26T12:01:05+02:00", "1790416865", "1790416865000", "1790416865000000", "1790416865000000000"]
    lines = [f"{t} INFO a b [k:1 k:1] m" for t in times]
    # without a time the line is dropped before its fields are read: its key comes twice
    got = adapters.log_lines(raw(spark, *lines, "never ERROR a b [k:1 k:2] m", "25:00: ERROR a b m")).collect()
    assert [r.ts for r in got] == [1790416865000000] * 6


def test_alarm_adapter(spark):
    ok = {"AlarmName": "A", "NewStateValue": "ALARM", "StateChangeTime": "2026-01-01T00:00:00Z", "NewStateReason": "x [200.0 (t)] was greater than the threshold (90.0)",
          "Trigger": {"MetricName": "M", "Threshold": 90.0, "Dimensions": [{"name": "ServiceName", "value": "db"}]}}
    got = adapters.alarms(raw(spark, ok, ok | {"NewStateValue": "OK"}, "{broken")).collect()
    assert [(r.service, r.value, r.threshold, r.is_anomaly) for r in got] == [("db", 200.0, 90.0, True)]


def test_dashboard_adapter(spark):
    a = {"title": "High latency — checkout", "state": "alerting", "message": "p99 above 250", "evalMatches": [{"metric": "p99", "value": 300.0, "tags": {"env": "prod"}}], "tags": {"env": "dev", "region": "eu"}}
    got = adapters.dashboard_alerts(raw(spark, a, a | {"state": "ok"}), F.lit(T0)).collect()
    assert [(r.service, r.value, r.threshold, r.environment, r.region) for r in got] == [("checkout", 300.0, 250.0, "prod", "eu")]


def test_trace_adapter_and_edges(spark):
    def res(name, spans):
        return {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": name}}]}, "scopeSpans": [{"spans": spans}]}

    p = {"resourceSpans": [res("web", [{"traceId": "t", "spanId": "1", "name": "GET", "startTimeUnixNano": "1704067200000000000", "status": {"code": 0}}]),
                           res("api", [{"traceId": "t", "spanId": "2", "parentSpanId": "1", "name": "q", "startTimeUnixNano": "1704067200000000000", "status": {"code": 2, "message": "boom"}}])]}
    s = adapters.spans(raw(spark, p))
    assert [(r.service, r.parent_service, r.message) for r in adapters.error_spans(s).collect()] == [("api", "web", "boom")]
    assert one(adapters.span_edges(s)) == [("web", "api")]


def test_generic_adapter(spark):
    df = spark.createDataFrame([("h1", "2026-01-01T00:00:00Z", "ERR", "disk full"), ("h2", "never", "x", "y")], "host string, time string, level string, description string")
    assert [(r.service, r.severity, r.message) for r in adapters.generic(df).collect()] == [("h1", "high", "disk full")]


def test_event_stream_framing(spark):
    lines = [": keepalive", "id: 1", "event: signal", "data: a", "data: b", "", ": x", "", "data: c", ""]
    df = spark.createDataFrame([("s", k, line) for k, line in enumerate(lines)], "stream string, n long, line string")
    got = [(r.id, r.event, r.data) for r in files.event_stream(df).orderBy("block").collect()]
    assert got == [("1", "signal", "a\nb"), (None, "message", "c")]


def test_file_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("host,time\nh,1\n")
    (tmp_path / "b.json").write_text('{"alerts": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id"\n')
    assert one(files.records(spark, str(tmp_path / "a.csv"))) == [("h", "1")]
    assert files.records(spark, str(tmp_path / "b.json")).count() == 2
    assert files.records(spark, str(tmp_path / "c.jsonl")).where("id is not null").count() == 1


def test_sinks(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id long, v long, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "id long, v long, x string")
    assert sorted(one(sinks.keep_latest(old, new, "id", "v").select("id", "x"))) == [(1, "c"), (2, "b"), (3, "e")]
    t = sinks.tickets(spark.createDataFrame([("d2",), ("d1",), ("d2",)], "draft_id string"), 7)
    assert sorted(one(t)) == [("d1", "TKT-0008"), ("d2", "TKT-0009")]


def test_review_state_machine():
    r = Review()
    token = r.submit("d")
    with pytest.raises(ValueError):
        r.decide("d", "approve", "me", "wrong")
    assert r.decide("d", "approve", "me", token) == "published"
    with pytest.raises(ValueError):
        r.decide("d", "approve", "me", token)
    assert Review.replay(r.events).status == {"d": "published"}
    w = adjusted_weights(pairs.WEIGHTS, "approve")
    assert abs(sum(w.values()) - 1) < 0.003 and w["time"] > pairs.WEIGHTS["time"]


def test_each_pair_is_formed_once_and_not_grouped(spark):
    rows = [(k, k * 200_000_000, f"svc{k % 3}", f"{'cC'[k % 2]}{k % 2}" if k % 5 else None, f"tr{k // 3}" if k % 4 else None, f"svc{(k + 1) % 3}" if k % 6 == 0 else None,
             f"svc{(k + 2) % 3}" if k % 7 == 0 else None, "m", "app_log", None, f"say {k % 4}") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, ts long, service string, component string, trace_id string, mention string, parent_service string, template string, "
                               "source string, metric string, message string")
    calls = spark.createDataFrame([("svc0", "svc1")], "caller string, callee string")
    near = {("svc0", "svc1"), ("svc1", "svc0")}
    for called in (True, False):
        got = pairs.candidates(df if called else df.drop("parent_service"), calls)
        want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and y[1] - x[1] <= pairs.BAND and (
            x[2] == y[2] or (x[4] and x[4] == y[4]) or (x[3] and y[3] and x[3].lower() == y[3].lower()) or (x[2], y[2]) in near
            or y[2] == x[5] or x[2] == y[5] or (called and (x[6] == y[2] or y[6] == x[2])))}
        found = got.select("a_id", "b_id", "a.service", "b.words").collect()
        assert {(r.a_id, r.b_id) for r in found} == want and len(found) == len(want) == got.count()
        assert got.agg({"a_id": "count"}).first()[0] == len(want)
        # only the calls of a service are grouped
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") <= 2
