"""Paths, derived graphs, stories, evidence rows, learned weights, callers and live figures against plain readers."""

import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_signals import MIN, T0, graph, signal_rows

from causeway.operators import baseline, bundle, causal, evidence, pairs, propagation, severity, topology, truth
from causeway.operators.review_tables import numbered
from causeway.sources import sinks
from causeway.streaming import metrics


def slow_path(services, root):
    """services: {name: (onset, symptom_of)}."""
    out, by_time = [], sorted(services, key=lambda s: (services[s][0], s))

    def push(s, origin):
        if s not in [x for x, _ in out]:
            out.append((s, origin))

    push(root, None)
    for x, _ in iter(out):
        for s in by_time:
            if x in services[s][1]:
                push(s, x)
    for s in by_time:
        push(s, None)
    return out


def test_propagation_is_breadth_first(spark):
    rng = np.random.default_rng(2)
    rows, roots, want = [], [], {}
    for label in range(12):
        names = [f"s{k}" for k in range(int(rng.integers(1, 9)))]
        services = {s: (int(rng.integers(0, 4)), sorted({names[int(k)] for k in rng.integers(0, len(names), 2)} - {s}) or None) for s in names}
        rows += [(label, s, t, up) for s, (t, up) in services.items()]
        roots.append((label, names[0]))
        want[label] = slow_path({s: (t, up or []) for s, (t, up) in services.items()}, names[0])
    scored = spark.createDataFrame(rows, "label long, service string, onset long, symptom_of array<string>").repartition(3)
    got = {}
    for r in propagation.propagation(scored, spark.createDataFrame(roots, "label long, root string")).orderBy("label", "place").collect():
        got.setdefault(r.label, []).append((r.service, r["from"]))
    assert got == want


def test_derived_graph_is_of_the_riskiest_incident(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "d")], "label long, service string")
    roots = spark.createDataFrame([(1, "a"), (2, "b"), (3, "d")], "label long, root string")
    risk = spark.createDataFrame([(1, 0.4), (2, 0.6), (3, 0.9)], "label long, score double")
    assert {tuple(r) for r in propagation.derived_edges(m, roots, risk).collect()} == {("b", "a", 2), ("b", "c", 2)}
    stats = spark.createDataFrame([("a", 4, 1), ("b", 2, 2), ("x", 3, 0)], "service string, n long, severe long")
    got = {r.service: (r.label, r.is_root, r.error_rate, r.status) for r in propagation.derived_nodes(stats, m, roots, risk).collect()}
    assert got == {"a": (2, False, 25, "warning"), "b": (2, True, 100, "critical"), "x": (None, False, 0, "healthy"), "d": (3, True, 0, "critical")}


@pytest.mark.parametrize("within", [1, 7, 40])
def test_truth_is_the_nearest_label(spark, within):
    rng = np.random.default_rng(within)
    signals = [(k, str(rng.choice(["a", "b"])), int(rng.integers(0, 400))) for k in range(150)] + [(900, None, 5), (901, "a", None)]
    labels = [(str(rng.choice(["a", "b", "c"])), int(rng.integers(0, 400)), f"t{k % 5}") for k in range(40)]
    got = {r.id: r.story for r in truth.attached(spark.createDataFrame(signals, "id long, service string, ts long").repartition(3),
                                                 spark.createDataFrame(labels, "service string, ts long, story string"), within).collect()}
    want = {}
    for k, service, ts in signals:
        near = sorted((abs(ts - t), t, story) for s, t, story in labels if ts is not None and s == service and abs(ts - t) <= within)
        want[k] = near[0][2] if near else None
    assert got == want


def test_scores_of_stories(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (9, 2)], "id long, label long")
    told = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x"), (5, "decoy"), (6, "decoy"), (7, "z"), (8, None)], "id long, story string")
    roots = spark.createDataFrame([(1, "api"), (2, "db")], "label long, root string")
    r = truth.truth_scores(members, told, roots, spark.createDataFrame([("x", "api"), ("y", "api")], "story string, root string")).first().asDict()
    assert r == {"stories": 3, "incidents": 2, "actual": 3.0, "predicted": 3.0, "correct": 1.0, "precision": 0.333333, "recall": 0.333333, "f1": 0.333333,
                 "purity": 0.75, "completeness": 0.555556, "decoys": 2, "decoys_in": 1, "mixed_incidents": 1, "split_stories": 1, "dominated": 2, "root_correct": 1}


def members(spark):
    s = baseline.detect(signal_rows(spark, [
        (1, 0, "db", "pool", "cloudwatch_metric", "critical", "DatabaseConnections", "DatabaseConnections", 200.0),
        (2, 1, "api", "pool", "app_log", "high", "database connection refused", None, None),
        (3, 2, "web", "http", "app_log", "high", "api slow", None, None)]))
    return s.withColumns({"label": F.lit(1).cast("long"), "occurrence_count": F.lit(2).cast("long")})


def test_evidence_is_rows(spark):
    m, g = members(spark), graph(spark)
    scored = causal.scores(m, g, topology.dependents(g))
    roots, telling = causal.root_causes(scored), causal.representative(m)
    pair = pairs.similarity(pairs.gated(pairs.candidates(m.drop("label"), g), g))
    registry = spark.createDataFrame([("db", 0.9)], "service string, criticality double")
    impact = severity.impact(m, roots, topology.dependents(g), registry)
    near = spark.createDataFrame([(1, 77, "no shared context", 1)], "label long, id long, reason string, rank int")
    noise = m.where("id = 1").withColumn("id", F.lit(77).cast("long"))
    parts = evidence.validated_parts(spark.createDataFrame([(1, 0.5, 1.0, 0.8)], "label long, density double, topology double, evidence double"))
    rows = bundle.bundle(m, evidence.strongest_joins(m, pair), evidence.drafts(m, roots, telling), roots, telling, impact, scored, near,
                         bundle.factors(impact, severity.trend(m), severity.diversity(m)), parts, noise).cache()
    got = {}
    for r in rows.orderBy("section", "place").collect():
        got.setdefault(r.section, []).append((r.subject, r.value, json.loads(r.body)))
    assert [x[0] for x in got["signal"]] == ["1", "2", "3"] and got["summary"][0][2]["raw_signals"] == 6
    assert [x[2]["speaks_for_root"] for x in got["signal"]] == [x[2]["service"] == got["summary"][0][2]["root"] for x in got["signal"]]
    assert [(x[0], x[1]) for x in got["part"]] == [("density", 0.2), ("evidence", 0.2), ("topology", 0.35)]
    assert [x[0] for x in got["factor"]] == ["blast radius", "business criticality", "anomaly magnitude", "trend direction", "signal diversity"]
    why = {x[0]: x[2].get("rejected_because") for x in got["candidate"]}
    assert why[got["summary"][0][2]["root"]] is None and sum(v is None for v in why.values()) == 1
    assert got["excluded"][0][2]["reason"] == "no shared context"
    assert [r.subject for r in bundle.detail(rows, 1, ["signal", "factor"], 2).collect()] == ["blast radius", "business criticality", "1", "2"]


def test_callers_and_learned_weights(spark):
    g = graph(spark)
    s = baseline.detect(signal_rows(spark, [(1, 0, "lonely", "x", "app_log", "high", "alpha", None, None), (2, 0, "island", "y", "app_log", "high", "beta", None, None),
                                            (3, 0, "desert", "z", "app_log", "high", "gamma", None, None)]))
    assert pairs.candidates(s, g).count() == 0
    called = s.withColumn("parent_service", F.when(F.col("id") == 2, "lonely"))
    gated = pairs.gated(pairs.candidates(called, g), g)
    assert [(r.a_id, r.b_id, r.gate) for r in gated.collect()] == [(1, 2, "caller in trace")]
    learned = spark.createDataFrame([(2, ["lonely", "island"], {"time": 0.1}), (1, ["lonely", "island", "desert"], {"time": 0.9}), (0, ["lonely"], {"time": 0.3})],
                                    "k int, services array<string>, weights map<string,double>")
    assert pairs.similarity(pairs.learned_sets(gated, learned)).first().sim == 0.9
    assert pairs.similarity(pairs.learned_sets(gated, learned.where("k = 0"))).first().sim == pairs.similarity(gated).first().sim == 0.36


def test_numbers_by_range(spark):
    rows = spark.createDataFrame([(k, (k * 37) % 11) for k in range(200)], "id long, x long").repartition(7)
    got = {r.id: r.place for r in numbered(rows, "place", "x", F.desc("id")).collect()}
    assert got == {k: i for i, k in enumerate(sorted(range(200), key=lambda k: ((k * 37) % 11, -k)), 1)}
    assert numbered(rows.limit(0), "place", "x").count() == 0


def test_suppressed_incidents_have_no_part_in_the_share(spark):
    scored = spark.createDataFrame([(1, "P1"), (2, "P1"), (3, "P3"), (4, "P3")], "label long, priority string")
    held = spark.createDataFrame([(3, True), (4, True), (1, False)], "label long, suppressed boolean")
    r = severity.p1_warning(scored, suppressed=held).first()
    assert (r.incidents, r.live, r.p1_share, r.warn) == (4, 2, 1.0, True)


def test_latest_by_two_columns(spark):
    old, new = (spark.createDataFrame(x, "k string, a int, b int") for x in ([("x", 1, 5), ("y", 2, 2)], [("x", 1, 4), ("y", 2, 2), ("z", 0, 0)]))
    assert {tuple(r) for r in sinks.keep_latest(old, new, "k", "a", "b").collect()} == {("x", 1, 5), ("y", 2, 2), ("z", 0, 0)}


def test_figures_come_with_the_run(spark, tmp_path):
    s = baseline.detect(signal_rows(spark, [(k, k, "a", "x", ["app_log", "grafana_alert"][k % 2], "high" if k % 3 else "info", "m", None, None) for k in range(20)]))
    s = s.withColumn("occurrence_count", (F.col("id") % 2 + 1).cast("long"))
    seen = Observation("run")
    metrics.observed(s, seen).write.format("noop").mode("overwrite").save()
    got = metrics.bundle(seen.get)
    assert (got["received"], got["distinct"], got["collapsed_pct"], got["sources"]["app_log"], sum(got["score_histogram"])) == (30, 20, 33.3, 10, 20)
    assert got["clock"] == T0 + 19 * MIN and got["anomalies"] == s.where("is_anomaly").count()
    for k in range(2):
        s.where(f"id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    totals = metrics.Totals("run")
    spark.streams.addListener(totals)
    try:
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = metrics.observed(stream, "run").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(100):
            if totals.batches == 2:
                break
            time.sleep(0.1)
        assert metrics.bundle(totals.row) == got and totals.batches == 2
    finally:
        spark.streams.removeListener(totals)
