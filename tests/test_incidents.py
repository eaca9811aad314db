"""Graph walks by joins against brute force, and every query of this module's catalogue against its SQL."""

import duckdb
import pytest

from causeway.operators import topology
from causeway.plans import incident_queries
from causeway.sources import adapters

FOLDER = "/root/testdata/sf0.001"


def graph(spark):
    pairs = [(f"s{a}", f"s{b}") for a in range(14) for b in range(14) if (a * 7 + b * 3) % 11 == 1 and a < b] + [("s3", "s3")]
    return pairs, spark.createDataFrame(pairs, "caller string, callee string")


def walked(pairs, start, without=None, most=99):
    """What is reached from start along pairs, with the number of steps, by breadth first."""
    found, now, k = {}, [start], 0
    while now and k < most:
        k += 1
        now = sorted({b for a, b in pairs if a in now and b not in found and b != start and without not in (a, b)})
        found.update(dict.fromkeys(now, k))
    return found


def test_dependents_paths_and_ablation(spark):
    pairs, edges = graph(spark)
    names, callers = {x for p in pairs for x in p}, [(b, a) for a, b in pairs]
    got = {tuple(r) for r in topology.dependents(edges).collect()}
    assert got == {(n, x) for n in names for x in walked(callers, n)}
    assert {tuple(r) for r in topology.dependencies(edges).collect()} == {(n, x) for n in names for x in walked(pairs, n)}
    paths = topology.call_paths(edges, 14).collect()
    assert {(a, b): len(p) - 1 for a, b, p in paths} == {(n, x): k for n in names for x, k in walked(pairs, n).items()}
    assert all((x, y) in pairs for _, _, p in paths for x, y in zip(p, p[1:]))
    groups = {1: ["s1", "s5", "s9", "s12"], 2: ["s13", "s4"], 3: ["s7"]}
    services = spark.createDataFrame([(k, s) for k, v in groups.items() for s in v], "label long, service string")
    got = {tuple(r) for r in topology.explained_without(services, edges).select("label", "removed", "dependent").collect()}
    want = {(k, gone, x) for k, v in groups.items() for gone in v for other in v if other != gone for x in walked(callers, other, gone)}
    assert got == want
    assert topology.dependents(edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["detected_signals", "payload_log_lines", "payload_alarms", "payload_dashboard_alerts", "payload_webhook_alerts",
                                  "payload_log_groups", "payload_otlp_logs", "payload_error_spans", "payload_generic", "ingest_checks",
                                  "environment_parts", "incident_drafts", "decision_times"])
def test_queries_equal_their_sql(spark, name):
    got = incident_queries.QUERIES[name](spark, FOLDER).toPandas()
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{FOLDER}/events.parquet'")
        want = db.sql(incident_queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda t: sorted(map(str, t[columns].astype(object).where(t[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["payload_log_lines", "payload_alarms", "payload_generic"])
def test_payloads_and_times_are_computed_once(spark, name):
    plan = incident_queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == 1 and plan.count("regexp_extract(raw") <= 6


def test_walks_read_the_spans_once(spark):
    assert not any("events" in f for f in incident_queries.span_graph(spark, FOLDER).inputFiles())


def test_spans_of_one_id_give_one_parent(spark):
    rows = [("b", "p", None, "1"), ("a", "p", None, "1"), ("c", "k", "p", "2"), ("c", "q", "none", "2")]
    spans = spark.createDataFrame([(s, "t", i, up, "x", 5, status, None) for s, i, up, status in rows],
                                  "service string, trace_id string, span_id string, parent_id string, name string, ts long, status string, message string")
    for some in (spans, spans.orderBy("service")):
        assert {(r.span_id, r.parent_service) for r in adapters.error_spans(some).collect()} == {("k", "a"), ("q", None)}
