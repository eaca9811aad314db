"""Tickets: prose, lines, keys, comments and the event log."""

from pyspark.sql import functions as F
from test_evidence import members
from test_signals import graph

from causeway.operators import causal, evidence, severity, tickets, topology


def test_prose_and_lines(spark):
    m, g = members(spark), graph(spark)
    scored = causal.scores(m, g, topology.dependents(g))
    roots, telling = causal.root_causes(scored), causal.representative(m)
    impact = severity.impact(m, roots, topology.dependents(g), spark.createDataFrame([("db", 0.9)], "service string, criticality double"))
    root = roots.first().root
    told = tickets.prose(m, roots, telling, impact).cache()
    p = told.first()
    others = [s for s in ("api", "db", "web") if s != root]
    assert p.summary.startswith("3 correlated signals across 3 service(s), scored P") and p.summary.endswith(f"knock-on failures in {', '.join(others)}.")
    assert p.hypothesis.startswith(f"Suspected: {root} (") and "unconfirmed until checked" in p.hypothesis
    assert p.steps[0].startswith(f"Inspect {root} first") and p.steps[-1].startswith(f"Confirm {', '.join(others)} recover once {root}")
    got = [r.line for r in tickets.lines(m, evidence.drafts(m, roots, telling), told, impact).orderBy("place").collect()]
    assert got[0].startswith("# [DRAFT] ") and got[-1] == f"{len(p.steps)}. {p.steps[-1]}"
    table = got[got.index("|---|---|---|---|") + 1 :][:3]
    assert table[0] == "| 00:00:00 | cloudwatch_metric | db | DatabaseConnections = 200 (threshold 100) (x2) |" and table[2].startswith("| 00:02:00 | app_log | web | api slow")
    assert len(got) == 20 + 3 + len(p.steps)
    assert tickets.lines(m.limit(0), evidence.drafts(m, roots, telling).limit(0), told.limit(0), impact.limit(0)).count() == 0


def test_keys_go_on_and_approval_is_idempotent(spark):
    have = spark.createDataFrame([("d1", 7, "TKT-0007")], "draft_id string, number long, key string")
    new = tickets.issued(have, spark.createDataFrame([("d3",), ("d1",), ("d2",), ("d3",)], "draft_id string"))
    assert {tuple(r) for r in new.collect()} == {("d2", 8, "TKT-0008"), ("d3", 9, "TKT-0009")}
    assert tickets.issued(have.limit(0), spark.createDataFrame([("a",)], "draft_id string")).first().key == "TKT-0001"
    done, refused = tickets.commented(have, spark.createDataFrame([("d1", 5, "more"), ("dx", 6, "no")], "draft_id string, at long, body string"))
    assert [r.key for r in done.collect()] == ["TKT-0007"] and [r.draft_id for r in refused.collect()] == ["dx"]


def test_event_log_keeps_its_order(spark, tmp_path):
    log = tickets.EventLog(f"file://{tmp_path}/log")
    assert log.load(spark).count() == 0
    lot = lambda *kinds: spark.createDataFrame([(k, "{}", i) for i, k in enumerate(kinds)], "kind string, payload string, at int")
    log.add(lot("submit", "approve"), "at")
    log.add(lot("reject"), "at")
    log.add(lot(*"abc").repartition(3), F.desc("at"))
    assert [(r.seq, r.kind) for r in log.load(spark).orderBy("seq").collect()] == [(1, "submit"), (2, "approve"), (3, "reject"), (4, "c"), (5, "b"), (6, "a")]
    log.clear(spark)
    assert log.load(spark).count() == 0
