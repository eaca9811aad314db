"""Bridges, the order of splits and the checks after them, against plain readers."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals import MIN, T0, graph

from causeway.operators import bridges, incidents, pairs, topology, validated
from causeway.operators.components import components


def pieces(nodes, links):
    left, out = set(nodes), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            part.add(x)
            for a, b, _ in links:
                for p, q in ((a, b), (b, a)):
                    if p == x and q in left:
                        left.discard(q)
                        todo.append(q)
        out.append(sorted(part))
    return out


def slow_split(nodes, links):
    """Every signal of a part is left out in turn, until none is a bridge."""
    done, todo = [], [sorted(nodes)]
    while todo:
        now = todo.pop()
        own = [e for e in links if e[0] in now and e[1] in now]
        cut = None
        if len(now) >= 5 and len(pieces(now, own)) == 1:
            for x in now:
                mine = [((b if a == x else a), w) for a, b, w in own if x in (a, b)]
                rest = pieces([y for y in now if y != x], [e for e in own if x not in e[:2]])
                if max(w for _, w in mine) < 0.5 and sum(len(p) >= 2 for p in rest) >= 2:
                    friend = min(mine, key=lambda e: (-e[1], e[0]))[0]
                    cut = [[*p, x] if friend in p else p for p in rest]
                    break
        if cut:
            todo += cut
        else:
            done.append(now)
    return {frozenset(p) for p in done}


def graphs(seed):
    """Clusters of groups held together by single signals, chains, and random links."""
    rng = np.random.default_rng(seed)
    members, links, base = [], [], 0
    for label in range(14):
        n = int(rng.integers(1, 22))
        ids = [base + k for k in range(n)]
        base += 100
        found = {}
        if label % 3 == 0:  # a chain
            found = {(ids[k], ids[k + 1]): 0.46 for k in range(n - 1)}
        else:
            for k in range(1, n):
                found[tuple(sorted((ids[int(rng.integers(max(0, k - 3), k))], ids[k])))] = float(rng.choice([0.45, 0.46, 0.48, 0.9]))
            for _ in range(n // (1 + label % 4) if label % 3 == 1 else 0):
                a, b = sorted(int(x) for x in rng.integers(0, n, 2))
                if a < b:
                    found.setdefault((ids[a], ids[b]), float(rng.choice([0.45, 0.47, 0.8])))
        if label == 5 and n > 3:  # not held together
            found = {k: w for k, w in found.items() if ids[-1] not in k}
        members += [(x, label) for x in ids]
        links += [(a, b, w) for (a, b), w in found.items()]
    return members, links


def test_solver_equals_leaving_out_each_signal():
    split = 0
    for seed in range(60):
        members, links = graphs(seed)
        for label in range(14):
            ids = [x for x, k in members if k == label]
            own = [e for e in links if e[0] in ids]
            got = {frozenset(p) for p in bridges.solve(ids, own)}
            assert got == slow_split(ids, own)
            split += len(got) > 1
    assert split > 100


@pytest.mark.parametrize("most", [10**6, 12])
def test_bridges_by_groups_and_by_joins(spark, most):
    members, links = graphs(7)
    m = spark.createDataFrame(members, "id long, label long").repartition(3)
    e = spark.createDataFrame(links, "a_id long, b_id long, sim double").repartition(3)
    got = defaultdict(set)
    for r in bridges.split_weak_bridges(m, e, most).collect():
        got[r.label, r.part].add(r.id)
    assert sum(map(len, got.values())) == len(members) and all(p == min(v) for (_, p), v in got.items())
    for label in range(14):
        ids = [x for x, k in members if k == label]
        want = slow_split(ids, [x for x in links if x[0] in ids])
        assert {frozenset(v) for (k, _), v in got.items() if k == label} == want
    if most == 12:
        assert bridges.split_weak_bridges(m.limit(0), e.limit(0), 0).count() == 0


def rows(spark, n=70, seed=3):
    rng = np.random.default_rng(seed)
    services = ["web", "api", "db", "cache", "queue"]
    out = []
    for k in range(n):
        s = services[int(rng.integers(0, 5))]
        source = str(rng.choice(["app_log", "cloudwatch_metric", "grafana_alert"]))
        level = str(rng.choice(["high", "warning"], p=[0.6, 0.4]))
        said = str(rng.choice(["pool exhausted", "slow query", "timeout calling db", "disk full", "latency up"]))
        out.append((k, T0 + int(rng.integers(0, 50)) * MIN // 2, s, str(rng.choice(["pool", "http", "q"])), source, level,
                    1 if level == "high" else 2, said, said, "cpu" if source == "cloudwatch_metric" else None,
                    float(rng.choice([0.55, 0.6, 0.9])), [None, "prod", "prod", "staging"][int(rng.integers(0, 4))]))
    return spark.createDataFrame(out, "id long, ts long, service string, component string, source string, severity string, sev_rank int, message string,"
                                 "template string, metric string, anomaly_score double, environment string").withColumns(
        {"trace_id": F.lit(None).cast("string"), "mention": F.lit(None).cast("string"), "value": F.lit(None).cast("double"),
         "threshold": F.lit(None).cast("double")})


def slow_verdicts(members, links):
    """The worklist, one candidate after another."""
    by_id = {r.id: r for r in members}
    groups = defaultdict(list)
    for r in members:
        groups[r.label].append(r.id)
    todo, out = [(ids, frozenset()) for ids in groups.values()], Counter()
    while todo:
        ids, how = todo.pop()
        own = [e for e in links if e[0] in ids and e[1] in ids]
        stated = sorted({by_id[x].environment for x in ids} - {None})
        if len(stated) > 1 and "env" not in how:
            most = max(stated, key=lambda v: sum(by_id[x].environment == v for x in ids))
            todo += [([x for x in ids if (by_id[x].environment or most) == v], how | {"env"}) for v in stated]
            continue
        cut = slow_split(ids, own)
        if len(cut) > 1:
            todo += [(sorted(p), how | {"bridge"}) for p in cut]
            continue
        seen = {(by_id[x].service, by_id[x].source, by_id[x].template if "log" in by_id[x].source else by_id[x].metric or by_id[x].message[:60]) for x in ids}
        n = len(ids)
        checks = (n >= 2, n <= 3 or len(own) / (n * (n - 1) / 2) >= 0.25, max(by_id[x].anomaly_score for x in ids) >= 0.6,
                  len(seen) >= 2 or all(by_id[x].sev_rank <= 1 for x in ids))
        out[min(ids), n, "env" in how, "bridge" in how, checks] += 1
    return out


def test_validated_equals_a_worklist(spark):
    s, g = rows(spark), graph(spark)
    found = pairs.links(pairs.similarity(pairs.gated(pairs.candidates(s, g), g))).select("a_id", "b_id", "gate", "sim").cache()
    # weaker and fewer links, so that clusters hang by single signals
    found = found.where("(a_id * 7 + b_id * 11) % 5 < 2").withColumn("sim", F.when((F.col("a_id") + F.col("b_id")) % 4 == 0, F.col("sim")).otherwise(0.46))
    m = s.join(components(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).withColumnRenamed("id", "lid"), F.col("id") == F.col("lid")).drop("lid")
    verdicts, signals = validated.validated(m, found, topology.hops(g))
    got = Counter((r.part, r.n_signals, r.by_environment, r.at_bridge, (r.large_enough, r.coherent, r.supported, r.independent)) for r in verdicts.collect())
    assert got == slow_verdicts(m.collect(), [tuple(r) for r in found.select("a_id", "b_id", "sim").collect()])
    assert verdicts.where("accepted <> (confidence is not null)").count() == 0
    assert signals.count() == m.count() and len(got) > 3
    assert validated.validated(m.limit(0), found.limit(0), topology.hops(g))[0].count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        components(e, rounds=2)


def test_confidence_of_a_cluster_of_many_members(spark):
    """Pair numbers of 50,000 members don't fit in an int; only the first pairs count, those of the first member."""
    n = 50_000
    m = spark.range(n).select("id", F.lit(0).cast("long").alias("label"), F.when(F.col("id") <= 1000, "a").otherwise("b").alias("service"), F.col(
        "id").alias("ts"), F.lit(0.7).alias("anomaly_score"))
    links = spark.createDataFrame([(0, 1, "same service", 0.8)], "a_id long, b_id long, gate string, sim double")
    near = spark.createDataFrame([("a", "a", 0), ("b", "b", 0)], "a string, b string, hops int")
    got = incidents.confidence_terms(m, links, near).first()
    assert (got.label, got.topology, got.evidence) == (0, 1000 / incidents.PAIR_CAP, round(1.6 / n, 9))


def test_confidence_counts_every_pair_of_a_cluster(spark):
    """101 members of four services, one outside the graph: 5,050 pairs, of which those after the 2,500th count too."""
    service = lambda k: ("a", "b", "c", "lone")[0 if k < 40 else 1 if k < 70 else 2 if k < 90 else 3]
    rows = [(k, 0, service(k), k, 0.7) for k in range(101)] + [(500, 500, "a", 1, 0.7)]
    m = spark.createDataFrame(rows, "id long, label long, service string, ts long, anomaly_score double")
    links = spark.createDataFrame([(0, 1, "same service", 0.8)], "a_id long, b_id long, gate string, sim double")
    near = topology.hops(spark.createDataFrame([("a", "b"), ("b", "x"), ("x", "c")], "caller string, callee string"))
    apart = {(r.a, r.b): r.hops for r in near.collect()}
    pairs_ = [apart.get((service(i), service(j)), 9) <= 2 for i in range(101) for j in range(i + 1, 101)]
    got = {r.label: r for r in incidents.confidence_terms(m, links, near, None).collect()}
    assert (got[0].topology, got[500].topology) == (sum(pairs_) / len(pairs_), 1.0)
    assert got[0].topology != sum(pairs_[:2500]) / 2500
    sure = {r.label: r.confidence for r in incidents.correlation_confidence(m, links, near).collect()}
    want = 0.40 * got[0].density + 0.35 * sum(pairs_) / len(pairs_) + 0.25 * got[0].evidence
    assert sure[0] == round(want + 1e-9, 6)


def test_strong_links_are_no_part_of_the_search(spark, monkeypatch):
    """Two groups of 30 tied closely, a weak signal between them and others at one of them: of 870 links two are searched."""
    monkeypatch.setattr(bridges, "split_large", None)
    groups = [range(100, 130), range(200, 230)]
    links = [(a, b, 0.9) for g in groups for a in g for b in g if a < b]
    links += [(7, 101, 0.46), (7, 205, 0.48), (3, 110, 0.47), (3, 111, 0.47), (5, 220, 0.49)]
    nodes = sorted({x for e in links for x in e[:2]})
    m = spark.createDataFrame([(x, 0) for x in nodes], "id long, label long")
    got = defaultdict(list)
    for r in bridges.split_weak_bridges(m, spark.createDataFrame(links, "a_id long, b_id long, sim double"), 4).collect():
        got[r.part].append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {min(p): sorted(p) for p in slow_split(nodes, links)}
    assert set(got) == {3, 5}
