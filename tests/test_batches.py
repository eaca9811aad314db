"""Explanations, comparisons and recorded days against plain readers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals import MIN, T0
from test_sweeps import grams, unit

from causeway.operators import explain, text_links
from causeway.sources import days


@pytest.fixture(scope="module")
def alerts():
    rng = np.random.default_rng(12)
    said = ["pool exhausted on db", "db pool exhausted again", "disk full", "slow query on api", None, ""]
    rows = [(k, T0 + int(rng.integers(0, 80)) * MIN // 4, str(rng.choice(["a", "b", "c"])), said[int(rng.integers(0, 6))]) for k in range(90)]
    labels = [(k, int(rng.integers(0, 5))) for k in range(60)] + [(89, 77)]
    return rows, labels


def measures(rows):
    df = {}
    for *_, s in rows:
        for t in grams(s):
            df[t] = df.get(t, 0) + 1
    vec = {k: unit({t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in grams(s).items()}) for k, _, _, s in rows}
    at = {k: ts for k, ts, *_ in rows}
    cos = lambda a, b: sum(x * vec[b].get(t, 0) for t, x in vec[a].items())
    far = lambda a, b: 1 - cos(a, b) + 2 * min(abs(at[a] - at[b]) / MIN / 6, 1) ** 2
    return at, cos, far


def test_explanations_equal_all_pairs(spark, alerts):
    rows, labels = alerts
    at, cos, far = measures(rows)
    df = spark.createDataFrame(rows, "id long, ts long, service string, text string").repartition(3)
    lab = spark.createDataFrame(labels, "id long, label long")
    got = {r.label: r for r in explain.explanation(df, lab, text_links.near(df)).collect()}
    service = {k: s for k, _, s, _ in rows}
    for label in {c for _, c in labels} - {77}:
        own = [k for k, c in labels if c == label]
        pairs = [(a, b) for a in own for b in own if a < b]
        gap = sum(abs(at[a] - at[b]) for a, b in pairs) / len(pairs) / MIN
        share = max(sum(service[k] == s for k in own) for s in "abc") / len(own)
        want = (max(0, 1 - gap / 6), sum(cos(*p) for p in pairs) / len(pairs), share, sum(round(far(*p), 9) <= 1 for p in pairs) / len(pairs))
        r = got.pop(label)
        assert (r.time_proximity, r.template_similarity, r.service_affinity, r.cohesion) == pytest.approx(want, abs=0.0051)
        assert r.n == len(own) and abs(r.confidence_pct - 25 * (r.time_proximity + r.template_similarity + r.service_affinity + r.cohesion)) <= 0.51
    assert not got


def test_nearly_inside(spark, alerts):
    rows, labels = alerts
    _, _, far = measures(rows)
    df, lab = spark.createDataFrame(rows, "id long, ts long, service string, text string"), spark.createDataFrame(labels, "id long, label long")
    got = {(r.label, r.place): (r.id, r.distance) for r in explain.nearly(df, lab).collect()}
    inside = dict(labels)
    want = {}
    for label in set(inside.values()):
        near = sorted((round(min(far(k, m) for m, c in labels if c == label), 7), k) for k, *_ in rows if k not in inside)
        want |= {(label, p): (k, pytest.approx(dist, abs=1e-6)) for p, (dist, k) in enumerate(near[:4], 1) if dist <= 1.6}
    assert got == want


def test_comparison_of_services(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "x"), (3, None)], "label long, service string")
    match = spark.createDataFrame([(1, "I1", 0.655), (2, "I1", 0.5), (3, "I1", 0.25), (4, "I2", 1.0)], "label long, item string, similarity double")
    known = spark.createDataFrame([("I1", "a"), ("I1", "b")], "item string, service string")
    got = {r.label: (r.overlap_pct, r.services) for r in explain.compared(m, match, known).collect()}
    assert got == {1: (100, "match"), 2: (100, "partial"), 3: (0, "different"), 4: (0, "different")}


def test_days_back_to_back_and_shift(spark):
    rows = spark.createDataFrame([("d1", 1, 100), ("d1", 2, 150), ("d2", 3, 10_000), ("d2", 4, 10_005), ("d3", 5, 90_000)], "day string, id long, ts long")
    got = {r.id: r.ts for r in days.concatenated(rows, 7).collect()}
    assert got == {1: 100, 2: 150, 3: 157, 4: 162, 5: 169}
    assert [r.ts for r in days.shifted(rows, 90_035, 10).orderBy("id").collect()] == [130, 180, 10_030, 10_035, 90_030]
    assert days.concatenated(rows.limit(0)).count() == days.shifted(rows.limit(0), 5).count() == 0


def test_sample_is_evenly_spaced(spark):
    rows = [(k, k, ["x", "y", None][k % 3 if k < 90 else 0], "WARNING" if k % 3 == 1 and k < 90 else "INFO") for k in range(400)]
    got = [r.id for r in days.sampled(spark.createDataFrame(rows, "id long, ts long, part string, level string").repartition(3), ["part", "level"], 100,
                                      F.col("level") == "WARNING", F.col("part").isNull()).collect()]
    strata = {}
    for k, _, part, level in rows:
        strata.setdefault((part, level), []).append(k)
    kept = {k: v for k, v in strata.items() if k[1] == "WARNING"}
    rest = {k: v for k, v in strata.items() if k not in kept}
    spare = 100 - sum(map(len, kept.values())) - 5 * len(rest)
    weight = {k: math.sqrt(len(v) - 5) * (0.35 if k[0] is None else 1) for k, v in rest.items()}
    want = [x for v in kept.values() for x in v]
    for k, v in rest.items():
        take = min(5 + int(spare * weight[k] / sum(weight.values())), len(v))
        want += [v[i * len(v) // take] for i in range(take)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("part", [100_000, 7])
def test_schedule_keeps_a_rhythm(spark, part):
    rng = np.random.default_rng(5)
    rows = [(k, T0 + int(x) * 1_000_000) for k, x in enumerate([*rng.integers(0, 9000, 80), *[8999] * 30, *[100] * 3])]
    got = {r.id: r.at for r in days.schedule(spark.createDataFrame(rows, "id long, ts long").repartition(4), part=part).collect()}
    newest = max(t for _, t in rows)
    late = sorted((t, k) for k, t in rows if t >= newest - 50 * MIN)
    want, prev = {k: 0.0 for k, t in rows if t < newest - 50 * MIN}, 0.0
    for t, k in late:
        prev = max((t - late[0][0]) / max(newest - late[0][0], 1) * 23 + 0.5, prev + 0.08)
        want[k] = min(prev, 24.0)
    assert got == pytest.approx(want, abs=2e-6)


def test_observed_part_of_a_graph(spark):
    e = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(20)] * 2, "caller string, callee string")
    some = {tuple(r) for r in days.observed(e, 0.3, 1).collect()}
    assert len(some) == 6 and some == {tuple(r) for r in days.observed(e.repartition(5), 0.3, 1).collect()}
    assert some != {tuple(r) for r in days.observed(e, 0.3, 2).collect()} and days.observed(e, 0.01).count() == 1 and days.observed(e, 1.0).count() == 20
