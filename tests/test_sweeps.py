"""Spanning forests, runs in time, scores of configurations, wording and time, and the library, against plain readers."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_signals import MIN, T0

from causeway.operators import sweeps, text_links


def grouped(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


@pytest.fixture(scope="module")
def weighted():
    rng = np.random.default_rng(6)
    return [(int(a), int(b), round(float(w), 2)) for a, b, w in zip(rng.integers(0, 90, 160), rng.integers(0, 90, 160), rng.random(160), strict=True)]


def test_forest_has_the_clusters_of_every_threshold(spark, weighted):
    forest = sweeps.spanning_forest(spark.createDataFrame(weighted, "a long, b long, w double").repartition(4))
    rows = [tuple(r) for r in forest.collect()]
    nodes = {x for a, b, _ in weighted if a != b for x in (a, b)}
    assert len(rows) == len(nodes) - len(set(grouped(nodes, [(a, b) for a, b, _ in weighted if a != b]).values()))
    got = defaultdict(dict)
    for r in sweeps.at_thresholds(spark.createDataFrame(rows, "a long, b long, w double"), [0.1, 0.5, 0.57, 0.9]).collect():
        got[r.config][r.id] = r.label
    for t in (10, 50, 57, 90):
        links = [(a, b) for a, b, w in weighted if a != b and round(100 * w) >= t]
        assert got[t] == grouped({x for e in links for x in e}, links)
    assert sweeps.spanning_forest(spark.createDataFrame([(1, 1, 0.5), (None, 2, 0.5)], "a long, b long, w double")).count() == 0


def test_runs_in_time_over_slots(spark):
    rng = np.random.default_rng(1)
    limit = math.floor(-math.log(0.45) * 6e7)
    ts = sorted(T0 + int(x) for x in rng.integers(0, 300, 120) * MIN) + [T0 + 3600_000_000 * 5 - 1, T0 + 3600_000_000 * 5 - 1 + limit]
    rows = list(enumerate(ts))
    got = {r.id: r.label for r in sweeps.by_time_alone(spark.createDataFrame(rows, "id long, ts long").repartition(3)).collect()}
    links = [(a, b) for (a, s), (b, t) in zip(sorted(rows, key=lambda r: (r[1], r[0])), sorted(rows, key=lambda r: (r[1], r[0]))[1:], strict=False) if t - s <= limit]
    assert got == grouped({x for e in links for x in e}, links)


def test_scores_count_pairs(spark):
    clusters = [("x", k, lab) for k, lab in enumerate("aabbbc")] + [("y", k, "one") for k in range(3)]
    truth = [(k, t, k % 2) for k, t in enumerate(["s", "s", "s", "u", None, "u"])]
    got = {(r.config): (r.precision, r.recall, r.f1, r.purity) for r in sweeps.scores(
        spark.createDataFrame([(k, t) for k, t, _ in truth], "id long, truth string"), spark.createDataFrame(clusters, "config string, id long, label string")).collect()}
    assert got == {"x": (0.25, 0.25, 0.25, 0.8), "y": (1.0, 0.75, 0.857143, 1.0)}
    daily = sweeps.scores(spark.createDataFrame(truth, "id long, truth string, day long"), spark.createDataFrame(clusters, "config string, id long, label string"), "day")
    assert {(r.config, r.day) for r in daily.collect()} == {("x", 0), ("x", 1), ("y", 0), ("y", 1)}


def grams(text):
    w = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(w) + Counter(" ".join(p) for p in zip(w, w[1:], strict=False))


def unit(v):
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()} if size else {}


def test_near_by_wording_and_time(spark):
    rng = np.random.default_rng(3)
    said = ["pool exhausted on db", "db pool exhausted again", "disk full", "slow query on api", "api slow", None, "", "x", "cache miss"]
    rows = [(k, T0 + int(rng.integers(0, 120)) * MIN // 4, said[int(rng.integers(0, 9))]) for k in range(160)]
    alerts = spark.createDataFrame([(*r, "extra") for r in rows], "id long, ts long, text string, slot string").repartition(4)
    df = Counter(t for _, _, s in rows for t in grams(s))
    vec = {k: unit({t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in grams(s).items()}) for k, _, s in rows}
    for eps in (1.0, 0.6, 1.6):
        want = {}
        for a, s, _ in rows:
            for b, t, _ in rows:
                cos = sum(x * vec[b].get(k, 0) for k, x in vec[a].items())
                dist = 1 - cos + 2 * min(abs(s - t) / MIN / 6, 1) ** 2
                if a < b and round(dist, 9) <= eps:
                    want[a, b] = pytest.approx(dist, abs=1e-7)
        got = {(r.a, r.b): r.distance for r in text_links.near(alerts, eps).collect()}
        assert got == want and len(got) > 100
    assert text_links.near(alerts.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.25, 0.4])
def test_library_match_is_the_best_of_all(spark, least):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(40)]
    line = lambda n: " ".join(vocabulary[int(k) % 40] for k in rng.geometric(0.08, n))
    library = [(i, p, line(5)) for i in range(15) for p in range(3)]
    alerts = [(c, p, library[int(rng.integers(0, 45))][2] if rng.random() < 0.3 else line(6)) for c in range(40) for p in range(4)] + [(99, 0, None), (98, 0, "unknown words")]
    df = Counter(t for i in range(15) for t in {t for j, _, s in library if j == i for t in grams(s)})
    idf = {t: math.log(16 / (1 + n)) + 1 for t, n in df.items()}

    def centroid(texts):
        total = Counter()
        for s in texts:
            for t, x in unit({t: n * idf[t] for t, n in grams(s).items() if t in idf}).items():
                total[t] += x
        return unit(total)

    items = {i: centroid([s for j, _, s in library if j == i]) for i in range(15)}
    want = {}
    for c in {a[0] for a in alerts}:
        v = centroid([s for k, _, s in alerts if k == c])
        like = {i: round(sum(x * w.get(t, 0) for t, x in v.items()), 6) for i, w in items.items()}
        best = min(like, key=lambda i: (-like[i], i))
        if like[best] >= least:
            want[c] = (best, pytest.approx(like[best], abs=2e-6))
    found = text_links.Library(spark.createDataFrame(library, "item long, part int, text string")).best(
        spark.createDataFrame(alerts, "label long, part int, text string"), least)
    assert {r.label: (r.item, r.similarity) for r in found.collect()} == want and len(want) > (20 if least < 0.3 else 3)


def test_library_terms_are_met_by_broadcast_and_pairs_get_no_vectors(spark, monkeypatch):
    library = spark.createDataFrame([(i, 0, f"common topic{i} detail{i}") for i in range(30)], "item long, part int, text string")
    alerts = spark.createDataFrame([(c, p, f"common topic{c % 30} other{p}") for c in range(60) for p in range(3)] + [(99, 0, "unknown")], "label long, part int, text string")
    whole = text_links.Library(library).best(alerts)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in plan and plan.count("strategy=broadcast") == 2
    monkeypatch.setattr(text_links, "SMALL", 0)
    got = {(r.label, r.item, r.similarity) for r in whole.collect()}
    assert {x[:2] for x in got} == {(c, c % 30) for c in range(60)}
    assert {(r.label, r.item, r.similarity) for r in text_links.Library(library).best(alerts).collect()} == got


def test_alerts_are_not_spread_over_the_texts_like_their_own(spark):
    alerts = spark.createDataFrame([(k, k * 60_000_000, f"pool full on db{k % 5}") for k in range(40)], "id long, ts long, text string")
    lines = text_links.near(alerts)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    spread = [k for k, x in enumerate(lines) if "Generate explode" in x]
    assert spread
    for k in spread:  # what is spread over slots is texts, before anything is joined to them
        below = next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(lines[k])), len(lines))
        assert not any("Join" in x for x in lines[k + 1 : below])
