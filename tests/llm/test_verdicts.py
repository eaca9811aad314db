"""Held-out figures of what is learnt: the quality rules' verdict and the compression classifier."""

import numpy as np
import pytest

from causeway.llm import compression_quality, quality_rules


def counts(rng, n, kind):
    words = rng.integers(60, 900, n)
    out = np.column_stack([words, words * rng.uniform(4.2, 5.4, n), rng.poisson(1.0, n), rng.poisson(0.3, n), words * rng.uniform(0, 0.2, n)])
    if kind == "symbols":
        out[:, 2] = words * rng.uniform(0.3, 1.0, n)
    if kind == "letters":
        out[:, 1] = words * rng.uniform(1.0, 1.6, n)
    return out.astype(np.int64)


@pytest.mark.parametrize("kind", ["symbols", "letters"])
def test_forests_judge_rows_they_never_saw(kind):
    rng = np.random.default_rng(5)
    make = lambda n: (np.concatenate([counts(rng, n, ""), counts(rng, n // 10, kind)]), np.arange(n + n // 10) < n)
    x, good = make(1500)
    model = quality_rules.calibrated(x, good, rng.random(len(x)) < 0.5)
    assert model.used and len(model.used[0][0]) > 1  # statistics are judged jointly
    unseen, good = make(1500)
    score, odd = model.judge(unseen)
    assert odd[~good].mean() > 0.95 and odd[good].mean() < 0.02
    # brute force: path lengths walked row by row
    columns, forest, threshold = model.used[0]
    z = ((quality_rules.features(unseen) - model.middle) / model.spread)[:, columns]
    for k in range(0, len(z), 97):
        total = 0.0
        for t in range(len(forest.feature)):
            node = 0
            while forest.feature[t, node] >= 0:
                node = forest.left[t, node] + int(z[k, forest.feature[t, node]] >= forest.cut[t, node])
            total += forest.path[t, node]
        assert np.isclose(2.0 ** (-total / len(forest.feature) / forest.norm), forest.scores(z[k : k + 1])[0])


def test_nothing_is_odd_without_both_kinds():
    rng = np.random.default_rng(1)
    x = counts(rng, 100, "")
    for good in (np.ones(100, bool), np.zeros(100, bool)):
        assert not quality_rules.calibrated(x, good, rng.random(100) < 0.5).judge(x)[1].any()
    assert len(quality_rules.NONE.judge(x[:0])[0]) == 0


def test_compression_on_unseen_texts(spark):
    rng = np.random.default_rng(2)
    vocabulary = {1: [f"river{k}" for k in range(300)], 0: [f"xq{k}z" for k in range(300)]}
    rows = [(k, " ".join(rng.choice(vocabulary[k % 4 > 0], rng.integers(5, 200))), int(k % 4 > 0)) for k in range(600)]
    rows += [(700, None, 1), (701, "", 0), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    got = compression_quality.classify(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    first = {tuple(r) for r in got.collect()}
    assert first == {tuple(r) for r in compression_quality.classify(df.select("doc_id", "text").repartition(7), df.select("doc_id", "quality")).collect()}
    truth = {k: q for k, t, q in rows if t}
    seen = [(truth[d], s) for d, h, s, _ in first if h and d in truth]
    good, bad = [s for q, s in seen if q], [s for q, s in seen if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.99 and np.mean([(s >= 0.5) == q for q, s in seen]) > 0.95
