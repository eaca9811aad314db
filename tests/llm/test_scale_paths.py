"""The ways taken for hot keys and clashing names give the same results as the plain ones."""

from collections import Counter

import numpy as np
import pytest

from causeway.llm import jaccard_join, mixing, nn_descent, suffix_dedup


def test_windows_dealt_by_content(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = word(60)
    rows = [(k, word(50) + shared + (word(90) if k % 3 else "x" * 90) + word(20)) for k in range(60)]
    rows += [(100 + k, "one passage of a hundred bytes and more, which many documents of this corpus have in common; it goes on.") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Counter(tuple(r) for r in suffix_dedup.dedup(table).collect())
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3)
    monkeypatch.setattr(suffix_dedup, "DEAL", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    assert Counter(tuple(r) for r in suffix_dedup.dedup(table).collect()) == plain
    assert sum(n for (_, _, removed, *_), n in plain.items() if removed) >= 38


@pytest.mark.parametrize("part", [512, 7])
def test_components_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(nn_descent, "PART", part)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 16))
    x = np.concatenate([b + rng.normal(scale=0.1, size=(12, 16)) for b in base] + [rng.normal(size=(30, 16)), base[:1], base[:1]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(link, root, len(x)).min(1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(df).collect()}
    assert got == {k: (int(link[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(x))}


def test_columns_with_clashing_names(spark):
    schema = "doc_id long, text string, source string, cdf string, of_source string, steps int, copy int, kept_id long, named int, at int, __row int, __source string"
    rows = [(k, f"words of text number {k % 3} go on and on here", "s%d" % (k % 2), "c", "o", 1, 2, 3, 4, 5, 6, "z") for k in range(12)]
    docs = spark.createDataFrame([*rows, rows[0], (None,) * 12], schema)
    out = mixing.mixed(docs)
    assert set(docs.columns) | {"mix_key"} == set(out.columns) and out.count() > 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2]
    assert kept.where("doc_id is null").count() == 1


def test_one_large_cell(spark, monkeypatch):
    """A group of near copies in one cell, split into blocks by size and smallest shingle."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 400)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 900, 120)]
    rows = []
    for k in range(40):
        copy = list(base)
        for i in rng.integers(0, 120, 2):
            copy[i] = f"z{k}-{i}"
        rows.append((k, " ".join(copy[: 120 - (k % 20)])))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    assert got.component_id.to_dict() == root and got.n_shingles.to_dict() == {d: len(s) for d, s in sets.items()}


def test_suffixes_are_sorted_no_further_than_a_window(monkeypatch):
    """Windows of strings of two letters and of long copies, against their bytes; suffixes aren't sorted to their ends."""
    for whole in ("_sorted", "common"):
        monkeypatch.setattr(suffix_dedup.SuffixArray, whole, None)
    rng = np.random.default_rng(7)
    few = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(0, 60, 30)]
    for depth in (8, 9, 23):
        sa = suffix_dedup.SuffixArray(few, depth)
        got = [few[sa.of[p]][p - sa.begin[sa.of[p]] :][:depth] for p in sa.order]
        assert got == sorted(s[k : k + depth] for s in few for k in range(len(s) - depth + 1))
        assert sa.group.tolist() == [got.index(x) for x in got]
    width = suffix_dedup.MIN
    text = bytes(rng.integers(0, 256, 400).astype(np.uint8))
    strings = [text[:180], text[40:160], bytes([0] * 150), text[60:240], text[20:140][::-1], bytes([0] * 130), text[:99], b"", text[120:300]]
    place = np.arange(len(strings)) * 1000
    begin = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    seen, want = set(), set()
    for s, b in zip(strings, begin.tolist(), strict=False):
        for k in range(len(s) - width + 1):
            if s[k : k + width] in seen:
                want.add(b + k)
            seen.add(s[k : k + width])
    assert set(np.flatnonzero(suffix_dedup.repeated(strings, place)).tolist()) == want and len(want) > 100
    assert not len(suffix_dedup.repeated([], np.zeros(0, np.int64))) and not suffix_dedup.repeated([b"", b"ab"], np.arange(2)).any()
