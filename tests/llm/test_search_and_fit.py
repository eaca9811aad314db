"""Hard negatives, lexical search and best-two-fit against brute force, with nulls, ties, repeats and extra columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from causeway.llm import best_two_fit, hard_negatives, lexical_search
from causeway.llm.tokens import tokenizer_path

VECTORS = "vec_id long, embedding array<float>, label int, row string, score int"


def brute_negatives(rows):
    able = [(v, (lab + 1) % 10 if v % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e, lab in rows
            if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for a, label, e in {(v, lab, tuple(e)) for v, lab, e in able if v % 100 == 0}:
        same_length = [(-sum(x * y for x, y in zip(e, f, strict=True)), v, lab) for v, lab, f in able if len(f) == len(e)]
        order = sorted(same_length)
        for s, p, _ in [x for x in order if x[2] == label and x[1] != a][:5]:
            fit = [x for x in order if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += Counter((a, p, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 8))
    rows = []
    for k in range(700):
        e = centres[k % 4] + 0.6 * rng.normal(size=8)
        rows.append((k, [float(x) for x in e.astype(np.float32)], int(rng.integers(0, 3))))
    rows += [(k, [0.5] * 8, k % 3) for k in range(800, 1100)]  # ties, anchors 800, 900 and 1000 among them
    rows += [(1200, [0.5] * 8, None), (1300, None, 1), (1400, [math.nan] * 8, 1), (1500, [None, *[0.5] * 7], 1),
             (1600, [math.inf] * 8, 1), (None, [0.5] * 8, 1), (1700, [], 1), (1800, [1.0, 2.0], 1), (1801, [1.0, 2.0], 1),
             (1802, [0.5, 1.0], 2), (1802, [0.5, 1.0], 2), (1900, [-0.5] * 8, 9), (2100, [0.0] * 8, 1)]
    return rows


@pytest.mark.parametrize("tile", [(16_384, 16_384), (3, 100)])
def test_hard_negatives(spark, monkeypatch, vectors, tile):
    monkeypatch.setattr(hard_negatives, "GROUP", tile[0])
    monkeypatch.setattr(hard_negatives, "BLOCK", tile[1])
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], VECTORS).repartition(5)
    got = Counter(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == brute_negatives(vectors) and len(got) > 400


def test_hard_negatives_empty_and_exact_sums(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(df).count() == 0
    a = np.array([[2**40, 3], [5, -7]])
    assert (hard_negatives.scores(a, a) == a @ a.T).all()
    small = np.random.default_rng(0).integers(-500, 500, (20, 9))
    assert (hard_negatives.scores(small, small) == small @ small.T).all()


def brute_search(docs, items, k=10, once=True):
    def split(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    counts = [(d, Counter(split(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(split(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total if c else 0
            score = sum((1 if once else words[t]) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                found.append((-score, math.inf if d is None else d))
        out += [(i, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    vocabulary = [f"t{k}" for k in range(300)] + ["Ñandú", "été", "a_b", "X9"]
    # a word in a third of all places
    draw = lambda n: " ".join(vocabulary[min(int(k), 303)] if k >= 150 else "Common" for k in rng.integers(0, 450, n))
    docs = [(d, draw(int(n))) for d, n in enumerate(rng.integers(1, 60, 400))]
    docs += [(500, None), (501, ""), (502, "!!! ...\n"), (503, draw(30_000)), (None, docs[7][1]), (504, docs[7][1]), (504, docs[7][1])]
    items = [(0, docs[7][1]), (1, draw(12)), (2, None), (3, ""), (4, "absent"), (5, "common COMMON common été"), (None, draw(5)),
             (6, "t1 t2"), (6, "t2 t3"), (7, docs[503 - 500 + 400][1])]
    return docs, items


@pytest.mark.parametrize(("once", "small"), [(True, False), (True, True), (False, False)])
def test_lexical_search(spark, monkeypatch, texts, once, small):
    docs, items = texts
    if small:  # several passes, blocks of a few documents
        monkeypatch.setattr(lexical_search, "ITEM_TERMS", 60)
        monkeypatch.setattr(lexical_search, "ROWS", 7)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, n int")
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = Counter(tuple(r) for r in lexical_search.search(frame.repartition(4), asked, once=once).collect())
    assert got == brute_search(docs, items, once=once)


def test_equal_hashes_are_not_equal_terms():
    words = [b"one", b"two", b"three"]
    data = np.frombuffer(b"two one twx three", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 17])
    hit, at = lexical_search.Vocabulary(dict(enumerate(words))).find(np.array([1, 0, 1, 2], np.uint64), starts, ends, data)
    assert hit.tolist() == [0, 1, 3] and at.tolist() == [1, 0, 2]


def test_lexical_search_empty(spark, texts):
    frame = spark.createDataFrame(texts[0], "doc_id long, text string")
    asked = spark.createDataFrame(texts[1], "item_id long, text string")
    assert lexical_search.search(frame.limit(0), asked).count() == 0
    assert lexical_search.search(frame, asked.limit(0)).count() == 0


def one_by_one(sizes, length):
    """Best-two-fit, one bin after another, over a list of sizes."""
    left, bins = Counter(sizes), []
    while +left:
        left, bin_ = +left, []
        while fits := [s for s in left.elements() if s <= length - sum(bin_)]:
            bin_.append(max(fits))
            left = left - Counter([bin_[-1]])
        while sum(bin_) < length:
            low = min(bin_)
            room = length - sum(bin_) + low
            pairs = [(a + b, max(a, b), min(a, b)) for a in left for b in left
                     if low < a + b <= room and (a != b or left[a] > 1)]
            if not pairs:
                break
            _, a, b = max(pairs)
            bin_.remove(low)
            left = left + Counter([low]) - Counter([a, b])
            bin_ = sorted([*bin_, a, b], reverse=True)
        bins.append(tuple(sorted(bin_, reverse=True)))
    return Counter(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(5, 40))
    sizes = rng.integers(1, rng.integers(2, length + 2), 150).tolist()
    got = Counter()
    for bin_, n in best_two_fit.plan(Counter(sizes), length):
        got[bin_] += n
    assert got == one_by_one(sizes, length)


def test_two_pieces_replace_one_that_leaves_a_gap():
    # 6 + 3 leaves 1; 2 + 2 in the place of 3 fill the bin
    assert best_two_fit.plan({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]
    many = best_two_fit.plan({s: 10**9 for s in range(1, 1025)})
    assert sum(n * sum(b) for b, n in many) == 10**9 * 1024 * 1025 // 2 and len(many) < 5000


def test_best_two_fit(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 900, n))
    rows = [(d, word(int(n))) for d, n in enumerate(rng.integers(1, 500, 200))]
    rows += [(300, None), (301, ""), (302, word(9000)), (303, "x"), (303, "x"), (None, "a null id"), (304, "a " * 1023), (305, "a " * 2046)]
    rows += [(400 + k, "same") for k in range(150)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, piece int, part string").repartition(6)
    pieces = [r.asDict() for r in best_two_fit.pack(docs).collect()]
    reader = Tokenizer.from_file(tokenizer_path(best_two_fit.TOKENIZER))
    whole = Counter()
    for d, t in rows:
        ids = [*reader.encode(t or "", add_special_tokens=False).ids, 2]
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        whole += Counter((d, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])))  # noqa: B905
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], bytes(p["ids"])) for p in pieces) == whole
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert at.get(p["sequence_id"], 0) == p["offset"]
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(at.values()) <= 1024
    bins = []  # first fit, largest first
    for n in sorted((p["length"] for p in pieces), reverse=True):
        k = next((k for k, x in enumerate(bins) if x + n <= 1024), len(bins))
        bins[k : k + 1] = [n + (bins[k] if k < len(bins) else 0)]
    assert len(at) <= len(bins) + 1
    got = best_two_fit.digest(best_two_fit.pack(docs)).collect()
    assert Counter(r.ids_crc32 for r in got) == Counter(zlib.crc32(bytes(p["ids"])) for p in pieces)
    assert best_two_fit.pack(docs.limit(0)).count() == 0
