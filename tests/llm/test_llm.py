"""Operators on corpora against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.llm import (
    compression_quality,
    html_text,
    jaccard_join,
    mixing,
    nn_descent,
    packing,
    pii,
    quality_rules,
    suffix_dedup,
    token_files,
)
from causeway.llm.linking import components
from causeway.llm.tokens import tokenizer_path

SPACE = r"[^\x20\x09-\x0D]+"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(300, 1)
    near = base[:100] + ["changed"] + base[101:]
    far = base[:150] + words(150, 2)
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper()), (5, None), (6, ""),
            (7, "one two"), (8, "ONE\ttwo"), (9, " ".join(words(20000, 3))), (10, "x" * 5000), (11, "mail a.b1@ex.example.com é ﷐"),
            (11, "mail a.b1@ex.example.com é ﷐"), (None, " ".join(base)), (12, "a\n\na b\na\n" * 40), (13, "#$%& " * 80)]
    df = spark.createDataFrame([(d, t, "en", f"s{k % 3}" if k != 2 else None, 0, "clash") for k, (d, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars int, c string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k not in (12, 13)), 0) for k in range(1, 14)], "doc_id long, quality int, toxic int")


def test_components(spark):
    e = [(k, k + 1) for k in range(30)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(31)} | {(k, 50) for k in (50, 51, 52)}


def test_quality_counts(spark, docs, labels):
    def brute(t):
        t = t or ""
        w = re.findall(SPACE, t)
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, hit = Counter(g), set()
        for i, x in enumerate(g):
            if n[x] > 1:
                hit |= {i, i + 1, i + 2}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    got = Counter((r.doc_id, *[r[c] for c in quality_rules.COUNTS]) for r in quality_rules.rules(docs, labels).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert quality_rules.rules(docs.limit(0), labels).count() == 0
    assert quality_rules.rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns and 13 not in [r.doc_id for r in kept.collect()]


def test_quality_keeps_forests_of_rare_kinds_and_noisy_labels(spark):
    rng = np.random.default_rng(3)
    plain = [" ".join(words(80, 100 + k)) for k in range(600)]
    odd = [" ".join(words(80, 9000 + k) + ["#$%&"] * int(rng.integers(60, 90))) for k in range(31)]
    texts = [*plain[:400], odd[0], *plain[400:], *odd[1:]]  # one odd text labelled good; 30 of 230 bad ones are odd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k <= 400)) for k in range(len(texts))], "doc_id long, quality int")
    got = quality_rules.rules(docs, labels).toPandas().set_index("doc_id").kept
    assert got[range(400)].mean() > 0.99 and not got[range(601, 631)].any()


def test_quality_threshold_needs_more_than_chance():
    rng = np.random.default_rng(0)
    good, bad = rng.uniform(0, 0.5, 2000), rng.uniform(0, 0.5, 1000)
    assert quality_rules._threshold(good, bad) is None
    assert 0.5 < quality_rules._threshold(good, np.append(bad, np.full(12, 0.9))) < 0.9
    assert 0.4 < quality_rules._threshold(np.append(good, 0.95), np.append(bad, np.full(60, 0.9))) < 0.9


def brute_components(rows):
    sets = []
    for d, t in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(SPACE, t or "")]
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, a) in enumerate(sets):
        groups.setdefault(find(i) if a else (i, "alone"), []).append(d)
    low = {k: min([x for x in v if x is not None], default=None) for k, v in groups.items()}
    return Counter((d, len(a), low[find(i)] if a else d) for i, (d, a) in enumerate(sets))


def test_jaccard_join(spark, docs):
    got = Counter(tuple(r) for r in jaccard_join.join(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.join(docs.limit(0)).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7, 9, 10, 11, 12, 13]


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_jaccard_near_threshold_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng, rows = np.random.default_rng(5), []
    for g in range(8):
        base = words(60 + 20 * g, 100 + g)
        for k in range(6):
            copy = list(base)
            for i in rng.integers(0, len(copy), k % 4):
                copy[i] = f"z{g}-{k}-{i}"
            rows.append((10 * g + k, " ".join(copy + [f"t{k}"] * (k // 3))))
    got = Counter(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_signature_tree_prunes_no_link():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64))
        sets += [base, np.unique(np.append(base[:72], rng.integers(0, 1 << 63, 6, dtype=np.uint64)))]
    links = {tuple(sorted(x)) for x in jaccard_join.search(sets, None)}
    assert links == {(2 * k, 2 * k + 1) for k in range(60)}


def brute_removed(rows):
    seen, out = set(), Counter()
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                mark[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[d, len(b), sum(mark), (b"\0" + bytes(mark)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [20_000, 3])
def test_suffix_dedup(spark, docs, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    unique = docs.where("doc_id is not null and doc_id <> 11")
    rows = [(r.doc_id, r.text) for r in unique.orderBy("doc_id").collect()]
    rows += [(100 + k, "pre%d " % k + "é shared passage of more than a hundred bytes, repeated in many documents of this corpus, again. " * 2 + "post%d" % k) for k in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix_dedup.dedup(table).collect()) == brute_removed(rows)
    assert suffix_dedup.dedup(table.limit(0)).count() == 0


def test_suffix_dedup_null_and_repeated_ids(spark):
    t = "q" * 40 + "".join(words(40, 9))
    rows = [(None, t), (3, t), (3, t), (1, "short")]
    got = sorted((r.doc_id or -1, r.n_removed > 0) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, False), (1, False), (3, True), (3, True)]


def test_suffix_array_orders_all_suffixes():
    strings = [b"banana", b"", b"bananaban", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"\0\0\1\xff"]
    sa = suffix_dedup.SuffixArray(strings)
    whole = [(strings[k][p:], k) for k in range(len(strings)) for p in range(len(strings[k]) + 1)]
    got = [strings[sa.of[p]][p - sa.begin[sa.of[p]] :] for p in sa.order]
    assert got == sorted(s for s, _ in whole)
    lcp = sa.common()
    for k in range(1, len(got)):
        n = 0
        while n < min(len(got[k]), len(got[k - 1])) and got[k][n] == got[k - 1][n]:
            n += 1
        assert lcp[k] == n


def encode(name, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, docs):
    got = sorted((tuple(r) for r in token_files.round_trip(docs).collect()), key=lambda r: r[1])
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for r, g, ids in zip(rows, got, encode("byte_bpe_50k.json", [r.text for r in rows]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert g == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(docs.limit(0)).count() == 0


def test_token_files_select(spark, docs, tmp_path):
    token_files.write(docs, f"file://{tmp_path}/t")
    df = token_files.read(spark, f"file://{tmp_path}/t", "doc_id", "lang").where("doc_id = 7")
    assert [(r.doc_id, r.lang) for r in df.collect()] == [(7, "en")]
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in scan and "EqualTo(doc_id,7)" in scan


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing_round_trip(spark, docs, weights):
    table = docs.where("doc_id is not null and doc_id <> 11")
    got = packing.pack(table, weights).toPandas()
    rows = table.collect()
    ids = {r.doc_id: np.array([*i, 1], "<u4") for r, i in zip(rows, encode("word_bpe_49k.json", [r.text for r in rows]), strict=True)}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for d, g in got.sort_values("start").groupby("doc_id"):
        assert (g.start.to_numpy() == np.cumsum([0, *g.length])[:-1]).all() and g.length.sum() == len(ids[d])
    assert set(got.doc_id) == set(ids)
    size = got.groupby("sequence_id").length.sum()
    assert ((size == 2048) | (size & (size - 1) == 0)).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum([0, *g.length])[:-1]).all()
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs).count() > 0  # nulls and repeated ids


def test_schedule_holds_shares_and_carries_deficits():
    totals = np.array([500_000, 300_000, 7_001, 0])
    s = packing.Schedule(totals, totals.astype(float))
    full = np.concatenate([np.diff(s.block(b)[0], axis=1) for b in range(-(-s.windows // packing.BLOCK))], axis=1)
    assert (full.sum(0) == packing.LENGTH).all() and full.shape[1] == s.windows
    want = np.outer(totals / totals.sum(), np.arange(1, s.windows + 1) * packing.LENGTH)
    assert abs(full.cumsum(1) - want).max() < 4


@pytest.mark.parametrize("weighted", [False, True])
def test_packing_pools_keep_shares(weighted):
    rng = np.random.default_rng(2)
    totals = rng.integers(20_000, 60_000, 50)
    shares = rng.permutation(totals).astype(float) if weighted else totals.astype(float)
    s, n = packing.Pools(totals, shares, 8), np.full(50, 1000)
    assert s.pools
    rows = []
    for q, total in enumerate(totals.tolist()):
        first = np.arange(0, total, 1000)
        size = np.minimum(1000, total - first)
        got = s.place(np.full(len(first), q), first, size)
        assert (np.bincount(got[:, 0], got[:, 2], len(first)) == size).all()
        rows.append(np.column_stack([np.full(len(got), q), got]))
    q, _, _, length, window, offset = np.concatenate(rows).T
    order = np.lexsort([offset, window])
    assert (np.bincount(window, length)[: totals.sum() // packing.LENGTH] == packing.LENGTH).all()
    same = window[order][1:] == window[order][:-1]
    assert (offset[order][1:] == np.where(same, (offset + length)[order][:-1], 0)).all()
    early = window < 150  # no source is dry yet
    got = np.bincount(q[early], length[early], 50) / length[early].sum()
    assert abs(got / (shares / shares.sum()) - 1).max() < 0.1


def test_packing_with_pools_packs_every_source(spark, monkeypatch):
    monkeypatch.setattr(packing.Pools.__init__, "__defaults__", (4,))
    rows = [(k, " ".join(words(40 + k, k)), f"s{k % 23}") for k in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all() and got.doc_id.nunique() == 400
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum([0, *g.length])[:-1]).all()
        assert g.length.sum() < packing.LENGTH or g.source.nunique() == 23


def test_mixing(spark, docs):
    rates = {r.source: r for r in mixing.rates(docs).collect()}
    mass = Counter()
    for r in docs.collect():
        mass[r.source] += len(r.text or "")
    whole, roots = sum(mass.values()), sum(v**0.5 for v in mass.values())
    for s, v in mass.items():
        assert abs(rates[s].rate - v**0.5 / roots * whole / v) < 1e-9
    got = Counter((r.doc_id, r.copy) for r in mixing.mixed(docs).collect())
    want = Counter()
    for r in docs.collect():
        u = int(hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n = sum(p <= u for p in rates[r.source].cdf)
        want.update((r.doc_id, k) for k in range(n))
    assert got == want
    assert mixing.mixed(docs.limit(0)).count() == 0
    keys = [r.mix_key for r in mixing.mixed(docs).collect()]
    assert keys == sorted(keys)


def test_mixing_reaches_target_weights(spark):
    rows = [(k, "x" * 10, "big" if k % 4 else "small") for k in range(4000)]
    got = Counter(r.source for r in mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), {
        "big": 1.0, "small": 1.0}).collect())
    assert abs(got["big"] / 2000 - 1) < 0.1 and abs(got["small"] / 2000 - 1) < 0.1


def test_pii_surrogates(spark, docs):
    t = ("Mail hsr.29@mail5.example.com and hsr.29@mail5.example.com, 42.144.35.254, 4041894974608795, +1 (988) 555-2485, "
         "password=b7db7aa4a5fcc78305, Mrs. Maria Garcia, Господин Иван Петров; 3.5 and v1.2")
    df = spark.createDataFrame([(t,), (None,), ("",), ("plain text. Nothing here",), ("#token = \"" + "a1" * 20 + "\"",)], "text string")
    got = [r.text for r in pii.scrub(df).collect()]
    assert got[1:4] == [None, "", "plain text. Nothing here"]
    for gone in ("hsr.29@", "42.144.35.254", "4041894974608795", "988", "b7db7aa4a5fcc78305", "Garcia", "Петров"):
        assert gone not in got[0]
    mail = re.findall(r"\S+@\S+\.com", got[0])
    assert len(mail) == 2 and mail[0] == mail[1]
    card = re.findall(r"\b4[0-9]{15}\b", got[0])[0]
    digits = [int(c) for c in card][::-1]
    assert sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(digits)) % 10 == 0
    assert "+1 (" in got[0] and "password=" in got[0] and re.search("Mrs[.] [A-Z][a-z]+ia ", got[0]) and "3.5 and v1.2" in got[0]
    assert re.search(r"Господин [А-Я][а-я]+ [А-Я][а-я]+", got[0])
    assert pii.scrub(docs).where("text is null").count() == 1 and pii.scrub(docs).columns == docs.columns
    assert any("﷐" in (r.text or "") for r in pii.scrub(docs).collect())
    assert pii.scrub(docs.limit(0)).count() == 0


def test_pii_finds_keys_without_digits(spark):
    keys = ["AKIA" + "QWERTYUI" * 2, "ASIA" + "QWERTYUI" * 2, "ghp_" + "abcdefghij" * 2, "sk-" + "abcdefghij" * 2, "eyJabcdefgh.abcdefgh.abcdefgh"]
    got = [r.text for r in pii.scrub(spark.createDataFrame([(f"see {k} here",) for k in keys], "text string")).collect()]
    assert all(k not in text for k, text in zip(keys, got, strict=True))


def test_pii_is_a_permutation(spark):
    rows = [(f"{a}.{b}.7.9 call +1 ({100 + a}) 555-{1000 + b} or u{a}{b}@ex.org",) for a in range(1, 30) for b in range(1, 30)]
    df = spark.createDataFrame(rows, "text string")
    e = pii.entities(df).toPandas()
    assert pii.collisions(df).count() == 0
    assert e.groupby("kind").surrogate.nunique().sum() == len(e) == len(set(e.entity)) and (e.entity != e.surrogate).all()
    texts = lambda d: sorted(r.text for r in pii.scrub(d).collect())
    assert texts(df) == texts(df.repartition(5)) and len(set(texts(df))) == len(rows)


def test_html_text(spark):
    page = ("<html><head><title>T</title><style>x</style></head><body><nav><a href=a>Home</a></nav><div class='ad'>Buy.</div>"
            "<article><h1>A &amp; B</h1><p>First  block,\n with <a href=x>a link</a>.<p><b>Second.<br>line</b><ul><li>One<li>Two</ul></article>"
            "<div class='comments'><p>I think so, too.</p></div><form>Name <input></form><footer>&copy; x</footer>")
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "plain words only"), (4, "u", page[: page.index("Second")] + "Sec&am"),
            (1, "u", page), (5, "u", "<script>if (a < b) x()</script><p>ok</p><p"), (6, "u", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.main_texts(df).collect()}
    assert got[1].text == "A & B\nFirst block, with a link.\nSecond. line\nOne\nTwo"
    assert got[2].text == "" and got[None].text == "" and got[3].text == "plain words only" and got[5].text == "ok" and got[6].text == "deep"
    assert got[4].text.endswith("Sec&am") and got[1].n_chars == len(got[1].text)
    assert html_text.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++)f()</script>", "<script>s = \"it's <b>\"; t = '<a href=\"'</script>", "<style>p:after{content:'<x'}</style>",
    "<SCRIPT>if(a<b)x=\"</p>\"</Script >", "<script>a<!--b</script>", "<script></script>", "<title>x<y</title>", "<script>'</scripts>'</script>"])
def test_html_raw_text_ends_at_its_end_tag(raw):
    story = "<article><h1>Head</h1><p>The story starts here, and goes on.</p></article>"
    assert html_text.extract(f"<body>{raw}{story}{raw}{story}</body>") == "\n".join(["Head", "The story starts here, and goes on."] * 2)
    assert html_text.extract(f"<body>{story}<script>for(i=0;i<n;i++)") == "Head\nThe story starts here, and goes on."


def test_html_messages_equal_enumeration():
    page = "<body><nav><a href=a>x</a></nav><div class=post><p>Some text, here. And more.</p></div></body>"
    nodes, _ = html_text.parse(page)
    m = html_text.potentials()
    own, parent = m.evidence(nodes)
    total = np.zeros((len(nodes), 2))
    for code in range(2 ** len(nodes)):
        s = [(code >> k) & 1 for k in range(len(nodes))]
        p = m.root[s[0]] + sum(own[k, s[k]] for k in range(len(nodes))) + sum(m.pairs[s[parent[k]], s[k]] for k in range(1, len(nodes)))
        for k in range(len(nodes)):
            total[k, s[k]] += np.exp(p)
    assert np.allclose(m.content(nodes), total[:, 1] / total.sum(1))


def test_nn_descent(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    x = [*base, *(base[7] + 0.05 * rng.standard_normal((60, 16))), *(base[9:12] * 2)]
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, 2.0], 0), (904, [2.0, 4.0], 0), (904, [2.0, 4.0], 0), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    got = nn_descent.near_duplicates(df).toPandas()
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    n = got[got.vec_id < 900].set_index("vec_id").n_links.sort_index().to_numpy()
    want = link.sum(1) - 1
    assert n.sum() >= 0.9 * want.sum() and (n <= want).all()
    rest = {r.vec_id: (r.n_links, r.component_id) for r in got[got.vec_id >= 900].itertuples()}
    assert rest == {900: (0, 900), 901: (0, 901), 902: (0, 902), 903: (1, 903), 904: (1, 903)}
    assert len(got) == len(rows) and nn_descent.near_duplicates(df.limit(0)).count() == 0


def brute_links(x):
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    low = np.arange(len(x))
    while (new := np.where(link, low, len(x)).min(1)).tolist() != low.tolist():
        low = new
    return {(k, int(n) - 1, int(low[k])) for k, n in enumerate(link.sum(1))}


def dense(seed, groups, size, dims=24, spread=0.003):
    """Pairs of tight groups, cosine about 0.96 between the two of a pair."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(groups):
        a, b = np.linalg.qr(rng.standard_normal((dims, 2)))[0].T
        for centre in (a, 0.96 * a + 0.28 * b):
            out.append(centre + spread * rng.standard_normal((size, dims)))
    return np.concatenate([*out, rng.standard_normal((200, dims))])


def links_of(spark, x):
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    return {(r.vec_id, r.n_links, r.component_id) for r in nn_descent.near_duplicates(df).collect()}


def test_nn_descent_links_dense_groups(spark):
    x = np.concatenate([dense(6, 2, 150), dense(6, 1, 1, spread=0)[[0] * 60]])  # and exact copies
    assert links_of(spark, x) == brute_links(x)


def test_nn_descent_lists_leave_dense_groups_without_audit(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "audited", lambda placed, whole=False: (None, True, True))
    x = dense(6, 2, 150)
    assert links_of(spark, x) == brute_links(x)


def test_nn_descent_audit_takes_no_links_as_no_evidence(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "SLICE", 1 << 13)  # eight slices or so
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 16))
    x[490:] = x[:10] + 0.01
    vec = spark.createDataFrame([(k, [float(c) for c in v], k) for k, v in enumerate(x)], "id long, vec array<double>, root long")
    edges, met, every = nn_descent.audited(vec)
    assert {tuple(sorted(r)) for r in edges.collect()} == {(k, 490 + k) for k in range(10)} and not met and every


def test_compression_quality(spark, docs, labels):
    rng = np.random.default_rng(1)
    good = [(k, " ".join(words(80, 1000 + k)) + ".") for k in range(200)]
    bad = [(1000 + k, " | ".join(f"zz{x}" for x in rng.integers(0, 300, 60))) for k in range(100)]
    df = spark.createDataFrame([*good, *bad, (5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad], "doc_id long, quality int")
    got = compression_quality.classify(df, lab).toPandas()
    held = got[got.held_out & got.doc_id.notna() & (got.doc_id < 5000)]
    assert ((held.doc_id < 1000) == (held.predicted == 1)).mean() > 0.95
    assert set(got[got.doc_id.notna()].query("held_out").doc_id.astype(int)) == {
        d for d, _ in [*good, *bad, (5000, ""), (5001, "")] if zlib.crc32(str(d).encode()) % 3 == 1}
    assert got.score.between(0, 1).all() and len(got) == 303
    assert compression_quality.classify(df.limit(0), lab).count() == 0
    assert (compression_quality.classify(df, lab.limit(0)).toPandas().score == 0.5).all()


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
    got = corpus_pipeline.run(spark, d).toPandas()
    per = got.groupby("sequence_id").length.sum()
    assert (per <= 2048).all() and len(got)
    assert isinstance(got, pd.DataFrame)
