"""Template mining against a slow reader, in batches and as a stream."""

import re
from collections import Counter

import numpy as np
import pytest

from causeway.operators import templates


def split(message):
    return re.findall(r"[^\x20\x09-\x0D]+", message or "")


def slow(lines, children=templates.CHILDREN, repeats=False):
    """{(ts, id): name of its template} and {name: [words, lines]}: one line after another, kept as plain lists."""
    order = sorted(lines, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0)))
    seen, own, held, placed = {}, {}, {}, {}
    for ts, ident, message in order:
        words = split(message)
        t = None if repeats else seen.get(tuple(words))
        if t is None:
            head = words[0] if words else ""
            mine = own.setdefault(len(words), [])
            if not any(c.isdigit() for c in head) and head != "<*>" and head not in mine and len(mine) < children - 1:
                mine.append(head)
            leaf = held.setdefault((len(words), head if head in mine else "<*>"), [])
            alike = lambda t: sum(a == b != "<*>" for a, b in zip(t[1], words, strict=True))  # noqa: B023, E731
            t = max(leaf, key=lambda t: (alike(t), t[1].count("<*>")), default=None)  # noqa: B023
            if t is None or alike(t) < 0.4 * len(words):
                t = [(ts, ident), words, 0]
                leaf.append(t)
            t[1] = [a if a == b else "<*>" for a, b in zip(t[1], words, strict=True)]
        t[2] += 1
        seen[tuple(words)], placed[ts, ident] = t, t[0]
    return placed, {t[0]: (" ".join(t[1]), t[2]) for ts in held.values() for t in ts}


def log(n=600, seed=1):
    rng = np.random.default_rng(seed)
    shapes = ["user {} logged in from {}", "disk {} is {} percent full", "request {} failed with code {} after {} ms", "start", "job {} done",
              "{} restarted", "pool exhausted {} waiting {}", "retry {} of {} for user {}"]
    out = []
    for k in range(n):
        if rng.random() < 0.15:
            text = " ".join(f"{chr(97 + int(c))}{chr(97 + int(d))}" for c, d in rng.integers(0, 26, (int(rng.integers(1, 6)), 2)))
        else:
            shape = shapes[int(rng.integers(0, len(shapes)))]
            text = shape.format(*[("n" if rng.random() < 0.3 else "") + str(x) for x in rng.integers(0, 40, 3)])
        out.append((int(k // 3), k, text))
    return [*out, (5, 5000, None), (6, 5001, "  "), (7, 5002, "a <*> c"), (7, 5003, "a b c"), (None, 5004, "start"), (8, None, "x y z")]


LINES = "ts long, id long, message string"


def name(key):
    return "T{}-{}".format(*["" if x is None else x for x in key])


@pytest.mark.parametrize("children", [100, 4])
def test_templates_equal_a_slow_reader(spark, children):
    rows = log()
    found, placed = templates.templates(spark.createDataFrame(rows, LINES).repartition(5), children=children)
    got = {r.template_id: (r.template, r.n_lines) for r in found.collect()}
    where, want = slow(rows, children)
    assert got == {name(k): v for k, v in want.items()}
    by_words = {tuple(r.words): r.template_id for r in placed.collect()}
    assert by_words == {tuple(split(m)): name(where[t, i]) for t, i, m in rows}


def test_every_line_fits_its_template_in_chunks(spark):
    rows = log(900, 2)
    got = templates.with_template(spark.createDataFrame(rows, LINES).repartition(3), chunk=7).collect()
    assert Counter((r.ts, r.id, r.message) for r in got) == Counter(rows)
    for r in got:
        words = split(r.message)
        shape = r.template.split(" ") if r.template else []
        assert len(words) == len(shape) and all(t in ("<*>", w) for t, w in zip(shape, words, strict=True))
    found, _ = templates.templates(spark.createDataFrame(rows, LINES), chunk=7)
    assert sum(r.n_lines for r in found.collect()) == len(rows)
    assert len({r.template_id for r in got}) < 260
    empty, none = templates.templates(spark.createDataFrame([], LINES))
    assert empty.count() == 0 and none.count() == 0


def test_stream_equals_a_slow_reader(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [r for r in log(240, 3) if r[0] is not None and r[1] is not None and (r[2] or "").strip()]
        rows.sort(key=lambda r: (r[0], r[1]))
        for k in range(3):
            spark.createDataFrame(rows[k * 80 : k * 80 + 80], LINES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        start = lambda: templates.mined(stream, 5).writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        start().awaitTermination()
        # a restart goes on from the state
        more = [(1000, 9000 + k, f"user {k} logged in from x{k}") for k in range(4)]
        spark.createDataFrame(more, LINES).coalesce(1).write.parquet(str(tmp_path / "in/9"))
        start().awaitTermination()
        got = {(r.ts, r.id): r.template_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        where, _ = slow([*rows[:240], *more], 5, repeats=True)
        assert got == {k: name(v) for k, v in where.items()}
    finally:
        spark.conf.unset(key)


def test_a_line_is_compared_with_few_templates_of_a_large_leaf(monkeypatch):
    rng = np.random.default_rng(4)
    lines = [[f"w{int(x)}" for x in rng.zipf(1.3, 8)] for _ in range(1500)]
    leaf, slow, compared = templates.Leaf(8), [], []
    lexsort = np.lexsort
    monkeypatch.setattr(templates.np, "lexsort", lambda keys: compared.append(len(keys[0])) or lexsort(keys))
    for k, line in enumerate(lines):
        alike = lambda t: sum(a == b != "<*>" for a, b in zip(t[1], line, strict=True))  # noqa: B023, E731
        best = max(slow, key=lambda t: (alike(t), t[1].count("<*>")), default=None)  # noqa: B023
        if best is None or alike(best) < 0.4 * 8:
            best = [len(slow), line]
            slow.append(best)
        best[1] = [a if a == b else "<*>" for a, b in zip(best[1], line, strict=True)]
        assert leaf.add(line, (k, k)) == best[0]
    assert [leaf.template(k) for k in range(leaf.n)] == [t[1] for t in slow] and leaf.n > 3 * templates.FEW
    assert sum(compared) < len(lines) * leaf.n / 8


def test_a_leaf_of_one_chunk_is_written_once(spark, monkeypatch):
    """240 lines of which no two are alike are a leaf of 35 chunks, a few others a small one: what is found in the chunks is
    mined once more, the small leaf isn't, and where a line went is kept without its words."""
    kept, write = [], templates.written
    monkeypatch.setattr(templates, "written", lambda df, name, **options: kept.append((name, write(df, name, **options))) or kept[-1][1])
    big = [(k, k, f"9 a{k} b{k} c{k} d{k}") for k in range(240)]
    rows = [*big, *[(1000 + k, k, f"start e{k // 2} f{k} g{k}") for k in range(4)], (2000, 1, "start e0 f1 h"), (2001, 1, "start e0 f1 h")]
    found, placed = templates.templates(spark.createDataFrame(rows, LINES), chunk=7)
    where, want = slow(rows)
    assert {r.template_id: (r.template, r.n_lines, r.n_distinct) for r in found.collect()} == {
        name(k): (*v, len({m for t, i, m in rows if where[t, i] == k})) for k, v in want.items()}
    tables = [t for n, t in kept if n == "log-templates"]
    assert [t.where("found").count() for t in tables] == [len(want), 240]
    assert all(t.where("not found and line is not null").isEmpty() for t in tables)
    assert {tuple(r.words): r.template_id for r in placed.collect()} == {tuple(split(m)): name(where[t, i]) for t, i, m in rows}
