"""Quality rules: word and line statistics of every document, judged by isolation forests.

Statistics come from one pass over the text, without a shuffle: word length, and symbols, repeated lines and repeated
words a word, each over its spread. A forest judges all of them jointly; forests over fewer of them follow, as harmless
statistics can drown a telling one, each for the bad rows that those before it leave. They are grown on half of a
bounded sample of labelled rows (SAMPLE), on good rows that pass the base rule; cuts are drawn from the range of a node
widened by the spread of all rows, so that a row beyond what good rows show is cut off early. Thresholds are calibrated
on the other half, which no forest has seen: halfway from a score of good rows to where the bad rows
above it begin. That score is the highest, unless passing over a few extreme good rows, at most MAX_LOSS, finds at least
PRICE times as many bad rows as chance and PRICE for each: they are taken for mislabelled. A forest is used where the
bad rows found are more than chance gives (CHANCE), however few they are among all bad rows, or at least MIN_GAIN of
them with no good row. The model is a few megabytes whatever the corpus, and every document is scored.

Defined cases: a null or empty text has no words, all counts 0, and fails the base rule; a null doc_id stays null;
repeated rows are judged one by one; extra columns are ignored by `statistics` and kept by `keep`; without labelled
rows of both kinds nothing is anomalous and only the base rule decides; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import own, small_batches
from .textkit import SPACE, SYMBOL, chunks, hashes, pieces, sums, windows

#: The forest sees at most so many labelled rows, those with the smallest hash of their doc_id.
SAMPLE = 20_000
TREES, NODE_ROWS, SEED, DEEPER = 100, 256, 7, 2
#: The statistics that forests look at, by their place in features(): all, then ever fewer.
SUBSETS = tuple(c for n in (4, 3, 2, 1) for c in combinations(range(4), n))
#: Share of good labelled rows that a threshold may call anomalous, what each must bring, and what bad rows show.
MAX_LOSS, PRICE, MIN_GAIN, CHANCE = 0.01, 10, 0.2, 1e-6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _row_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """COUNTS for each row of a chunk."""
    rows = len(offs) - 1
    space = SPACE[data]
    starts, ends, row = pieces(data, offs, space)
    prefix = sums(data)
    out = np.zeros((rows, 5), np.int64)
    out[:, 0] = np.bincount(row, minlength=rows)[:rows]
    for k, mark in ((1, ~space & ((data & 0xC0) != 0x80)), (2, SYMBOL[data])):
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        out[:, k] = total[offs[1:]] - total[offs[:-1]]
    # lines with a word, equal to an earlier one
    begin, end, of = pieces(data, offs, data == 10)
    words_before = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    full = words_before[end] > words_before[begin]
    begin, end, of = begin[full], end[full], of[full]
    if len(of):
        line = hashes(prefix, begin, end)
        order = np.lexsort((line, of))
        same = (line[order][1:] == line[order][:-1]) & (of[order][1:] == of[order][:-1])
        out[:, 3] = np.bincount(of[order][1:][same], minlength=rows)[:rows]
    # words inside a run of three that occurs at least twice in its text
    if len(row) >= 3:
        gram, at = windows(hashes(prefix, starts, ends), row, 3)
        bounds = np.searchsorted(row[at], np.arange(rows + 1))
        twice = np.zeros(len(gram), bool)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                ranked = np.sort(gram[a:b])
                again = ranked[1:][ranked[1:] == ranked[:-1]]
                if len(again):
                    again = np.unique(again)
                    i = np.minimum(np.searchsorted(again, gram[a:b]), len(again) - 1)
                    twice[a:b] = again[i] == gram[a:b]
        step = np.zeros(len(row) + 1, np.int64)
        hit = at[twice]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + 3, -1)
        out[:, 4] = np.bincount(row[np.cumsum(step)[:-1] > 0], minlength=rows)[:rows]
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """The statistics that forests judge: word length, and symbols, repeated lines and repeated words a word."""
    one = np.maximum(counts[:, :1], 1).astype(float)
    return counts[:, 1:] / one


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), cut, left child (right is next), path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in 0..1 by mean path length; higher is more anomalous."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, left, path in zip(self.feature, self.cut, self.left, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                inner = f >= 0
                right = x[every, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, left[node] + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, wide: np.ndarray, trees: int = TREES, rows: int = NODE_ROWS, seed: int = SEED) -> Forest:
    """Grow an isolation forest over random splits of random subsets. Cuts go up to `wide` beyond a node's range; as
    some then divide nothing, trees are DEEPER times as deep."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = DEEPER * int(np.ceil(np.log2(max(rows, 2))))
    size = 2 * depth * rows + 3
    able = np.flatnonzero((wide > 0) | (x.max(0) > x.min(0)))
    shape = (trees, size)
    used = 1
    feature, cut, left, path = np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape)
    for t in range(trees):
        todo, free = [(0, x[rng.choice(len(x), rows, replace=False)], 0)], 1
        while todo:
            node, part, d = todo.pop()
            if d >= depth or len(part) < 2 or not len(able):
                path[t, node] = d + _mean_path(len(part))
                continue
            f = int(rng.choice(able))
            at = rng.uniform(part[:, f].min() - wide[f], part[:, f].max() + wide[f])
            right = part[:, f] >= at
            feature[t, node], cut[t, node], left[t, node] = f, at, free
            todo += [(free, part[~right], d + 1), (free + 1, part[right], d + 1)]
            free += 2
        used = max(used, free)
    # only the nodes in use go to the tasks, in small numbers
    trim = lambda a, kind: a[:, :used].astype(kind)
    return Forest(trim(feature, np.int8), trim(cut, np.float32), trim(left, np.int32), trim(path, np.float32), max(_mean_path(rows), 1e-9))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and base_failed for every row of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_row_counts(data, offs) for _, data, offs in chunks(batch.column(1))]
            c = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
            failed = (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c[:, k]) for k in range(5)], pa.array(failed)],
                names=["doc_id", *COUNTS, "base_failed"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean"
    return own(docs, "doc_id", "text").mapInArrow(count, schema)


@dataclass
class Rules:
    """The forests in use, (statistics, forest, threshold), over statistics less their middle, over their spread."""

    used: list[tuple[tuple[int, ...], Forest, float]]
    middle: np.ndarray
    spread: np.ndarray

    def judge(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(highest score, whether one is above its threshold) of each row. Equal statistics are scored once."""
        top, odd = np.zeros(len(counts)), np.zeros(len(counts), bool)
        if self.used and len(counts):
            x, back = np.unique((features(counts) - self.middle) / self.spread, axis=0, return_inverse=True)
            for columns, forest, threshold in self.used:
                score = forest.scores(x[:, columns])[back.ravel()]
                top, odd = np.maximum(top, score), odd | (score > threshold)
        return top, odd


NONE = Rules([], np.zeros(4), np.ones(4))


def _sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The labelled rows that fit() may use: at most `sample`, small enough to broadcast."""
    known = own(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").dropDuplicates()
    return known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "quality").limit(sample)


def _threshold(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The threshold for these scores, or None where bad rows don't stand out."""
    if not len(bad):
        return None
    tops = np.sort(good)[::-1][: 1 + int(np.ceil(MAX_LOSS * len(good)))]
    beyond, lost = (bad[:, None] > tops + 1e-9).sum(0), (good[:, None] > tops + 1e-9).sum(0)
    best = int(np.argmax(beyond - lost * PRICE * max(1.0, len(bad) / len(good))))
    n, chance = int(beyond[best]), len(bad) * (lost[best] + 1) / (len(good) + 1)
    if n <= chance or n * np.log(n / chance) - (n - chance) < -np.log(CHANCE):  # a bound of the Poisson tail
        best = 0
        if beyond[0] < max(MIN_GAIN * len(bad), 1):
            return None
    top = float(tops[best])
    return (top + float(np.quantile(bad[bad > top + 1e-9], 0.05))) / 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Forests and thresholds from at most `sample` labelled rows; only their texts are read for it."""
    known = _sampled(labels, sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)).alias("half")
    rows = (
        statistics(own(docs, "doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"))
        .where("not base_failed")
        .join(F.broadcast(known), "doc_id")
        .select("quality", half, *COUNTS)
        .toPandas()
    )
    return calibrated(rows[list(COUNTS)].to_numpy(np.int64), rows.quality.to_numpy() == 1, rows.half.to_numpy() == 0)


def calibrated(counts: np.ndarray, good: np.ndarray, first: np.ndarray) -> Rules:
    """Rules from the counts of labelled rows: forests see good rows of the first half, thresholds the other half.
    Where a half lacks a kind, both halves serve for both."""
    if good.all() or not good.any():
        return NONE
    order = np.lexsort([*counts.T, good, first])
    counts, good, first = counts[order], good[order], first[order]
    if not (good & first).any() or len(np.unique(good[~first])) < 2:
        first = np.ones(len(good), bool)
    other = ~first if not first.all() else first
    x = features(counts)
    middle, spread = np.median(x[first & good], axis=0), x[first].std(0)
    model = Rules([], middle, np.where(spread > 0, spread, np.maximum(x.std(0), 1e-9)))
    x = (x - middle) / model.spread
    wide = np.where(x.std(0) > 0, 1.0, 0.0)
    grown, safe, left = x[first & good], x[other & good], x[other & ~good]
    for columns in SUBSETS:
        if not len(left):
            break
        forest = grow(grown[:, columns], wide[list(columns)], seed=SEED + len(model.used))
        score = forest.scores(left[:, columns])
        threshold = _threshold(forest.scores(safe[:, columns]), score)
        if threshold is not None:
            model.used.append((columns, forest, threshold))
            left = left[score <= threshold]
    return model


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict for every row of docs: anomaly is the highest score, kept is false where the base rule
    fails or a score is above its threshold."""
    model = fit(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(k).to_numpy() for k in range(1, 6)])
            top, odd = model.judge(counts)
            keep = ~batch.column(6).to_numpy(zero_copy_only=False) & ~odd
            columns = [*batch.columns, pa.array(top), pa.array(keep)]
            yield pa.record_batch(columns, names=[*batch.schema.names, "anomaly", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return statistics(docs).mapInArrow(judge, f"{schema}, base_failed boolean, anomaly double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Each text is judged where it is read, so that
    no text is shuffled."""
    small_batches(docs.sparkSession)
    model, at = fit(docs, labels), docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_row_counts(data, offs) for _, data, offs in chunks(batch.column(at))]
            if parts:  # forests judge a batch at once, and only what passes the base rule
                c = np.concatenate(parts)
                keep = (c[:, 0] >= 50) & (100 * c[:, 4] <= 50 * c[:, 0])
                keep[keep] = ~model.judge(c[keep])[1]
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(sift, docs.schema)
