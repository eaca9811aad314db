"""Mixture-controlled packing: deficit round-robin over source queues into windows of fixed length.

Every source is a queue of its documents' ids, one stream. Each window of LENGTH tokens is filled from all queues in
their target proportions: a queue's deficit grows by its share of each window, it gives that many whole tokens, and
what it could not give or gave too much is carried to the next window. So that partitions work alone, windows come in
blocks of BLOCK: where each queue stands at the start of a block follows in closed form from the totals (the fluid
schedule of the same shares), the deficit there is carried into the block, and the round-robin runs inside it.

All ids are packed. Where a queue runs dry the others' shares rise. Documents are cut at window ends. Windows are full
except the last, whose tokens form sequences of powers of two, so nothing is padded.

Two passes: the first encodes every text once and writes ids (two bytes each) with their place in their queue; the
second cuts them. Only the name and token total of each source come to the driver. With more than QUEUES sources, the
smaller ones form pools: a pool is a queue with the shares of its sources together, and the same round-robin runs
inside it over its sources.

Defined cases: a null or empty text is one end id; a null source is a queue of its own; a null doc_id stays null;
repeated rows are packed each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import own, written
from .tokens import encoder, tokenizer_path

LENGTH, BLOCK, END, QUEUES = 2048, 1024, 1, 1024
#: A row for each reader and source is broadcast up to so many rows (about 10 MB).
BROADCAST_ROWS = 1 << 18
TOKENIZER = "word_bpe_49k.json"
PIECES = (
    "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, part, row, before, n, ids): each document's ids with the end id, as bytes of 16-bit numbers,
    and how many ids of its source its reader met before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before = TaskContext.get().partitionId(), 0, {}
        own_encoder = encoder(path, False)
        if own_encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("packing: ids need more than 16 bits")
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                ids, size = own_encoder.encode(batch.column(2))
                ids = np.insert(ids.astype(np.uint16), np.cumsum(size), END)
                n = size + 1
                ends = np.concatenate([[0], np.cumsum(n)]) * 2
                blobs = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                place = np.zeros(len(n), np.int64)
                for k, source in enumerate(batch.column(1).to_pylist()):
                    place[k] = before.get(source, 0)
                    before[source] = place[k] + n[k]
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int64)),
                     pa.array(np.arange(row, row + len(n))), pa.array(place), pa.array(n), blobs],
                    names=["doc_id", "source", "part", "row", "before", "n", "ids"])
                row += len(n)

    schema = "doc_id long, source string, part long, row long, before long, n long, ids binary"
    return own(docs, "doc_id", "source", "text").mapInArrow(read, schema)


class Schedule:
    """Which tokens of each queue go to which window, for queue totals and target shares."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, length: int = LENGTH) -> None:
        self.length = length
        self.totals = totals.astype(np.int64)
        shares = np.where(totals > 0, shares, 0).astype(float)
        # a queue without a share comes after all others
        self.shares = np.where((totals > 0) & (shares <= 0), 1e-9 * max(shares.sum(), 1), shares)
        self.tokens = int(self.totals.sum())
        self.windows = self.tokens // self.length
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.stands: dict[int, np.ndarray] = {}

    def standing(self, tokens: int) -> np.ndarray:
        """How many tokens of each queue are among the first `tokens` of the fluid schedule."""
        return self._fluid(tokens)[0]

    def _fluid(self, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """The same and the deficit of each queue there: what its share came to, less what it gave."""
        if tokens >= self.tokens:
            return self.totals.copy(), np.zeros(len(self.totals))

        def at(v: float) -> np.ndarray:
            return np.minimum(self.totals, np.maximum(np.ceil(self.shares * v - 0.5), 0).astype(np.int64))

        low, high = 0.0, 1.0
        while at(high).sum() < tokens:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (low, mid) if at(mid).sum() >= tokens else (mid, high)
        out, floor = at(high), at(low)
        for q in range(len(out) - 1, -1, -1):
            over = int(out.sum()) - tokens
            out[q] -= min(over, int(out[q] - floor[q]))
        return out, np.clip(np.minimum(self.shares * high, self.totals) - out, -1, 1)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For block b, [queue, window]: tokens of the queue before each window and before the window after the last,
        and tokens of earlier queues in each window."""
        if b not in self.held:
            if len(self.held) >= 16:
                self.held.pop(next(iter(self.held)))
            first, last = b * BLOCK, min((b + 1) * BLOCK, self.windows)
            (stand, deficit), end = self._fluid(first * self.length), self.standing(last * self.length)
            cuts = np.empty((len(stand), last - first + 1), np.int64)
            cuts[:, 0] = stand
            left = end - stand
            for w in range(1, last - first + 1):
                active = self.shares * (left > 0)
                deficit = deficit + active * (self.length / active.sum())
                give = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
                short = self.length - int(give.sum())
                while short > 0:  # rounding: the largest deficits first
                    able = np.flatnonzero(left > give)
                    take = able[np.argsort(give[able] - deficit[able], kind="stable")][:short]
                    give[take] += 1
                    short -= len(take)
                while short < 0:
                    able = np.flatnonzero(give > 0)
                    take = able[np.argsort(deficit[able] - give[able], kind="stable")][:-short]
                    give[take] -= 1
                    short += len(take)
                deficit = deficit - give
                left = left - give
                cuts[:, w] = cuts[:, w - 1] + give
            give = np.diff(cuts, axis=1)
            self.held[b] = cuts, np.cumsum(give, axis=0) - give
        return self.held[b]

    def tail(self) -> np.ndarray:
        """Where the sequences of the unfinished last window begin: powers of two, largest first, and the end."""
        rest = self.tokens - self.windows * self.length
        sizes = [1 << k for k in range(self.length.bit_length(), -1, -1) if rest >> k & 1]
        return np.cumsum([0, *sizes])

    def place(self, q: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows (document, token, length, sequence, offset) of the pieces of documents k: tokens first[k] and the n[k] - 1
        after it of queue q[k], where token counts in the queue."""
        out = [np.zeros((0, 5), np.int64)]
        full = self.standing(self.windows * self.length) if self.windows else np.zeros(len(self.totals), np.int64)
        for one in np.unique(q).tolist():
            who = np.flatnonzero(q == one)
            start, end = first[who], first[who] + n[who]
            inner = np.flatnonzero(start < full[one])
            if len(inner):
                low, high = int(start[inner].min()), int(np.minimum(end[inner], full[one]).max())
                b = self._block_of(one, low)
                while b * BLOCK < self.windows:
                    cuts, ahead = self.block(b)
                    c = cuts[one]
                    if c[0] >= high:
                        break
                    out.append(self._cut(who, np.maximum(start, c[0]), np.minimum(end, c[-1]), c, ahead[one], b * BLOCK))
                    b += 1
            if (end > full[one]).any():  # the unfinished last window: its sequences take the place of windows
                bounds, base = self.tail(), int((self.totals[:one] - full[:one]).sum())
                at = bounds + int(full[one]) - base  # where each sequence begins, in tokens of this queue
                out.append(self._cut(who, np.maximum(start, full[one]), end, at, np.zeros(len(at) - 1, np.int64), self.windows))
        return np.concatenate(out)

    @staticmethod
    def _cut(who: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: np.ndarray, ahead: np.ndarray, base: int) -> np.ndarray:
        """place() for ranges of tokens inside the bounds of cuts; offset in a window counts from its cut and ahead."""
        able = np.flatnonzero(end > start)
        who, start, end = who[able], start[able], end[able]
        left = np.searchsorted(cuts, start, "right") - 1
        right = np.searchsorted(cuts, end, "left")
        n = right - left
        total = np.concatenate([[0], np.cumsum(n)])
        doc = np.repeat(np.arange(len(who)), n)
        w = np.arange(total[-1]) - total[:-1][doc] + left[doc]
        a, b = np.maximum(start[doc], cuts[w]), np.minimum(end[doc], cuts[w + 1])
        rows = np.column_stack([who[doc], a, b - a, base + w, ahead[w] + a - cuts[w]])
        return rows[rows[:, 2] > 0]

    def _block_of(self, q: int, token: int) -> int:
        """The last block at whose start queue q stands at or before token."""
        low, high = 0, (self.windows - 1) // BLOCK
        while low < high:
            mid = (low + high + 1) // 2
            if self._stand(mid)[q] <= token:
                low = mid
            else:
                high = mid - 1
        return low

    def _stand(self, b: int) -> np.ndarray:
        if b not in self.stands:
            if len(self.stands) > 4096:
                self.stands.clear()
            self.stands[b] = self.standing(b * BLOCK * self.length)
        return self.stands[b]


class Pools:
    """A schedule of any number of queues: the largest, and pools of the others that have schedules of their own."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, most: int = QUEUES) -> None:
        self.top, self.inside = np.arange(len(totals)), np.zeros(len(totals), np.int64)
        self.pools: dict[int, Schedule] = {}
        if len(totals) > most:
            order, half = np.argsort(-totals, kind="stable"), most // 2
            self.top[order[:half]] = np.arange(half)
            rest, queues = order[half:], [np.array([k]) for k in order[:half]]
            # a pool's sources run dry at about the same time; those without a share are apart
            by_end = rest[np.argsort(totals[rest] / np.where(shares[rest] > 0, shares[rest], np.inf), kind="stable")]
            size = max(most, -(-len(rest) // half))
            for some in (by_end[shares[by_end] > 0], by_end[shares[by_end] <= 0]):
                for pool in (some[at : at + size] for at in range(0, len(some), size)):
                    self.top[pool], self.inside[pool] = len(queues), np.arange(len(pool))
                    # one turn of a pool is what it gives to a window
                    turn = int(LENGTH * np.maximum(shares[pool], 0).sum() / max(np.maximum(shares, 0).sum(), 1e-300))
                    self.pools[len(queues)] = Schedule(totals[pool], shares[pool], turn or LENGTH)
                    queues.append(pool)
            totals, shares = (np.array([x[k].sum() for k in queues]) for x in (totals, np.maximum(shares, 0)))
        self.schedule = Schedule(totals, shares)

    def place(self, q: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """As Schedule.place, for queues of all sources."""
        if not self.pools:
            return self.schedule.place(q, first, n)
        top = self.top[q]
        alone = np.flatnonzero(~np.isin(top, list(self.pools)))
        # document, first token in its source, first token in the queue, length, queue
        parts = [np.column_stack([alone, first[alone], first[alone], n[alone], top[alone]])]
        for one in np.unique(top).tolist():
            if one in self.pools:
                who, pool = np.flatnonzero(top == one), self.pools[one]
                k, token, length, sequence, offset = pool.place(self.inside[q[who]], first[who], n[who]).T
                begin = np.where(sequence < pool.windows, sequence * pool.length, pool.windows * pool.length + pool.tail()[
                    np.maximum(sequence - pool.windows, 0)])
                parts.append(np.column_stack([who[k], token, begin + offset, length, np.full(len(k), one)]))
                pool.held.clear()  # there may be many pools
        doc, token, begin, length, top = np.concatenate(parts).T
        k, at, length, sequence, offset = self.schedule.place(top, begin, length).T
        rows = np.column_stack([doc[k], token[k] + at - begin[k], length, sequence, offset])
        rows = rows[np.lexsort([rows[:, 1], rows[:, 0]])]
        # pieces cut at a window of the pool only are one again
        a, b = rows[:-1], rows[1:]
        new = (a[:, [0, 3]] != b[:, [0, 3]]).any(1) | (a[:, 1] + a[:, 2] != b[:, 1]) | (a[:, 4] + a[:, 2] != b[:, 4])
        starts = np.flatnonzero(np.concatenate([[True], new])[: len(rows)])
        if len(starts):
            rows[starts, 2] = np.add.reduceat(rows[:, 2], starts)
        return rows[starts]


def pack(docs: DataFrame, weights: dict[str, float] | None = None, path: str | None = None) -> DataFrame:
    """PIECES of all documents. weights: target token shares by source, else the shares of the corpus itself."""
    path = path or tokenizer_path(TOKENIZER)
    table = written(encoded(docs, path), "ids")
    part = table.groupBy("source", "part").agg(F.sum("n").alias("n"))
    total = part.groupBy("source").agg(F.sum("n").alias("n"))
    each = total.toPandas().sort_values("source", na_position="first", ignore_index=True)  # a row for each source
    names = [None if pd.isna(x) else x for x in each["source"]]
    totals = each["n"].to_numpy(np.int64)
    shares = totals.astype(float) if weights is None else np.array([weights.get(x, 0.0) for x in names], float)
    schedule = Pools(totals, shares)
    queue = docs.sparkSession.createDataFrame(
        pd.DataFrame({"s": pd.Series(names, dtype=object), "q": range(len(names))}), "s string, q int")
    if len(names) <= BROADCAST_ROWS:
        queue = F.broadcast(queue)
    part = part.join(queue, F.col("source").eqNullSafe(F.col("s"))).select("source", "part", "n", "q")
    # a queue's stream goes by source and reader: one row each, so the window is as small as the list of readers
    run = Window.partitionBy("q").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select("source", "part", "q", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("base"))
    base = base.select(F.col("source").alias("s"), F.col("part").alias("p"), "q", "base")
    if part.count() <= BROADCAST_ROWS:  # else the ids are shuffled to it
        base = F.broadcast(base)
    placed = table.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                q, place, n = (batch.column(k).to_numpy() for k in (2, 3, 4))
                blobs = batch.column(5)
                _, offs, data = blobs.buffers()
                offs = np.frombuffer(offs, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
                ids = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(np.uint16).astype("<u4")
                begin = (offs[:-1] - offs[0]) // 2
                k, token, length, sequence, offset = schedule.place(q, place, n).T
                own_start = token - place[k]
                left = begin[k] + own_start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(left.tolist(), (left + length).tolist(), strict=True)]
                which = pa.array(k)
                yield pa.record_batch(
                    [batch.column(0).take(which), batch.column(1).take(which), *[pa.array(x, pa.int64()) for x in (
                        own_start, length, crc, n[k], sequence, offset)]],
                    names=[x.split()[0] for x in PIECES.split(", ")])

    return placed.select("doc_id", "source", "q", (F.col("base") + F.col("before")).alias("place"), "n", "ids"
                         ).mapInArrow(cut, PIECES)
