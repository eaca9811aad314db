"""Exact removal of repeated substrings by suffix arrays.

A byte goes where a string of MIN bytes covers it that also starts earlier in the corpus (smaller doc_id, or the same
document). Every MIN-byte window has an anchor, the leftmost smallest hash of its K-byte strings; equal windows have
equal anchors at equal places, so all copies of a window meet at its anchor's hash, and windows that share an anchor
form one segment of at most 2 MIN - K bytes.

1. Segments whose anchor hash occurs once can't repeat and are done; frequent hashes are known beforehand (a bounded
   list) and aren't shuffled to find that out.
2. Equal segments are counted and reduced to their first place before anything else: the later ones repeat as a whole.
3. What differs at one anchor hash is searched by suffix arrays: shards of anchors hold the bytes of their distinct
   segments; Larsson-Sadakane refinement sorts the suffixes in numpy by their first MIN bytes, and every run of suffixes
   that agree in these keeps its first place only. An anchor with more than BLOCK segments is
   split into shards of its own, which are merged pair by pair: the windows of one are looked up in the other's suffix
   array by binary search. Beyond DEAL shards, when that would copy segments more often than they have windows, the
   windows are dealt to shards by their content instead, so that work grows with their number.
4. Removed ranges meet their document, which is hashed without them.

Defined cases: a null or empty text has 0 bytes; texts shorter than MIN keep all; where doc_ids are null or repeated,
rows are ordered by doc_id (nulls first) and by a hash of the text, and each row counts as a document of its own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import own, written
from .textkit import chunks, hashes, mix, powers, sums

MIN, K = 100, 20
SPAN = MIN - K + 1
#: Anchor hashes found at least FREQUENT times in FREQUENT_ROWS segments of one reader; the FREQUENT_KEPT most
#: frequent of the corpus aren't shuffled to learn that they repeat. Results don't depend on it.
FREQUENT, FREQUENT_ROWS, FREQUENT_KEPT = 4, 1 << 18, 1 << 16
#: The list only steers the shuffle, so every FREQUENT_STEP-th row of a reader is looked at for it.
FREQUENT_STEP = 8
#: Segments of a shard: about half a megabyte of text, so that its arrays stay in a processor's cache.
SHARD_SEGMENTS, BLOCK = 4_000, 4_000
#: An anchor in more shards than this is dealt by windows.
DEAL = 45
#: A repeated segment found more often than this, or than its share of HOT_ROWS of all rows, meets its places by broadcast.
HOT, HOT_ROWS = 1_000, 1 << 16
CHUNK = 1 << 17
FILTER_BITS = 1 << 24
_U = np.uint64
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every run of width values."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    return best(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, row, start in row, length) of the segments of a chunk of rows."""
    none = tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    n = len(data)
    if n < MIN:
        return none
    prefix = sums(data)
    long_rows = np.flatnonzero(offs[1:] - offs[:-1] >= MIN)
    if not len(long_rows):
        return none
    gram = mix((prefix[K:] - prefix[:-K]) * powers(n)[1][: n - K + 1]) | _U(1)
    low = _slide(gram, SPAN, np.minimum)  # smallest hash of each window
    end = 0
    for r in long_rows.tolist():  # no window crosses rows
        low[end : offs[r]] = 0
        end = int(offs[r + 1]) - MIN + 1
    low[end:] = 0
    # runs of windows with one smallest hash, inside one row
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    begin = offs[:-1][long_rows]
    new[begin] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    keep = low[first] != 0
    first, last = first[keep], last[keep]
    value = low[first]
    # a place is an anchor if it holds the smallest hash of a window that contains it
    padded = np.concatenate([np.zeros(SPAN - 1, _U), low, np.zeros(SPAN - 1, _U)])
    places = np.flatnonzero(_slide(padded, SPAN, np.maximum)[: len(gram)] == gram)
    j = np.searchsorted(places, first)
    while True:
        off = gram[places[j]] != value
        if not off.any():
            break
        j[off] += 1
    parts = []
    while len(first):  # equal hashes in one run: each window takes the leftmost
        p = places[j]
        end = np.minimum(last, p)
        parts.append((first, end, p))
        more = last > p
        first, last, value, j = p[more] + 1, last[more], value[more], j[more] + 1
        while len(j):
            off = gram[places[j]] != value
            if not off.any():
                break
            j[off] += 1
    first, last, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(first, kind="stable")
    first, last, p = first[order], last[order], p[order]
    row = np.searchsorted(offs, first, "right") - 1
    whole = mix(hashes(prefix, first, last + MIN) ^ (p - first).astype(_U))
    return gram[p], whole, row, first - offs[row], last - first + MIN


def _frequent(docs: DataFrame) -> DataFrame:
    """(a, n): anchor hashes that one reader found often."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(held), return_counts=True)
            got, n = got[n >= FREQUENT], n[n >= FREQUENT]
            held.clear()
            return pa.record_batch([pa.array(got.view(np.int64)), pa.array(n)], names=["a", "n"])

        for batch in batches:
            rows = batch.column(0).take(pa.array(np.arange(0, batch.num_rows, FREQUENT_STEP)))
            for _, data, offs in chunks(rows, CHUNK):
                held.append(segments(data, offs)[0])
                if sum(map(len, held)) >= FREQUENT_ROWS:
                    yield often()
        if held:
            yield often()

    return docs.select("text").mapInArrow(read, "a long, n long")


def _rows(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """(a, s, id, at, late): anchor and segment hash, document, start * 256 + length, and whether frequent."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, offs in chunks(batch.column(1), CHUNK):
                a, s, row, first, n = segments(data, offs)
                late = last[np.minimum(np.searchsorted(last, a), len(last) - 1)] == a if len(last) else a == 0
                yield pa.record_batch(
                    [pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), batch.column(0).take(pa.array(row + start)),
                     pa.array(first * 256 + n), pa.array(late)], names=["a", "s", "id", "at", "late"])

    return docs.select("id", "text").mapInArrow(read, "a long, s long, id long, at long, late boolean")


class SuffixArray:
    """All suffixes of some byte strings in order, by Larsson-Sadakane refinement, with common prefixes by Kasai. With a
    depth, the suffixes of at least so many bytes in order of their first `depth` bytes: refinement ends there, and a
    suffix takes part as long as it has the bytes of the round. Those equal in `depth` bytes are one group."""

    def __init__(self, strings: list[bytes], depth: int | None = None) -> None:
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])  # an end mark after each
        n = int(self.begin[-1])
        self.raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.of = np.repeat(np.arange(len(strings)), size + 1)
        self.rest = self.begin[self.of + 1] - 1 - np.arange(n)  # bytes from here to the end of the string
        if depth is None:
            self.text = np.where(self.rest > 0, self.raw.astype(np.int32) + 1, 0)
            self.order, self.rank = self._sorted()
        else:
            self.order, self.group = self._sorted_to(depth)

    def _sorted_to(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, where each one's group begins) of the suffixes of at least depth bytes, 8 or more."""
        n, h = len(self.raw), 8
        key = self.raw.astype(_U)
        for k in (1, 2, 4):  # the first eight bytes
            key = (key[: max(len(key) - k, 0)] << _U(8 * k)) | key[k:]
        order = np.flatnonzero(self.rest >= h)
        by = np.argsort(key[order])
        order, key = order[by], key[order[by]]
        rank = np.zeros(n, np.int64)
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[1:] != key[:-1]
        while True:
            group = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            if h == depth:
                return order, group
            rank[order] = group
            step = min(h, depth - h)
            h += step
            live = self.rest[order] >= h
            order, group = order[live], group[live]
            fresh = np.ones(len(order), bool)
            fresh[1:] = group[1:] != group[:-1]
            # only groups of several are refined
            at = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
            who = order[at]
            after = rank[who + step]
            by = np.argsort((group[at] << 32) | after)  # places fit 31 bits: a shard is small
            order[at], after = who[by], after[by]
            fresh[at[1:]] |= after[1:] != after[:-1]

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        n, h = len(self.text), 7
        key = np.zeros(n, np.int64)
        for k in range(h):  # the first seven symbols, none beyond the end of the string
            part = np.zeros(n, np.int64)
            part[: n - k] = self.text[k:]
            key = (key << 9) | np.where(self.rest > k, part, 0)
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        rank[order] = np.repeat(head, np.diff(np.append(head, n)))  # a group's rank is where it begins
        while True:
            # only groups of several suffixes that are longer than h are refined
            size = np.diff(np.append(head, n))
            wide = np.repeat(size > 1, size)
            at = np.flatnonzero(wide)
            at = at[self.rest[order[at]] >= h] if len(at) else at
            if not len(at):
                break
            group = np.flatnonzero(wide)
            who = order[group]
            after = np.where(self.rest[who] >= h, rank[np.minimum(who + h, n - 1)] + 1, 0)
            by = np.argsort((rank[who] << 32) | after)  # places fit 31 bits: a shard is small
            order[group] = who = who[by]
            after = after[by]
            old = rank[who]
            fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])])
            start = np.maximum.accumulate(np.where(fresh, group, 0))
            rank[who] = start
            head = np.flatnonzero(rank[order] == np.arange(n))
            h *= 2
            if h > int(self.rest.max(initial=0)) + 1:
                break
        # equal suffixes go by place: Kasai's walk needs one order for them at every byte
        return np.argsort((rank << 32) | np.arange(n)), rank

    def common(self) -> np.ndarray:
        """For each place in order, the common prefix with the place before: Kasai's walk along all strings at once,
        in which a suffix has at least one less in common than the one a byte before."""
        n = len(self.text)
        where = np.empty(n, np.int64)
        where[self.order] = np.arange(n)
        out = np.zeros(n, np.int64)
        at = self.begin[:-1].copy()
        now = np.zeros(len(at), np.int64)
        live = self.rest[at] > 0
        at, now = at[live], now[live]
        while len(at):
            w = where[at]
            other = self.order[np.maximum(w - 1, 0)]
            most = np.where(w > 0, np.minimum(self.rest[at], self.rest[other]), 0)
            now = np.minimum(now, most)
            todo = np.flatnonzero(now < most)
            while len(todo):
                same = self.text[at[todo] + now[todo]] == self.text[other[todo] + now[todo]]
                todo = todo[same]
                now[todo] += 1
                todo = todo[now[todo] < most[todo]]
            out[w] = now
            at, now = at + 1, np.maximum(now - 1, 0)
            live = self.rest[at] > 0
            at, now = at[live], now[live]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, their MIN bytes as one value each) of all windows, in order."""
        at = self.order[self.rest[self.order] >= MIN]
        view = np.lib.stride_tricks.sliding_window_view(self.raw, MIN) if len(at) else None
        return at, np.ascontiguousarray(view[at]).view(f"V{MIN}").ravel() if len(at) else np.zeros(0, f"V{MIN}")


def repeated(strings: list[bytes], place: np.ndarray) -> np.ndarray:
    """Which places of the concatenated strings (an end mark after each) start a window that an earlier window equals.
    place: the rank of each string's first byte in the corpus, rising along its bytes."""
    sa = SuffixArray(strings, MIN)
    out = np.zeros(len(sa.of), bool)
    if len(sa.order):
        first = place[sa.of[sa.order]] + sa.order - sa.begin[sa.of[sa.order]]
        head = np.flatnonzero(sa.group == np.arange(len(sa.group)))
        low = np.minimum.reduceat(first, head)
        out[sa.order[first > np.repeat(low, np.diff(np.append(head, len(first))))]] = True
    return out


def merged(one: list[bytes], two: list[bytes], at_one: np.ndarray, at_two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """repeated() across two shards: each window of two is looked up in one's suffix array by binary search."""
    a, b = SuffixArray(one, MIN), SuffixArray(two, MIN)
    out_a, out_b = np.zeros(len(a.of), bool), np.zeros(len(b.of), bool)
    pa_, wa = a.windows()
    pb, wb = b.windows()
    if len(pa_) and len(pb):
        first_a = at_one[a.of[pa_]] + pa_ - a.begin[a.of[pa_]]
        first_b = at_two[b.of[pb]] + pb - b.begin[b.of[pb]]
        raw_a, raw_b = wa.view(f"S{MIN}"), wb.view(f"S{MIN}")
        low, high = _search(wa, wb)
        hit = np.flatnonzero(low < high)
        del raw_a, raw_b
        if len(hit):
            least = np.minimum.reduceat(np.append(first_a, 0), np.column_stack([low[hit], high[hit]]).ravel())[::2]
            out_b[pb[hit[least < first_b[hit]]]] = True
            # and windows of one that come after one of two
            order = np.lexsort((first_b[hit], low[hit]))
            rows, starts = hit[order], low[hit][order]
            new = np.concatenate([[True], starts[1:] != starts[:-1]])
            for s, e, f in zip(starts[new].tolist(), high[rows][new].tolist(), first_b[rows][new].tolist(), strict=True):
                out_a[pa_[s:e][first_a[s:e] > f]] = True
    return out_a, out_b


def _search(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of equal entries of a sorted table of MIN-byte values, by binary search in eight-byte steps."""
    words = lambda x: np.ascontiguousarray(
        np.pad(x.view(np.uint8).reshape(len(x), MIN), ((0, 0), (0, -MIN % 8)))).view(">u8").astype(_U)
    t, q = words(table), words(asked)

    def bound(right: bool) -> np.ndarray:
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(t))
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(t) - 1)
            less, equal = np.zeros(len(q), bool), np.ones(len(q), bool)
            for c in range(t.shape[1]):
                x = t[mid, c]
                less |= equal & (x < q[:, c])
                equal &= x == q[:, c]
            up = (less | equal) if right else less
            open_ = low < high
            low, high = np.where(open_ & up, mid + 1, low), np.where(open_ & ~up, mid, high)
        return low

    return bound(False), bound(True)


def _ranges(frame: pd.DataFrame, mark: np.ndarray, begin: np.ndarray) -> pd.DataFrame:
    """Marked windows of the segments in frame as ranges (id, first, last + 1) of bytes of their documents."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(begin, a, "right") - 1
    start = frame["at"].to_numpy()[of] // 256 + a - begin[of]
    return pd.DataFrame({"id": frame["id"].to_numpy()[of], "a": start, "b": start + (b - a) + MIN - 1})


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges that repeat inside each shard, or across the two shards of a pair."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "id", "at"], ignore_index=True)
        order = np.lexsort((frame["at"], frame["id"]))
        place = np.empty(len(frame), np.int64)
        ids, starts = frame["id"].to_numpy(), frame["at"].to_numpy() // 256
        # ranks that rise with (id, start) and leave room for the bytes of a segment and its neighbours
        base = np.concatenate([[0], np.cumsum(np.where(ids[order][1:] != ids[order][:-1], 1 << 20,
                               np.minimum(starts[order][1:] - starts[order][:-1], 1 << 20)))])
        place[order] = base
        strings = frame["bytes"].tolist()
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            mark = repeated(strings, place)
            return _ranges(frame, mark, np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])]))
        left = (frame["side"] == 0).to_numpy()
        n = int(left.sum())
        if n in (0, len(frame)):
            return frame.iloc[:0][["id"]].assign(a=0, b=0)
        out = []
        for rows, mark in zip((frame.iloc[:n], frame.iloc[n:]), merged(
                strings[:n], strings[n:], place[:n], place[n:]), strict=True):
            out.append(_ranges(rows, mark, np.concatenate([[0], np.cumsum(rows["bytes"].str.len() + 1)])))
        return pd.concat(out)

    key, parts = None, []
    for frame in batches:
        for now, rows in frame.groupby(["g", "i", "j"], sort=False):
            if now != key and parts:
                yield solve(pd.concat(parts))
                parts = []
            key = now
            parts.append(rows)
    if parts:
        yield solve(pd.concat(parts))


def _numbered(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text): id is doc_id where doc_ids are unique and not null; else rows get numbers in order."""
    docs = own(docs, "doc_id", "text")
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.select(F.col("doc_id").alias("id"), "doc_id", "text")
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([pa.array(np.full(len(b), part)), pa.array(np.arange(n, n + len(b))), *b.columns[:2]],
                                  names=["part", "k", "doc_id", "text"])
            n += len(b)

    rows = written(ordered.mapInArrow(count, "part long, k long, doc_id long, text string"), "numbered")
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    base = rows.groupBy("part").agg(F.count("*").alias("n")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("base"))
    return rows.join(base, F.col("part") == F.col("p")).select((F.col("base") + F.col("k")).alias("id"), "doc_id", "text")


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits (2 MB) with the bit of each id set; where it fills up it only spares less."""
    at = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(at.alias("at")).selectExpr("cast(at div 64 as int) w", "shiftleft(1L, cast(at % 64 as int)) v")
    rows = words.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return out


def _sifted(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(id, doc_id, packed, in_filter): compressed texts of the ids in the filter, and null texts of the others."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                slot = b.column(3).to_numpy()
                b = b.filter(pa.array((held.value[slot >> 6] >> (slot & 63)) & 1 == 1))
                packed = [packer.compress(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(packed, pa.binary())],
                                      names=["id", "doc_id", "packed"])

    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("slot")
    return docs.select("id", "doc_id", "text", slot).mapInArrow(sift, "id long, doc_id long, packed binary")


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(a, g, blocks, block, id, at) with the bytes of each segment."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("a", "g", "blocks", "block", "at")).alias("w"))
    lists = written(lists, "wanted")
    texts = _sifted(docs, _bit_filter(lists.select("id"))).select(F.col("id").alias("d"), "packed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for big in batches:
            for first in range(0, big.num_rows, 1000):
                batch = big.slice(first, 1000)
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy()).tolist()
                _, g, blocks, block, at = lists.flatten().flatten()
                places, pieces, n = at.to_numpy().tolist(), [], 0
                for packed, size in zip(batch.column(2).to_pylist(), sizes, strict=True):
                    text = unpacker.decompress(packed)
                    pieces += [text[p >> 8 : (p >> 8) + (p & 255)] for p in places[n : n + size]]
                    n += size
                ids = pa.array(np.repeat(batch.column(0).to_numpy(), sizes))
                out = pa.record_batch([g, blocks, block, ids, at, pa.array(pieces, pa.binary())],
                                      names=["g", "blocks", "block", "id", "at", "bytes"])
                wide = blocks.to_numpy() > DEAL
                yield out.filter(pa.array(~wide)) if wide.any() else out
                for k in range(0, int(wide.sum()), 1000):
                    yield dealt(out.filter(pa.array(wide)).slice(k, 1000))

    def dealt(rows: pa.RecordBatch) -> pa.RecordBatch:
        """The windows of segments, in shards of their anchor that their content picks."""
        out = [(f"{g}.{zlib.crc32(w) % (blocks * MIN)}", 1, 0, i, at + (k << 8) - (at & 255) + MIN, w)
               for g, blocks, i, at, text in zip(*(rows.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True)
               for k in range(len(text) - MIN + 1) for w in (text[k : k + MIN],)]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), rows.schema.types, strict=True)], names=rows.schema.names)

    joined = lists.join(texts, F.col("id") == F.col("d")).select("id", "w", "packed")
    return joined.mapInArrow(cut, "g string, blocks int, block int, id long, at long, bytes binary")


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(id, a, b): ranges of bytes to remove, which may overlap, for docs(id, doc_id, text)."""
    often = _frequent(docs).groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT_KEPT)
    last = np.sort(often.select("a").toPandas()["a"].to_numpy(np.int64).view(_U))  # bounded by FREQUENT_KEPT
    rows = _rows(docs, last)
    n = F.count("*").over(Window.partitionBy("a"))
    once = rows.where("not late").select("a", "s", "id", "at").withColumn("n", n).where("n > 1").drop("n")
    rows = written(once.union(rows.where("late").select("a", "s", "id", "at")), "segments")
    kinds = rows.groupBy("a", "s").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("f"))
    kinds = written(kinds.select("a", "s", "n", F.col("f.id").alias("fid"), F.col("f.at").alias("fat")), "kinds")
    many = kinds.where("n > 1").select(F.col("a").alias("ka"), F.col("s").alias("ks"), "fid", "fat")
    # a segment that a large part of the rows repeat is no key of a shuffle; there are few of them
    often = F.col("n") > max(HOT, rows.count() // HOT_ROWS)
    hot = kinds.where(often).select(F.col("a").alias("ha"), F.col("s").alias("hs"), F.col("fid").alias("hid"), F.col("fat").alias("hat"))
    told = rows.join(F.broadcast(hot), (F.col("a") == F.col("ha")) & (F.col("s") == F.col("hs")), "left")
    rest = told.where("hid is null").join(many, (F.col("a") == F.col("ka")) & (F.col("s") == F.col("ks"))).where("id <> fid or at <> fat")
    span = F.expr("at div 256").alias("a"), F.expr("at div 256 + at % 256").alias("b")
    later = rest.select("id", *span).union(told.where("id <> hid or at <> hat").select("id", *span))
    several = kinds.groupBy("a").agg(F.count("*").alias("m")).where("m > 1")
    some = kinds.join(several, "a")
    total = some.agg(F.count("*")).first()[0]
    shards = max(1, -(-total // SHARD_SEGMENTS))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    g = F.when(blocks == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("a"), F.lit(shards)).cast("string"))).otherwise(
        F.concat(F.lit("a"), F.col("a").cast("string")))
    wanted = some.select("a", g.alias("g"), blocks.alias("blocks"), F.pmod(F.xxhash64("s"), blocks).cast("int").alias(
        "block"), F.col("fid").alias("id"), F.col("fat").alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"),
        F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    placed = _bytes_of(docs, wanted).select("g", "id", "at", "bytes", F.explode(pairs).alias("p")).select(
        "g", "p.*", "id", "at", "bytes")
    placed = placed.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return later.union(placed.mapInPandas(_solved, "id long, a long, b long"))


def _kept(text: bytes, ranges: np.ndarray) -> tuple[int, int, int, str]:
    """(n_bytes, n_removed, n_spans, hash of the rest) for ranges [a, b) of text."""
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, ranges[:, 0], 1)
    np.add.at(mark, ranges[:, 1], -1)
    gone = np.cumsum(mark)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()


def dedup(table: DataFrame) -> DataFrame:
    """OUT for every row of table."""
    docs = _numbered(table)
    spans = written(removed_ranges(docs).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("r")), "ranges")
    bits = _bit_filter(spans.select("id"))
    held = table.sparkSession.sparkContext.broadcast(bits)
    names = [x.split()[0] for x in OUT.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(2).to_numpy()
            b = b.filter(pa.array((held.value[slot >> 6] >> (slot & 63)) & 1 == 0))
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            none = pa.array(np.zeros(len(texts), np.int64))
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in texts], pa.int64()), none, none,
                                   pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=names)

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k in range(b.num_rows):
                r = b.column(2).slice(k, 1).flatten()
                found = np.column_stack([r.field(0), r.field(1)]) if len(r) else np.zeros((0, 2), np.int64)
                out.append(_kept(unpacker.decompress(b.column(1)[k].as_py()), found))
            yield pa.record_batch([b.column(0), *[pa.array(c) for c in zip(*out, strict=True)]], names=names) if out else \
                pa.RecordBatch.from_pylist([], schema=pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))

    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("slot")
    untouched = docs.select("doc_id", "text", slot).mapInArrow(whole, OUT)
    touched = _sifted(docs, bits).join(spans.select(F.col("id").alias("d"), "r"), F.col("id") == F.col("d"), "left")
    return untouched.union(touched.select("doc_id", "packed", "r").mapInArrow(less, OUT))
