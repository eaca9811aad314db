"""Best-two-fit packing of token sequences, on counts of piece sizes.

Documents of more than LENGTH tokens are cut into pieces of LENGTH, the first taking what is left over; all others stay
whole. Packing depends on sizes only, and there are at most LENGTH sizes, so that the packing of any corpus is decided
on a table of at most LENGTH counts:

* fill greedily: a bin takes the largest unpacked piece, then the largest that fits its gap, until none fits;
* two-fit: while the bin has a gap, its smallest piece goes back if two unpacked pieces fit the gap that this leaves more
  tightly; the pair that leaves least is taken, with the larger first piece on ties;
* equal bins follow each other until a size that the bin's making looked at runs out, so they are one row of the plan,
  with how often it is used. The plan is what packing one bin after another gives, in a few thousand rows at most.

Documents then find their places alone: the r-th piece of a size belongs to the bin that uses up the r-th piece. r comes
from the count of the size in earlier partitions (at most LENGTH rows each) and the number within the partition, so no
size, however common, meets in one task.

Defined cases: a null or empty text is one end id; a null doc_id stays null; repeated rows are packed each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import own, written
from .tokens import encoder, tokenizer_path

LENGTH, END, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
#: A row for each partition and size is broadcast up to so many rows (about 10 MB).
BROADCAST_ROWS = 1 << 18
PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def _pair(count: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """Sizes of two unpacked pieces that leave least of room and sum to more than above; the larger first piece on ties."""
    have = np.flatnonzero(count[: max(room, 0)])  # sizes below room
    if not len(have):
        return None
    # for each first size the largest second that fits; a size that is there once isn't taken twice
    at = np.searchsorted(have, room - have, "right") - 1
    alone = (at >= 0) & (have[at] == have) & (count[have] < 2)
    at = np.where(alone, at - 1, at)
    total = np.where(at >= 0, have + have[at], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(have[best]), int(have[at[best]])) if total[best] > above else None


def plan(sizes: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Bins (sizes of its pieces in order, how many such bins) that hold sizes[s] pieces of each size s."""
    count = np.zeros(length + 1, np.int64)
    for s, n in sizes.items():
        count[s] = n
    out: list[tuple[tuple[int, ...], int]] = []
    while count.any():
        left, peak, bin_, gap = count.copy(), np.zeros(length + 1, np.int64), [], length

        def take(s: int) -> None:
            left[s] -= 1
            peak[s] = max(peak[s], int(count[s] - left[s]))  # noqa: B023
            bin_.append(s)  # noqa: B023

        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            s = int(fits[-1])
            take(s)
            gap -= s
        while gap and len(bin_) and (pair := _pair(left, bin_[-1] + gap, bin_[-1])):
            gone = bin_.pop()
            left[gone] += 1
            for s in pair:
                take(s)
            gap += gone - sum(pair)
            bin_.sort(reverse=True)
        use = count - left
        used = np.flatnonzero(use)
        # the next bin is equal as long as every size still has what this one's making took of it at most
        n = int(((count[used] - peak[used]) // use[used]).min()) + 1
        count -= n * use
        out.append((tuple(bin_), n))
    return out


class Places:
    """Where the r-th piece of each size goes, for a plan."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> None:
        at: dict[int, list[tuple[int, int, int, int]]] = {}
        first, used = 0, np.zeros(length + 1, np.int64)
        for sizes, n in bins:
            start = 0
            for s in sizes:
                # pieces used[s] .. used[s] + n - 1 of this size lie at start in the n bins
                at.setdefault(s, []).append((int(used[s]), first, start, n))
                used[s] += n
                start += s
            first += n
        self.bins = first
        self.of = {s: np.array(rows, np.int64) for s, rows in at.items()}

    def find(self, size: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their size and number among those of the size."""
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size).tolist():
            who, rows = np.flatnonzero(size == s), self.of[s]
            k = np.searchsorted(rows[:, 0], r[who], "right") - 1
            sequence[who] = rows[k, 1] + r[who] - rows[k, 0]
            offset[who] = rows[k, 2]
        return sequence, offset


def encoded(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, part, n, size, nth, full, nth_full, ids): each document's ids with the end id, as bytes of numbers of 16
    bits (32 for a large vocabulary), the size of its first piece, how many pieces of that size its partition had before, how many full pieces follow
    and how many of those the partition had before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, own_encoder = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64), encoder(path, True)
        kind = np.dtype("<u2" if own_encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                ids, size = own_encoder.encode(batch.column(1))
                ids, n = np.insert(ids.astype(kind), np.cumsum(size), END), size + 1
                ends = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
                blobs = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                first = (n - 1) % length + 1
                full = (n - first) // length
                # pieces of a partition in order: each document's first piece, then its full ones
                order = np.argsort(first, kind="stable")
                run = np.searchsorted(first[order], first[order])
                nth = np.empty(len(n), np.int64)
                nth[order] = np.arange(len(n)) - run
                nth += before[first]
                shift = np.cumsum(full) - full
                nth = np.where(first == length, nth + shift, nth)
                nth_full = before[length] + shift + np.cumsum(first == length)
                before += np.bincount(first, minlength=length + 1)
                before[length] += int(full.sum())
                yield pa.record_batch(
                    [batch.column(0), pa.array(np.full(len(n), part, np.int64)),
                     *map(pa.array, (n, first, nth, full, nth_full)), blobs],
                    names=[x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, part long, n long, size long, nth long, full long, nth_full long, ids binary"
    return own(docs, "doc_id", "text").mapInArrow(read, schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """PIECES of all documents(doc_id, text) in sequences of at most length tokens; ids are 32-bit numbers,
    little-endian."""
    table = written(encoded(docs, path or tokenizer_path(TOKENIZER), length), "ids")
    firsts = table.groupBy("part", "size").agg(F.count("*").alias("c"))
    fulls = table.groupBy("part").agg(F.sum("full").alias("c")).select("part", F.lit(length).cast("long").alias("size"), "c")
    counts = written(firsts.union(fulls).groupBy("part", "size").agg(F.sum("c").alias("c")), "sizes")
    sizes = {r[0]: r[1] for r in counts.groupBy("size").agg(F.sum("c").alias("c")).where("c > 0").collect()}  # <= length rows
    places = Places(plan(sizes, length), length)
    run = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = counts.select(F.col("part").alias("p"), F.col("size").alias("s"), F.coalesce(F.sum("c").over(run), F.lit(0)).alias("base"))
    full_base = base.where(F.col("s") == length).select(F.col("p").alias("pf"), F.col("base").alias("full_base"))
    if counts.count() <= BROADCAST_ROWS:  # else the ids are shuffled to it
        base, full_base = F.broadcast(base), F.broadcast(full_base)
    placed = table.join(base, (F.col("part") == F.col("p")) & (F.col("size") == F.col("s"))).join(
        full_base, F.col("part") == F.col("pf"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                n, size, r, full, r_full = (batch.column(k).to_numpy() for k in range(1, 6))
                doc = np.repeat(np.arange(len(n)), full + 1)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
                long = np.where(piece == 0, size[doc], length)
                nth = np.where(piece == 0, r[doc], r_full[doc] + piece - 1)
                start = np.where(piece == 0, 0, size[doc] + (piece - 1) * length)
                sequence, offset = places.find(long, nth)
                blobs = batch.column(6)
                _, offs, data = blobs.buffers()
                offs = np.frombuffer(offs, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
                wide = "<u2" if offs[-1] - offs[0] == 2 * int(n.sum()) else "<u4"
                # pieces follow each other in the batch as they do in their documents
                ids = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(wide).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(long)]) * 4
                ids = pa.Array.from_buffers(
                    pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(long),
                     ids, pa.array(sequence), pa.array(offset)],
                    names=[x.split()[0] for x in PIECES.split(", ")])

    return placed.select("doc_id", "n", "size", (F.col("base") + F.col("nth")).alias("r"), "full",
                         (F.col("full_base") + F.col("nth_full")).alias("r_full"), "ids").mapInArrow(cut, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """PIECES with the crc32 of the ids in their place."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
