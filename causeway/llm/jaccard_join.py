"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct word shingles. Equal sets are one class from the start. The join is
exact; what can't link is put aside in two steps before the trees see it:

1. Every class emits its shingles from the low end of the hash range: a bit over a fifth of them, less of a fifth the
   larger the set (_cut). A class that alone has more than 0.2 n of them is done, as a partner lacks at most 0.2 n.
2. The others emit their whole sets and are judged so once more. Each of the rest takes the prefix of its set of which
   a partner must hold something, floor(0.2 n) + 1 shingles, rarest first, so that passages many documents share
   hardly come up; classes that share a prefix shingle are connected into cells (through the smallest class, never
   pair by pair). No two classes of different cells can link.
3. Each cell is searched by a signature tree: nodes hold the OR of token bitmaps, the range of set sizes and the
   largest number of tokens that fell on taken bits. A dual traversal drops node pairs whose largest possible overlap
   or whose sizes rule a link out, and node pairs that are one component already. What is left is counted exactly.
   A cell beyond BLOCK_SHINGLES is split into blocks of about one size and smallest shingle; pairs of blocks that their
   sizes and OR-combined bitmaps leave possible are searched, one task each, and no other pair copies a text.
4. Links found (a spanning forest of each cell) are connected again; classes give components to their documents.

The most frequent shingles are known beforehand (a bounded list); they count as shared without being shuffled, so no
key of a shuffle has many rows.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a null
doc_id takes part and takes the smallest known doc_id of its component (null if none); repeated rows are linked like
any equal texts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linking import components
from .tables import fresh, own, written
from .textkit import chunks, mix, shingle_sets

WIDTH = 5
#: Shingles found at least FREQUENT times in FREQUENT_ROWS shingles of one reader are counted over the corpus; the
#: FREQUENT_KEPT most frequent go last in the order. This only steers the order; links don't depend on it.
FREQUENT, FREQUENT_ROWS, FREQUENT_KEPT = 4, 1 << 20, 1 << 16
#: What counts as the number of classes with a frequent shingle: more than any other.
MANY = 1 << 40
#: Bits of the filter that spares texts a shuffle before the exact join by doc_id: 2 MB whatever the corpus; where
#: it fills up, it only spares less.
FILTER_BITS = 1 << 24
#: A block of a cell holds about so many shingles (8 bytes each).
BLOCK_SHINGLES = 4_000_000
#: Bits of the bitmap of a block, and rows of a table that is broadcast (16 bytes each).
SIGNATURE, BROADCAST_ROWS = 1 << 12, 1 << 18
LEAF, FAN = 16, 8
_U = np.uint64


def _class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id for each set, 0 for the empty one."""
    ids = np.zeros(len(sets), _U)
    with np.errstate(over="ignore"):
        for k, s in enumerate(sets):
            if len(s):
                ids[k] = (mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) ^ _U(len(s))) | _U(1)
    return mix(ids) if len(ids) else ids


def _classes(docs: DataFrame) -> DataFrame:
    """Rows (kind, a, b, c, d, e): kind 0 has doc_id, set size and class of each document, how many of its shingles
    every partner emits too where it has them, and below which hash; kind 1 a shingle and how often one reader found
    it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for first, data, offs in chunks(batch.column(1)):
                sets = shingle_sets(data, offs, WIDTH)
                size = np.array([len(s) for s in sets], np.int64)
                ids = pa.array(_class_ids(sets).view(np.int64), mask=size == 0)
                cut = [_cut(1.25 * n) for n in size.tolist()]
                low = [int(np.searchsorted(x, _U(2 * e))) for x, e in zip(sets, cut, strict=True)]
                yield _rows(0, batch.column(0).slice(first, len(sets)), pa.array(size), ids, pa.array(low, pa.int64()),
                            pa.array(cut, pa.int64()))
                held += sets
                if sum(map(len, held)) >= FREQUENT_ROWS:
                    yield _frequent(held)
                    held = []
        if held:
            yield _frequent(held)

    return own(docs, "doc_id", "text").mapInArrow(read, "kind int, a long, b long, c long, d long, e long")


def _rows(kind: int, *columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], names=["kind", *"abcde"])


def _frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
    got, n = np.unique(np.concatenate(sets), return_counts=True)
    got, n = got[n >= FREQUENT], n[n >= FREQUENT]
    none = pa.array(np.zeros(len(n), np.int64))
    return _rows(1, pa.array(got.view(np.int64)), pa.array(n), none, none, none)


def _is_late(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    if not len(last):
        return np.zeros(len(s), bool)
    return last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s


def _cut(n: float) -> int:
    """Half of the hash below which a set of n shingles emits: it falls with n, and leaves about 2.6 standard
    deviations beyond a fifth of the shingles."""
    share = min(1.0, 0.2 + 1.04 / max(n, 1e-9) ** 0.5)
    return min(int(share * (1 << 53)) << 10, (1 << 63) - 1)


def _shingles(docs: DataFrame, last: np.ndarray, whole: bool) -> DataFrame:
    """(h, c, late): the low shingles of each class, or all of them, once for each reader that meets it; late marks
    the frequent ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, data, offs in chunks(batch.column(0)):
                sets = shingle_sets(data, offs, WIDTH)
                keys, owners, marks = [], [], []
                for c, s in zip(_class_ids(sets).tolist(), sets, strict=True):
                    if not len(s) or c in met:
                        continue
                    met.add(c)
                    if not whole:
                        s = s[: np.searchsorted(s, _U(2 * _cut(len(s))))]
                    keys.append(s)
                    marks.append(_is_late(s, last))
                    owners.append(np.full(len(s), c, _U))
                if keys:
                    h, c = (np.concatenate(x).view(np.int64) for x in (keys, owners))
                    yield pa.record_batch([pa.array(h), pa.array(c), pa.array(np.concatenate(marks))],
                                          names=["h", "c", "late"])

    return own(docs, "text").mapInArrow(read, "h long, c long, late boolean")


def _shared(rows: DataFrame) -> DataFrame:
    """(h, c, df) of the rows whose shingle more than one class has. Frequent ones need no shuffle."""
    once = rows.where("not late").select("h", "c")
    df = F.count("*").over(Window.partitionBy("h"))
    # one reader emits a class once; the same class from two readers is told apart by the smallest and largest
    low, high = (f("c").over(Window.partitionBy("h")) for f in (F.min, F.max))
    met = once.select("h", "c", df.alias("df"), (low != high).alias("two")).where("two").select("h", "c", "df")
    return met.union(rows.where("late").select("h", "c", F.lit(MANY).alias("df")))


def _bit_words(ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(w, v): a filter of `bits` bits in words of 64 with the bit of each id(long) set, by partial aggregation; at
    most bits / 64 rows."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(at.alias("at")).selectExpr("cast(at div 64 as int) w", "shiftleft(1L, cast(at % 64 as int)) v")
    return words.groupBy("w").agg(F.bit_or("v").alias("v"))


def _sifted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs whose doc_id may be one of ids(id), and those whose isn't: by a bit filter, broadcast in at most
    FILTER_BITS / 64 rows. Rows without a doc_id are in one of both."""
    w, v = fresh(docs, "w"), fresh(docs, "v")
    words = F.broadcast(written(_bit_words(ids), "bits").toDF(w, v))
    at = F.pmod(F.xxhash64(F.col("`doc_id`").cast("long")), F.lit(FILTER_BITS))
    all_ = docs.join(words, F.floor(at / 64).cast("int") == F.col(w), "left")
    may = F.coalesce(F.getbit(F.col(v), F.pmod(at, F.lit(64)).cast("int")), F.lit(0)) == 1
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return all_.where(may).select(*columns), all_.where(~may).select(*columns)


def _bit_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The words of a filter as one array."""
    rows = _bit_words(ids, bits).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return out


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(c, text) of the classes in ids(doc_id, c): the texts that a small bit filter passes, then joined exactly."""
    held = docs.sparkSession.sparkContext.broadcast(_bit_filter(ids.select(F.col("doc_id").alias("id"))))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((words[at >> 6] >> (at & 63)) & 1 == 1)).select([0, 1])

    base = own(docs, "doc_id", "text").select(
        F.col("doc_id").alias("d"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("at"))
    passed = base.mapInArrow(sift, "d long, text string")
    return ids.join(passed, F.col("doc_id").eqNullSafe(F.col("d"))).select("c", "text")


def _one_each(texts: DataFrame) -> DataFrame:
    """One row for each class, with its own text, where doc_ids that are null or repeated brought others."""

    def own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy()
            for first, data, offs in chunks(batch.column(1)):
                ids = _class_ids(shingle_sets(data, offs, WIDTH)).view(np.int64)
                yield batch.slice(first, len(ids)).filter(pa.array(ids == c[first : first + len(ids)]))

    return texts.mapInArrow(own_text, "c long, text string").dropDuplicates(["c"])


def _cells(texts: DataFrame, sizes: DataFrame, last: np.ndarray) -> DataFrame:
    """(c, cell) of the classes that may link: those that share a shingle of their rarest-first prefix."""
    rows = written(_shared(_shingles(texts, last, True)), "shared")
    count = rows.groupBy("c").agg(F.count("*").alias("s")).join(sizes, "c")
    # the shingles that no other class has come first in the order and use up that much of the prefix
    left = F.expr("n - (4 * n + 4) div 5 + 1 - (n - s)").alias("left")
    able = count.select("c", left).where("left > 0")
    rank = F.row_number().over(Window.partitionBy("c").orderBy("df", "h"))
    near = rows.join(able, "c").withColumn("rank", rank).where("rank <= left").select("h", "c")
    near = written(near, "near")
    met = near.groupBy("h").agg(F.min("c").alias("m"), F.max("c").alias("x")).where("m <> x").select("h", "m")
    edges = near.join(met, "h").where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()
    return components(edges).toDF("c", "cell")


class _Tree:
    """Signature tree over sets, given in order of size: bitmaps, size ranges and bit collisions of its nodes."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        size = np.array([len(s) for s in sets])
        maps = np.zeros((len(sets), bits // 64), _U)
        for k, s in enumerate(sets):
            at = (s & _U(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[k], at >> 6, _U(1) << (at & 63).astype(_U))
        self.size, self.maps = size, maps
        self.spare = size - np.bitwise_count(maps).sum(1)
        self.levels: list[tuple] = []  # from the leaves up: bitmaps, smallest, largest, most spare, first, last
        low = high = size
        spare, ors, step = self.spare, maps, LEAF
        first = np.arange(len(sets))
        last = first + 1
        while True:
            cut = np.arange(0, len(low), step)
            ors = np.bitwise_or.reduceat(ors, cut)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            spare, first, last = np.maximum.reduceat(spare, cut), first[cut], np.maximum.reduceat(last, cut)
            self.levels.append((ors, low, high, spare, first, last))
            if len(cut) == 1:
                return
            step = FAN

    def children(self, level: int, k: int) -> np.ndarray:
        return np.arange(FAN * k, min(FAN * (k + 1), len(self.levels[level - 1][1])))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _possible(one: tuple, i: np.ndarray, two: tuple, j: np.ndarray) -> np.ndarray:
    """Whether a set under node i of one can link with a set under node j of two, by sizes and by bitmaps."""
    low_i, low_j, high_i, high_j = one[1][i], two[1][j], one[2][i], two[2][j]
    able = (5 * high_i >= 4 * low_j) & (5 * high_j >= 4 * low_i)
    most = np.bitwise_count(one[0][i] & two[0][j]).sum(-1) + np.minimum(one[3][i], two[3][j])
    return able & (9 * np.minimum(most, np.minimum(high_i, high_j)) >= 4 * (low_i + low_j))


def search(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of sets (right None: inside left); positions in left, and
    in right counted on from left's length."""
    both = left + (right or [])
    longest = float(np.median([len(s) for s in both]))
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * longest + 1)), 8, 14))
    parent = np.arange(len(both))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    def tree(sets: list[np.ndarray], start: int) -> tuple[_Tree, np.ndarray]:
        order = np.array(sorted(range(len(sets)), key=lambda k: (len(sets[k]), sets[k][0])))
        return _Tree([sets[k] for k in order], bits), order + start

    one, at_one = tree(left, 0)
    two, at_two = (one, at_one) if right is None else tree(right, len(left))
    leaf_one = (one.maps, one.size, one.size, one.spare)
    leaf_two = (two.maps, two.size, two.size, two.spare)
    found: list[tuple[int, int]] = []
    todo = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while todo:
        la, ka, lb, kb = todo.pop()
        a, b = one.levels[la], two.levels[lb]
        if not _possible(a, np.array([ka]), b, np.array([kb]))[0]:
            continue
        rows, cols = np.arange(a[4][ka], a[5][ka]), np.arange(b[4][kb], b[5][kb])
        roots = {root(int(x)) for x in at_one[rows]}
        if len(roots) == 1 and {root(int(x)) for x in at_two[cols]} == roots:
            continue
        if la or lb:
            if la >= lb and la:
                down = [(la - 1, int(k), lb, kb) for k in one.children(la, ka)]
            else:
                down = [(la, ka, lb - 1, int(k)) for k in two.children(lb, kb)]
            if one is two:  # each unordered pair of nodes once
                down = [x for x in down if one.levels[x[0]][4][x[1]] < two.levels[x[2]][5][x[3]]]
            todo += down[::-1]
            continue
        i, j = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
        if one is two:
            i, j = i[i < j], j[i < j]
        able = _possible(leaf_one, i, leaf_two, j)
        for p, q in zip(i[able].tolist(), j[able].tolist(), strict=True):
            x, y = int(at_one[p]), int(at_two[q])
            rx, ry = root(x), root(y)
            if rx == ry:
                continue
            common = _overlap(both[x], both[y])
            if 100 * common >= 80 * (len(both[x]) + len(both[y]) - common):
                parent[max(rx, ry)] = min(rx, ry)
                found.append((x, y))
    return found


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each (cell, i, j) of a partition sorted by them: texts of blocks i and j."""

    def solve(parts: list[tuple[int, int, str]], pair: bool) -> pd.DataFrame:
        sides: list[dict[int, np.ndarray]] = [{}, {}]
        for side, c, text in parts:
            if c not in sides[side]:
                for _, data, offs in chunks(pa.array([text])):
                    sides[side][c] = shingle_sets(data, offs, WIDTH)[0]
        left, right = (list(s.values()) for s in sides)
        names = [*sides[0], *sides[1]]
        links = search(left, right if pair else None) if left and (right or not pair) else []
        return pd.DataFrame([(names[x], names[y]) for x, y in links], columns=["a", "b"], dtype="int64")

    key, parts = None, []
    for frame in batches:
        for *now, side, c, text in frame[["cell", "i", "j", "side", "c", "text"]].itertuples(index=False, name=None):
            if now != key:
                if parts:
                    yield solve(parts, key[1] != key[2])
                key, parts = now, []
            parts.append((side, c, text))
    if parts:
        yield solve(parts, key[1] != key[2])


def _signed(rows: DataFrame) -> DataFrame:
    """rows(cell, c, n, text) with size, the number of the factor 1.25 in which n falls, low, the smallest shingle,
    and bits, the bitmap of all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in chunks(batch.column(3)):
                sets = shingle_sets(data, offs, WIDTH)
                bits = np.zeros((len(sets), SIGNATURE // 64), _U)
                for k, s in enumerate(sets):
                    at = (s & _U(SIGNATURE - 1)).astype(np.int64)
                    np.bitwise_or.at(bits[k], at >> 6, _U(1) << (at & 63).astype(_U))
                n = np.array([max(len(s), 1) for s in sets])
                low = np.array([s[0] if len(s) else 0 for s in sets], _U)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (SIGNATURE // 64)),
                                                 pa.array(bits.ravel().view(np.int64)))
                part = batch.slice(first, len(sets))
                yield pa.record_batch([*part.columns, pa.array(np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int64)),
                                       pa.array(low.view(np.int64)), lists], names=["cell", "c", "n", "text", "size", "low", "bits"])

    return rows.select("cell", "c", "n", "text").mapInArrow(
        read, "cell long, c long, n long, text string, size long, low long, bits array<long>")


def _blocked(rows: DataFrame) -> DataFrame:
    """(cell, i, j, side, c, text) for the large cells in rows(cell, c, n, text): classes of about one size and, as far
    as that goes, with one smallest shingle are a block; each pair of blocks whose sizes and OR-combined bitmaps leave
    a link possible is searched. Pairs are pruned on a row for each block, before texts are copied."""
    signed = written(_signed(rows), "signed")
    share = signed.groupBy("cell", "size").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("parts"))
    # several smallest shingles share a part; a common one is dealt by class
    often = signed.groupBy("cell", "size", "low").agg(F.sum("n").alias("m"))
    often = often.join(share, ["cell", "size"]).select("cell", "size", "low", F.pmod(F.xxhash64("low"), F.col("parts")).alias(
        "part"), F.ceil(F.col("m") / BLOCK_SHINGLES).cast("long").alias("split"))
    put = signed.join(often, ["cell", "size", "low"])
    block = F.when(F.col("split") > 1, F.xxhash64("size", "low", F.pmod(F.xxhash64("c"), F.col("split")))).otherwise(
        F.xxhash64("size", "part"))
    put = written(put.select("cell", "c", "n", "size", "text", "bits", block.alias("block")), "put")
    bit = F.posexplode("bits").alias("w", "v")
    words = put.select("cell", "block", bit).groupBy("cell", "block", "w").agg(F.bit_or("v").alias("v"))
    ors = words.groupBy("cell", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("bits"))
    spare = F.col("n") - F.aggregate("bits", F.lit(0).cast("long"), lambda a, v: a + F.bit_count(v))
    head = put.groupBy("cell", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(spare).alias("spare"), F.min("size").alias("size"))
    head = written(head.join(ors, ["cell", "block"]), "blocks")
    one, two = (head.select("cell", *[F.col(x).alias(x + k) for x in ("block", "low", "high", "spare", "size", "bits")]) for k in "12")
    met = one.withColumn("size2", F.explode(F.array(F.col("size1") - 1, F.col("size1"), F.col("size1") + 1))).join(two, ["cell", "size2"])
    both = F.aggregate(F.zip_with("bits1", "bits2", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("long"), lambda a, v: a + v)
    most = F.least(both + F.least("spare1", "spare2"), F.col("high1"), F.col("high2"))
    met = met.where("block1 <= block2 and 5 * high1 >= 4 * low2 and 5 * high2 >= 4 * low1").where(
        9 * most >= 4 * (F.col("low1") + F.col("low2")))
    sides = F.when(F.col("block1") == F.col("block2"), F.array(F.struct(F.col("block1").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("block1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.lit(1).alias("side"))))
    pairs = met.select("cell", F.col("block1").alias("i"), F.col("block2").alias("j"), F.explode(sides).alias("p")).select(
        "cell", "i", "j", "p.*")
    return pairs.join(put.select("cell", "block", "c", "text"), ["cell", "block"]).select("cell", "i", "j", "side", "c", "text")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, c) of every row and (c, root) of every class with a link."""
    read = written(_classes(docs), "classes")
    known = read.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "c")
    often = (
        read.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
        .orderBy(F.desc("n"), "a").limit(FREQUENT_KEPT).select("a").toPandas()["a"]
    )  # bounded by FREQUENT_KEPT
    last = np.sort(often.to_numpy(np.int64).view(_U))
    one = read.where("kind = 0 and c is not null").groupBy("c").agg(
        F.min("a").alias("doc_id"), F.max("b").alias("n"), F.max("d").alias("low"), F.max("e").alias("cut"))
    met = _shared(_shingles(docs, last, False)).select("h", "c").join(one.select("c", "cut"), "c")
    met = met.where(F.shiftrightunsigned("h", 1) < F.col("cut")).distinct().groupBy("c").agg(F.count("*").alias("s"))
    some = one.join(met, "c", "left").where("low - coalesce(s, 0) <= n div 5").select("c", "doc_id", "n")
    some = written(some, "some")
    texts = _texts_of(docs, some.select("doc_id", "c"))
    if not known.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        texts = _one_each(texts)
    texts = written(texts, "texts")
    cells = written(_cells(texts, some.select("c", "n"), last), "cells")
    member = cells.join(some.select("c", "n"), "c")
    # at most one row for BLOCK_SHINGLES shingles
    large = written(member.groupBy("cell").agg(F.sum("n").alias("all")).where(F.col("all") > BLOCK_SHINGLES).select(
        F.col("cell").alias("large")), "large")
    wide = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    whole = member.join(wide, F.col("cell") == F.col("large"), "left_anti").join(texts, "c")
    zero = F.lit(0).cast("long")
    placed = whole.select("cell", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), "c", "text")
    if not large.isEmpty():
        placed = placed.union(_blocked(member.join(wide, F.col("cell") == F.col("large"), "left_semi").join(texts, "c")))
    found = placed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "c")
    links = written(found.mapInPandas(_links, "a long, b long"), "links")
    return known, components(links).toDF("c", "root")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    known, roots = classes(docs)
    least = known.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low"))
    least = least.join(roots, "c", "left").select("c", "low", F.coalesce("root", "c").alias("root"))
    whole = least.groupBy("root").agg(F.min("low").alias("component_id"))
    named = least.join(whole, "root").select("c", "component_id")
    out = known.join(named, "c", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(
        F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id (of rows that repeat it the one with
    the smallest hash of its text). Rows without a doc_id can't be named and stay. Columns are those of docs. Rows that
    a bit filter of the ids that go sets apart are joined with these ids exactly; no other row is shuffled."""
    name, at = fresh(docs, "named"), fresh(docs, "at")
    same = F.col("doc_id") == F.col("component_id")
    ids = written(join(docs).where("doc_id is not null").groupBy("doc_id").agg(
        F.max(same.cast("int")).alias("kept"), F.count("*").alias("n")), "kept")
    gone = ids.where("kept = 0 or n > 1").select(F.col("doc_id").alias(name))
    met, rest = _sifted(docs, gone.select(F.col(name).alias("id")))
    out = rest.unionByName(met.join(gone, F.col("`doc_id`") == F.col(name), "left_anti"))
    twice = ids.where("kept = 1 and n > 1").select(F.col("doc_id").alias(name))
    if twice.isEmpty():
        return out
    once = F.row_number().over(Window.partitionBy(F.col("`doc_id`")).orderBy(F.xxhash64(F.col("`text`")), F.col("`text`")))
    some = met.join(twice, F.col("`doc_id`") == F.col(name), "left_semi").withColumn(at, once).where(F.col(at) == 1).drop(at)
    return out.unionByName(some)
