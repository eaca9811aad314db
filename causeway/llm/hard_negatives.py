"""Hard-negative mining: a full sort of each anchor's scores, read below each positive.

Components become whole numbers, floor(256 x), so scores are whole and the same on every machine. Anchors are dealt to
groups and rows to blocks of bounded size; a tile, one group against one block, is one task's group, and anchors and
rows are copied once for each tile of theirs. Two passes over the tiles:

1. positives: the best same-label rows of every anchor in the tile, then over all tiles;
2. negatives: an anchor's scores in the tile are sorted by score and id (lexsort), each positive's upper limit is found
   by binary search, and the first k entries of another label from there, down to the lower limit, are taken; the
   first k over all tiles stay.

What tiles return is at most k rows for each positive, so that no task holds all scores of an anchor.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part; an empty vector
has score 0 with others of its length; vectors of different lengths are not compared; equal anchor rows count once,
equal other rows are listed each; rows with the anchor's own id are no positives of it; components beyond 64 bits
become the largest or least long, and sums wrap as longs do; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import own, written

EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 10, 256
#: Limits of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors of a group and rows of a block, on average; anchors whose scores are held at once.
GROUP, BLOCK, STRIP = 16_384, 16_384, 64
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(df: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with whole components and a number of their own."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = own(df, "vec_id", "label", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.col("label").cast("long")
    return able.select(
        F.monotonically_increasing_id().alias("row"), "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as longs: by floating point where it is exact."""
    with np.errstate(over="ignore"):
        if not a.size or not b.size:
            return np.zeros((len(a), len(b)), np.int64)
        most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
        if most < 2.0**52:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return a @ b.T


def _same_length(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, pa.Table, int]]:
    """Anchors and rows of each length that both have."""
    import pyarrow.compute as pc

    n, m = pc.list_value_length(anchors["v"]), pc.list_value_length(rows["v"])
    for size in sorted(set(pc.unique(n).to_pylist()) & set(pc.unique(m).to_pylist())):
        yield anchors.filter(pc.equal(n, size)), rows.filter(pc.equal(m, size)), size


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of each anchor's label in one tile."""
    out = [np.zeros((0, 3), np.int64)]
    for a, r, size in _same_length(anchors, rows):
        one, other = a["label"].to_numpy(), r["label"].to_numpy()
        key, own_id, ids = a["row"].to_numpy(), a["vec_id"].to_numpy(), r["vec_id"].to_numpy()
        mine, theirs = _matrix(a["v"], size), _matrix(r["v"], size)
        for label in np.intersect1d(one, other).tolist():
            at, candidates = np.flatnonzero(one == label), np.flatnonzero(other == label)
            for first in range(0, len(at), STRIP):
                who = at[first : first + STRIP]
                got = scores(mine[who], theirs[candidates])
                for j, score in zip(who.tolist(), got, strict=True):
                    able = np.flatnonzero(ids[candidates] != own_id[j])
                    best = able[np.lexsort((ids[candidates[able]], -score[able]))[:k]]
                    out.append(np.column_stack([np.full(len(best), key[j]), ids[candidates[best]], score[best]]))
    found = np.concatenate(out)
    return pa.table({c: found[:, i] for i, c in enumerate(("row", "positive_id", "positive_score"))})


def _negatives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of other labels between the limits of each positive in one tile."""
    out = [np.zeros((0, 4), np.int64)]
    for a, r, size in _same_length(anchors, rows):
        label, other = a["label"].to_numpy(), r["label"].to_numpy()
        key, ids = a["row"].to_numpy(), r["vec_id"].to_numpy()
        mine, theirs, limits = _matrix(a["v"], size), _matrix(r["v"], size), a["limits"].to_pylist()
        for first in range(0, len(mine), STRIP):
            got = scores(mine[first : first + STRIP], theirs)
            for j, score in enumerate(got, first):
                order = np.lexsort((ids, -score))
                order = order[other[order] != label[j]]
                down = -score[order]  # rising
                for which, positive in enumerate(limits[j]):
                    upper, lower = positive * HIGH // 100, -(-positive * LOW // 100)
                    begin = int(np.searchsorted(down, -upper, "left"))
                    end = min(begin + k, int(np.searchsorted(down, -lower, "right")))
                    if begin < end:
                        some = order[begin:end]
                        out.append(np.column_stack([np.full(len(some), key[j]), np.full(len(some), which), ids[some], score[some]]))
    found = np.concatenate(out)
    return pa.table({c: found[:, i] for i, c in enumerate(("row", "which", "negative_id", "negative_score"))})


def _first(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts groups before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mine(df: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """RESULT for df(vec_id, embedding, label): for each anchor (id divisible by every) and each of its first positives,
    the first negatives between the limits."""
    rows = written(whole(df), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.min("row").alias("row"))
    anchors = written(anchors.select("row", "vec_id", "label", "v"), "anchors")
    n, many = rows.count(), anchors.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups, blocks = -(-max(many, 1) // GROUP), max(-(-n // BLOCK), min(2 * cores, n // 1024), 1)

    def tiles(side: DataFrame, own_part: str, parts: int, other_part: str, others: int) -> DataFrame:
        # numbers of rows, not their values, choose the part: equal rows are spread too
        return side.withColumn(own_part, F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn(
            other_part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    dealt = tiles(rows, "block", blocks, "part", groups)

    def over(some: DataFrame, work, k: int, schema: str) -> DataFrame:
        asked = tiles(some, "part", groups, "block", blocks)
        return asked.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInArrow(
            lambda a, r: work(a, r, k), schema)

    near = over(anchors, _positives, positives, "row long, positive_id long, positive_score long")
    near = written(_first(near, positives, ["row"], F.desc("positive_score"), F.asc("positive_id")), "positives")
    listed = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score", "positive_id"))).alias("p"))
    asked = anchors.join(listed, "row").select("row", "vec_id", "label", "v", F.col("p.positive_score").alias("limits"))
    far = over(asked, _negatives, negatives, "row long, which long, negative_id long, negative_score long")
    far = _first(far, negatives, ["row", "which"], F.desc("negative_score"), F.asc("negative_id"))
    pairs = near.select("row", (F.col("rank") - 1).alias("which"), "positive_id", "positive_score")
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return far.join(pairs, ["row", "which"]).join(named, "row").select(*[x.split()[0] for x in RESULT.split(", ")])
