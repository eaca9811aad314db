"""Near duplicates of embeddings by NN-descent.

Exact copies are one vector with a count. Then, in rounds:

1. Start: the vectors are sorted by the signs of a few random projections and the value of one more, a few times with
   other projections; neighbours in such an order are compared inside windows of bounded size, however many vectors
   are alike. The best K of each vector outside its own component are its list (at first each vector is its own
   component). From the second round on, most starts take about REPS members of each component, other ones each time,
   so that large components don't fill the windows.
2. Descent: each vector brings the vectors on its list and those that list it (at most LIST of each, the nearest)
   together, with its neighbours of the first round; pairs of them that would improve a list are kept. Lists whose
   last entry is still at or above the threshold grow up to K_MOST.
3. Links found join components. As lists hold nothing of their own component, a tight group can't hide its links to
   others, however large it is. Rounds go on while they find links.
4. Audit: vectors are compared with every vector, a slice of the table at a time, until LINKED of them have links or
   all are compared: slices without links are no evidence. A link is found if its ends are in one component. Missed
   links join components too; while less than RECALL of the links, or of the vectors with all their links, was found,
   further rounds follow. After ROUNDS without that, every vector is compared: slow, but nothing is left out.
5. Each component is compared in blocks in double precision, which counts all links inside it exactly, drops what is
   below the threshold and gives the final components.

Where the audit compared all vectors (tables of one slice, or with few links) the result is exact; else links between
components may be missed, and the audit bounds how many. No pair is a row of a table except list entries, at most
K_MOST a vector, and one missed link for each pair of components and task.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components has no links; vectors of
different lengths aren't linked; rows that repeat a vec_id are one vector (the smallest, if they differ), each with
its row; a null vec_id has no links and isn't kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linking import components
from .tables import own, written

LIMIT = 0.95
K, K_MOST, LIST = 10, 40, 20
WINDOW, BITS, STARTS, REPS = 256, 10, 3, 8
LINKED, RECALL, ROUNDS, DESCENTS = 200, 0.97, 8, 2
#: A slice of the audit takes so many bytes of vectors.
SLICE = 1 << 21
BLOCK = 2048
#: Vectors of a block of a component; pairs of blocks are tasks of their own.
PART = 512
#: Lists are kept in single precision; what may be at the threshold is looked at again in double.
SLACK = 1e-5
_EDGE = "u long, v long, sim float"


def vectors(table: DataFrame) -> DataFrame:
    """(id, vec): the usable vectors, normalised, as single-precision numbers; one for each vec_id."""
    x = own(table, "vec_id", "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    x = x.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c))
    x = x.where(fine).groupBy("id").agg(F.min("vec").alias("vec"))
    return x.withColumn("size", size).where("size > 0 and size < double('infinity')").select("id", "vec")


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _start(vec: DataFrame, turn: int) -> DataFrame:
    """Edges between near neighbours of different components in one random order."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            parts = []
            for size, rows in frame.groupby(frame["vec"].str.len(), sort=False):
                x = _unit(rows["vec"])
                rng = np.random.default_rng([turn, int(size)])
                turned = x @ rng.standard_normal((x.shape[1], BITS + 1))
                bits = (turned[:, :BITS] > 0) @ (1 << np.arange(BITS))
                parts.append(rows.assign(size=int(size), bits=bits, along=turned[:, BITS]))
            if parts:
                yield pd.concat(parts)[["id", "root", "vec", "size", "bits", "along"]]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in batches:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            for at in range(0, max(len(frame) - WINDOW // 2, 1), WINDOW // 2):
                yield _best(frame.iloc[at : at + WINDOW])
            left = frame.iloc[-WINDOW // 2 :].reset_index(drop=True)

    order = vec.select("id", "root", "vec").mapInPandas(
        keyed, "id long, root long, vec array<double>, size int, bits long, along double")
    order = order.repartitionByRange("size", "bits", "along", "id").sortWithinPartitions("size", "bits", "along", "id")
    return order.mapInPandas(compared, _EDGE)


def _best(frame: pd.DataFrame) -> pd.DataFrame:
    """The K best edges of each row to other components inside a window."""
    parts = []
    for _, rows in frame.groupby("size", sort=False):
        if len(rows) < 2:
            continue
        x, ids, root = _unit(rows["vec"]), rows["id"].to_numpy(), rows["root"].to_numpy()
        sim = x @ x.T
        sim[root[:, None] == root] = -2
        k = min(K, len(ids) - 1)
        top = np.argpartition(-sim, k - 1, 1)[:, :k]
        edges = pd.DataFrame({"u": np.repeat(ids, k), "v": ids[top].ravel(),
                              "sim": np.take_along_axis(sim, top, 1).ravel().astype(np.float32)})
        parts.append(edges[edges["sim"] > -1.5])
    return pd.concat(parts) if parts else pd.DataFrame({"u": [], "v": [], "sim": []}).astype(
        {"u": "int64", "v": "int64", "sim": "float32"})


def _lists(edges: DataFrame) -> DataFrame:
    """The best K edges of each vector, and as many as K_MOST of those at the threshold."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("rank", rank)
    return one.where((F.col("rank") <= K) | ((F.col("rank") <= K_MOST) & (F.col("sim") >= LIMIT - SLACK))).select(
        "u", "v", "sim")


def _around(lists: DataFrame) -> DataFrame:
    """(w, id): the nearest LIST vectors on the list of w and the nearest LIST that list it."""
    near = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    ahead = lists.withColumn("r", near).where(F.col("r") <= LIST).select(F.col("u").alias("w"), F.col("v").alias("id"))
    back = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    behind = lists.withColumn("r", back).where(F.col("r") <= LIST).select(F.col("v").alias("w"), F.col("u").alias("id"))
    return ahead.union(behind)


def _descended(lists: DataFrame, vec: DataFrame, around: DataFrame | None) -> DataFrame:
    """lists improved once by neighbours of neighbours; around: further neighbours, of any component."""
    met = _around(lists) if around is None else _around(lists).union(around)
    last = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("n")).select(
        F.col("u").alias("id"), F.when(F.col("n") < K, -2.0).when(
            (F.col("least") >= LIMIT - SLACK) & (F.col("n") < K_MOST), LIMIT - SLACK).otherwise(
            F.col("least")).cast("float").alias("least"))
    data = vec.select("id", "root", F.col("vec").cast("array<float>").alias("vec")).join(last, "id", "left").select(
        "id", "root", "vec", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"))
    met = met.distinct().join(data, "id")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in batches:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            w = frame["w"].to_numpy()
            cut = int(np.searchsorted(w, w[-1])) if len(w) else 0  # the last group may go on
            yield _improved(frame.iloc[:cut])
            left = frame.iloc[cut:].reset_index(drop=True)
        if left is not None:
            yield _improved(left)

    pairs = met.repartition("w").sortWithinPartitions("w", "id").mapInPandas(joined, _EDGE)
    return _lists(lists.union(pairs))


def _improved(frame: pd.DataFrame) -> pd.DataFrame:
    """For each group w: edges between its members that are better than the last one on a member's list, and
    lead to another component."""
    us, vs, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    w, ids, root, least = (frame[c].to_numpy() for c in ("w", "id", "root", "least"))
    size = frame["vec"].str.len().to_numpy()
    bounds = [0, *(np.flatnonzero((w[1:] != w[:-1]) | (size[1:] != size[:-1])) + 1).tolist(), len(w)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a < 2:
            continue
        x = _unit(frame["vec"].iloc[a:b])
        sim = x @ x.T
        sim[root[a:b, None] == root[a:b]] = -3
        i, j = np.nonzero(sim > least[a:b, None])
        us.append(ids[a + i])
        vs.append(ids[a + j])
        sims.append(sim[i, j].astype(np.float32))
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "sim": np.concatenate(sims)})


def _compared(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (u, n, missed, null) that sum up to the links of each vector asked and how many lead to other components,
    and rows (u, 0, 0, v): one link, at least, for each pair of components that such links join."""
    rows = asked.select("id", "root", "vec").toPandas()
    groups = {int(n): (g["id"].to_numpy(), g["root"].to_numpy(), _unit(g["vec"]))
              for n, g in rows.groupby(rows["vec"].str.len())}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {n: np.zeros((2, len(g[0])), np.int64) for n, g in groups.items()}
        joined: set[tuple[int, int]] = set()
        for frame in batches:
            for n, part in frame.groupby(frame["vec"].str.len(), sort=False):
                if int(n) not in groups:
                    continue
                u, of, x = groups[int(n)]
                v, root, y = part["id"].to_numpy(), part["root"].to_numpy(), _unit(part["vec"])
                for at in range(0, len(v), BLOCK):
                    end = at + BLOCK
                    link = (y[at:end] @ x.T >= LIMIT) & (v[at:end, None] != u)
                    missed = link & (root[at:end, None] != of)
                    total[int(n)] += link.sum(0), missed.sum(0)
                    i, j = np.nonzero(missed)
                    if len(i):
                        pairs = np.column_stack([of[j], root[at:end][i]])
                        one, first = np.unique(pairs, axis=0, return_index=True)
                        new = [k for k, p in zip(first.tolist(), map(tuple, one.tolist()), strict=True) if p not in joined]
                        joined.update(map(tuple, one.tolist()))
                        yield pd.DataFrame({"u": u[j[new]], "n": 0, "missed": 0,
                                            "v": pd.array(v[at:end][i[new]], "Int64")})
        for n, sums in total.items():
            yield pd.DataFrame({"u": groups[n][0], "n": sums[0], "missed": sums[1],
                                "v": pd.array([None] * len(sums[0]), "Int64")}).query("n > 0")

    return placed.select("id", "root", "vec").mapInPandas(count, "u long, n long, missed long, v long")


def audited(placed: DataFrame, whole: bool = False) -> tuple[DataFrame | None, bool, bool]:
    """(links (a, b) between components, whether RECALL of links was found, whether all vectors were compared).
    Slices of the table are compared with all of it until LINKED vectors have links; whole: all slices are."""
    n, size = placed.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return None, True, True
    slices = -(-n * size * 8 // SLICE)
    edges, sums, k = None, np.zeros(4, np.int64), 0
    while k < slices and (whole or sums[0] < LINKED):
        asked = placed.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(slices)) == k)
        seen = written(_compared(placed, asked), "audit")
        each = seen.groupBy("u").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed"))
        row = each.agg(F.count("*"), F.count_if(F.col("missed") == 0), F.sum("n"), F.sum("n") - F.sum("missed")).first()
        sums += [int(x or 0) for x in row]
        if row[0] and row[1] < row[0]:
            found = seen.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b"))
            edges = found if edges is None else edges.union(found)
        k += 1
    linked, right, there, met = sums.tolist()
    return edges, right >= RECALL * linked and met >= RECALL * there, k >= slices


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each (root, i, j): how many links of each vector, and links that connect what is connected."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in frame.groupby(frame["vec"].str.len(), sort=False):
            first, second = rows[rows["side"] == 0], rows[rows["side"] == 1]
            same = frame["i"].iloc[0] == frame["j"].iloc[0]
            second = first if same else second
            if first.empty or second.empty:
                continue
            a, b = first["id"].to_numpy(), second["id"].to_numpy()
            link = _unit(first["vec"]) @ _unit(second["vec"]).T >= LIMIT
            if same:
                np.fill_diagonal(link, False)
            out.append(pd.DataFrame({"u": a, "v": a, "n": link @ second["copies"].to_numpy()}))
            if not same:
                out.append(pd.DataFrame({"u": b, "v": b, "n": first["copies"].to_numpy() @ link}))
            out.append(_forest(a, b, link))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")

    key, parts = None, []
    for frame in batches:
        for now, rows in frame.groupby(["root", "i", "j"], sort=False):
            if now != key and parts:
                yield solve(pd.concat(parts))
                parts = []
            key = now
            parts.append(rows)
    if parts:
        yield solve(pd.concat(parts))


def _forest(a: np.ndarray, b: np.ndarray, link: np.ndarray) -> pd.DataFrame:
    """Links of a bipartite block that span its components: breadth-first from row to column and back."""
    rows_left, cols_left = np.ones(len(a), bool), np.ones(len(b), bool)
    us, vs = [], []
    for start in range(len(a)):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        todo = [start]
        while todo:
            r = todo.pop()
            cols = np.flatnonzero(link[r] & cols_left)
            cols_left[cols] = False
            us.append(np.full(len(cols), a[r]))
            vs.append(b[cols])
            for c in cols:
                new = np.flatnonzero(link[:, c] & rows_left)
                rows_left[new] = False
                us.append(a[new])
                vs.append(np.full(len(new), b[c]))
                todo += new.tolist()
    if not us:
        return pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
    out = pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "n": 0})
    return out[out["u"] != out["v"]]


def _placed(vec: DataFrame, edges: DataFrame) -> DataFrame:
    """vec with the component of each vector (root) and its number of vectors (members)."""
    member = components(edges)
    size = member.groupBy("root").agg(F.count("*").alias("members"))
    member = member.join(size, "root").withColumnRenamed("node", "id")
    return written(vec.join(member, "id", "left").select(
        *vec.columns, F.coalesce("root", "id").alias("root"), F.coalesce("members", F.lit(1)).alias("members")), "placed")


def _links(placed: DataFrame, turn: int, around: DataFrame | None) -> DataFrame:
    """Lists of near vectors of other components, after starts and descents."""
    lists = None
    for k in range(turn * STARTS, (turn + 1) * STARTS):
        few = F.pmod(F.xxhash64("id", F.lit(k)), F.col("members")) < REPS
        start = _start(placed.where(few) if k % STARTS else placed, k)
        lists = start if lists is None else lists.union(start)
    lists = written(_lists(lists), "lists")
    for _ in range(DESCENTS):
        lists = written(_descended(lists, placed, around), "lists")
    return lists


def linked(vec: DataFrame) -> DataFrame:
    """vec with root and members, where the links between roots are at most those the audit allows."""
    placed = vec.withColumn("root", F.col("id")).withColumn("members", F.lit(1).cast("long"))
    edges = around = None
    for turn in range(ROUNDS):
        lists = _links(placed, turn, around)
        new = lists.where(F.col("sim") >= LIMIT - SLACK).select(F.col("u").alias("a"), F.col("v").alias("b"))
        more = not new.isEmpty()
        if more or edges is None:
            edges = new if edges is None else edges.union(new)
            placed = _placed(vec, edges)
        if around is None:
            around = written(_around(lists), "around")
        elif not more:
            missed, met, every = audited(placed)
            if missed is not None:
                edges = edges.union(missed)
                placed = _placed(vec, edges)
            if met or every:
                return placed
    missed, _, _ = audited(placed, whole=True)
    return placed if missed is None else _placed(vec, edges.union(missed))


def near_duplicates(table: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table."""
    each = written(vectors(table), "each")
    once = written(each.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    copied = each.join(once.where("copies > 1").withColumnRenamed("id", "first"), "vec").select("id", "first")
    vec = once.select("id", "vec", "copies")
    placed = linked(vec).where("members > 1")
    size = F.ceil(F.col("members") / PART).cast("int")
    placed = placed.withColumn("blocks", size).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"),
        F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    placed = placed.select("root", "id", "vec", "copies", F.explode(pairs).alias("p")).select(
        "root", "id", "vec", "copies", "p.*")
    placed = placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "id")
    exact = written(placed.mapInPandas(_exact, "u long, v long, n long"), "exact")
    count = exact.where("u = v").groupBy("u").agg(F.sum("n").alias("n"))
    final = components(exact.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")))
    done = vec.select("id", "copies").join(count, F.col("id") == F.col("u"), "left").where("copies > 1 or n is not null")
    done = done.join(final, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("u"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    out = own(table, "vec_id").join(copied, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.coalesce("first", "vec_id").alias("first"))
    out = out.join(done, F.col("first") == F.col("u"), "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"),
                      F.coalesce(root == F.col("vec_id"), F.lit(False)).alias("kept"))
