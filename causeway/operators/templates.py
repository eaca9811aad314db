"""Log templates mined by a fixed-depth prefix tree: length of a line, its first word, then leaves of alike templates.

A line falls into the leaf of its number of words and its first word. At most CHILDREN - 1 first words of a length have
leaves of their own, the first to occur; all others, and words with digits, share the leaf of MASK. Inside a leaf a line
joins the template with which it shares most words (then the one with most masks, then the oldest), if these are at
least SIMILAR of its words; words that differ become MASK. Else it is a new template, named after the line.

Batch form (templates): equal lines count together and are placed once, at their first occurrence. Leaves are sorted by
time inside partitions and folded as streams, so a leaf's templates are held, its lines aren't. A leaf with more than
CHUNK distinct lines is dealt to chunks by hash; each chunk is mined alone and what it finds is mined again, in fewer
chunks (a FEWER-th at most), until one is left. A leaf of one chunk is done and not mined again: its templates would stay
as they are. Lines are moved as strings, once to count equal ones and once a round. Streaming form (mined): the leaves
are keyed state.

Defined cases: null and blank messages are the empty template; order is by ts, then id, nulls first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..tables import written

MASK, SIMILAR, CHILDREN, CHUNK, FEWER, FEW = "<*>", 0.4, 100, 20_000, 32, 64


class Leaf:
    """The templates of one leaf in order of age.

    A line that shares `least` of its words with a template shares one at least of any length - least + 1 of them, so only
    the templates that hold one of the line's rarest words in its place are compared. What a template has masked since
    stays listed: comparing tells. Up to FEW templates are all compared.
    """

    def __init__(self, length: int) -> None:
        self.length, self.n = length, 0
        self.least = next(k for k in range(length + 1) if k >= SIMILAR * length)
        self.number: dict[str, int] = {MASK: -1}
        self.words = [""]
        self.table = np.zeros((8, length), np.int32)
        self.holders: list[dict[int, list[int]]] = []
        self.names: list = []
        self.counts: list[int] = []

    def _row(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            at = self.number.get(w)
            if at is None:
                at = self.number[w] = len(self.words)
                self.words.append(w)
            out.append(at)
        return out

    def _append(self, row: list[int], name, count: int) -> None:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = row
        if self.holders:
            self._list(self.n, row)
        elif self.n == FEW:
            self.holders = [{} for _ in row]
            for k in range(FEW + 1):
                self._list(k, self.table[k].tolist())
        self.names.append(name)
        self.counts.append(count)
        self.n += 1

    def _list(self, k: int, row: list[int]) -> None:
        for held, w in zip(self.holders, row, strict=True):
            if w >= 0:
                held.setdefault(w, []).append(k)

    def _best(self, row: list[int]) -> int | None:
        """The template that a line joins."""
        if not self.length:
            return 0 if self.n else None
        if self.holders:
            lists = sorted((held.get(w, ()) for held, w in zip(self.holders, row, strict=True)), key=len)
            near = np.fromiter(set().union(*lists[: self.length - self.least + 1]), np.int64)
        else:
            near = np.arange(self.n)
        if not len(near):
            return None
        now = self.table[near] if self.holders else self.table[: self.n]
        masks = now < 0
        alike = ((now == np.array(row, np.int32)) & ~masks).sum(1)
        best = np.lexsort((near, -masks.sum(1), -alike))[0]
        return int(near[best]) if alike[best] >= self.least else None

    def add(self, words: list[str], name, count: int = 1) -> int:
        """Place a line, named so if it is a template of its own; the place of its template."""
        row = self._row(words)
        best = self._best(row)
        if best is None:
            self._append(row, name, count)
            return self.n - 1
        now = self.table[best]
        now[now != np.array(row, np.int32)] = -1
        self.counts[best] += count
        return best

    def restore(self, words: list[str], name, count: int) -> None:
        """A template that was found before."""
        self._append(self._row(words), name, count)

    def template(self, k: int) -> list[str]:
        return [MASK if x < 0 else self.words[x] for x in self.table[k].tolist()]


def with_words(lines: DataFrame) -> DataFrame:
    """lines with words, the runs of characters between white space."""
    return lines.withColumn("words", F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1))


def _head():
    first = F.coalesce(F.get("words", F.lit(0)), F.lit(""))
    return F.when(first.rlike("[0-9]"), MASK).otherwise(first)


def _words():
    """The words of a line."""
    return F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " "))


def leaves(distinct: DataFrame, children: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """distinct(length, line, ts, id): the first words with leaves of their own, (length, head), and (length, leaf, parts)
    of the leaves with more than `chunk` lines."""
    heads = distinct.select("length", F.substring_index("line", " ", 1).alias("head"), F.struct("ts", "id").alias("at"))
    heads = heads.withColumn("head", F.when(F.col("head").rlike("[0-9]"), MASK).otherwise(F.col("head")))
    heads = written(heads.groupBy("length", "head").agg(F.min("at").alias("at"), F.count("*").alias("size")), "first-words")
    rank = F.row_number().over(Window.partitionBy("length").orderBy("at", "head"))
    named = heads.where(F.col("head") != MASK).select("length", "head", rank.alias("r")).where(F.col("r") < children)
    own = written(named.select("length", "head"), "leaf-words")
    leaf = heads.join(own.withColumn("leaf", F.col("head")), ["length", "head"], "left").groupBy(
        "length", F.coalesce("leaf", F.lit(MASK)).alias("leaf"))
    return own, _parts(leaf.agg(F.sum("size").alias("size")), F.ceil(F.col("size") / chunk))


def _parts(sizes: DataFrame, parts: Column) -> DataFrame:
    """(length, leaf, parts) of the leaves in several parts, of which there are no more than chunks."""
    return written(sizes.withColumn("parts", parts.cast("int")).where("parts > 1").select("length", "leaf", "parts"), "leaf-parts")


def _mine(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(length, leaf, line, ts, id, n, d), n lines of d kinds, mined in parts(length, leaf, parts), other leaves in one:
    a row for each template that is found, named after its first line, with parts, and one for each row of the input, its
    ts and id and those of its template as of_ts and of_id."""
    key = ["length", "leaf", "chunk"]
    schema = "length int, leaf string, parts int, line string, ts long, id long, n long, d long, of_ts long, of_id long, found boolean"
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 6, pa.bool_()]

    def table(*columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                               names=[x.split()[0] for x in schema.split(", ")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf, parts, different = None, None, 1, []

        def finished() -> Iterator[pa.RecordBatch]:
            for k in range(0, leaf.n, CHUNK):
                at = range(k, min(k + CHUNK, leaf.n))
                n, none = len(at), [None] * len(at)
                yield table([now[0]] * n, [now[1]] * n, [parts] * n, [" ".join(leaf.template(x)) for x in at],
                            *zip(*leaf.names[k : k + n], strict=True), leaf.counts[k : k + n], different[k : k + n], none, none, [True] * n)

        for batch in batches:
            length, name, chunk, several, line, ts, ids, n, d = (c.to_pylist() for c in batch.columns)
            of = []
            for k, place in enumerate(zip(length, name, chunk, strict=True)):
                if place != now:
                    if leaf is not None:
                        yield from finished()
                    now, leaf, parts, different = place, Leaf(length[k]), several[k], []
                at = leaf.add(line[k].split(" ") if line[k] else [], (ts[k], ids[k]), n[k])
                if at == len(different):
                    different.append(0)
                different[at] += d[k]
                of.append(leaf.names[at])
            if of:
                none = [None] * len(of)
                yield table(none, none, none, none, ts, ids, none, none, *zip(*of, strict=True), [False] * len(of))
        if leaf is not None:
            yield from finished()

    held = rows.join(F.broadcast(parts), ["length", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.withColumn("chunk", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(_words()), F.col("parts"))).otherwise(0).cast("int"))
    dealt = held.select(*key, "parts", "line", "ts", "id", "n", "d").repartition(*key).sortWithinPartitions(*key, "ts", "id")
    return dealt.mapInArrow(fold, schema)


def templates(lines: DataFrame, children: int = CHILDREN, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(found, placed) of lines(ts long, id long, message string): found(template_id, template, n_words, n_lines,
    n_distinct) and placed(words, template_id), a row for each distinct line. Names tell a template's first line."""
    line = with_words(lines).select(F.array_join("words", " ").alias("line"), F.struct("ts", "id").alias("at"))
    counted = line.groupBy("line").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    # text is the bulk of these tables
    small = {"compression": "zstd"}
    distinct = written(counted.select(F.size(_words()).alias("length"), "line", "at.*", "n"), "distinct-lines", **small)
    own, parts = leaves(distinct, children, chunk)
    head = F.substring_index("line", " ", 1).alias("head")
    rows = distinct.select("length", head, "line", "ts", "id", "n", F.lit(1).cast("long").alias("d")).join(
        own.withColumn("leaf", F.col("head")), ["length", "head"], "left").drop("head").withColumn("leaf", F.coalesce("leaf", F.lit(MASK)))
    found, maps = [], None
    while True:
        got = written(_mine(rows, parts), "log-templates", **small)
        step = got.where("not found").select(F.struct("ts", "id").alias("at"), F.struct(
            F.col("of_ts").alias("ts"), F.col("of_id").alias("id")).alias("of"))
        if maps is None:
            maps = step
        else:  # where what was named so went in this round
            maps = maps.join(step.select(F.col("at").alias("was"), F.col("of").alias("to")), F.col("of").eqNullSafe(
                F.col("was")), "left").select("at", F.when(F.col("was").isNotNull(), F.col("to")).otherwise(F.col("of")).alias("of"))
        found.append(got.where("found and parts = 1"))
        rows = got.where("found and parts > 1").select("length", "leaf", "line", "ts", "id", "n", "d", "parts")
        if parts.isEmpty():
            break
        sizes = rows.groupBy("length", "leaf").agg(F.count("*").alias("size"), F.first("parts").alias("were"))
        # fewer chunks each time, however little was found to be alike
        parts = _parts(sizes, F.least(F.ceil(F.col("size") / chunk), F.floor(F.col("were") / FEWER)))
        rows = rows.drop("parts")
    ident = lambda ts, id_: F.concat(F.lit("T"), F.coalesce(F.col(ts).cast("string"), F.lit("")), F.lit("-"), F.coalesce(
        F.col(id_).cast("string"), F.lit(""))).alias("template_id")
    placed = distinct.join(maps.withColumnRenamed("at", "was"), F.struct("ts", "id").eqNullSafe(F.col("was"))).select(
        _words().alias("words"), ident("of.ts", "of.id"))
    return reduce(DataFrame.union, found).select(ident("ts", "id"), F.col("line").alias("template"), F.col("length").alias(
        "n_words"), F.col("n").alias("n_lines"), F.col("d").alias("n_distinct")), placed


def with_template(lines: DataFrame, children: int = CHILDREN, chunk: int = CHUNK) -> DataFrame:
    """lines with template_id and template."""
    found, placed = templates(lines, children, chunk)
    names = placed.join(found.select("template_id", "template"), "template_id")
    return with_words(lines.drop("template", "template_id")).join(names, "words").drop("words")


class _Heads(StatefulProcessor):
    """Key length: which first words have leaves of their own."""

    def __init__(self, children: int) -> None:
        self.children = children

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getMapState("own", "head string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = {k[0] for k in self.own.keys()}
        table = pd.concat(list(rows)).sort_values(["ts", "id"])
        out = []
        for head, ts in table[["head", "ts"]].itertuples(index=False, name=None):
            if head != MASK and head not in own and len(own) < self.children - 1:
                own.add(head)
                self.own.updateValue((head,), (int(ts),))
            out.append(head if head in own else MASK)
        yield pd.DataFrame({"ts": table["ts"], "id": table["id"], "message": table["message"], "length": int(key[0]), "leaf": out})

    def close(self) -> None:
        pass


class _Leaves(StatefulProcessor):
    """Key (length, leaf): its templates with the line that named each and how many lines it has had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("templates", "age int", "words string, ts long, id long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        leaf = Leaf(int(key[0]))
        for _, (words, ts, ident, n) in sorted(((k[0], v) for k, v in self.held.iterator()), key=lambda x: x[0]):
            leaf.restore(words.split(" "), (ts, ident), n)
        table = pd.concat(list(rows)).sort_values(["ts", "id"])
        out, touched = [], set()
        for ts, ident, message in table[["ts", "id", "message"]].itertuples(index=False, name=None):
            at = leaf.add(message.split(" "), (int(ts), int(ident)))
            touched.add(at)
            out.append((int(ts), int(ident), "T{}-{}".format(*leaf.names[at]), " ".join(leaf.template(at)), leaf.counts[at]))
        for at in touched:
            self.held.updateValue((at,), (" ".join(leaf.template(at)), *leaf.names[at], leaf.counts[at]))
        yield pd.DataFrame(out, columns=["ts", "id", "template_id", "template", "n_lines"])

    def close(self) -> None:
        pass


def mined(lines: DataFrame, children: int = CHILDREN) -> DataFrame:
    """Streaming form of lines(ts, id, message): each line with its template_id, the template as it then is and how many
    lines it has had. Every line is placed as it comes, repeats too. Lines of a batch come in order of ts and id; later
    batches don't change earlier rows. Blank lines and lines without ts or id are left out. Needs the RocksDB state store."""
    rows = with_words(lines).where("size(words) > 0 and ts is not null and id is not null")
    rows = rows.select(F.size("words").alias("length"), _head().alias("head"), "ts", "id", F.array_join("words", " ").alias("message"))
    dealt = rows.groupBy("length").transformWithStateInPandas(
        statefulProcessor=_Heads(children), outputStructType="ts long, id long, message string, length int, leaf string",
        outputMode="Append", timeMode="None")
    return dealt.groupBy("length", "leaf").transformWithStateInPandas(
        statefulProcessor=_Leaves(), outputStructType="ts long, id long, template_id string, template string, n_lines long",
        outputMode="Append", timeMode="None")
