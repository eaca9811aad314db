"""Ranked lexical search as a blocked sparse matrix product: items x terms times terms x documents.

1. The items' terms, in blocks of bounded size, are the rows of the left matrix, with how often each term counts.
2. One pass over the documents makes sparse rows: for each document its number of terms, and the terms that any item
   has with their occurrences. They are written once; document frequencies and lengths come from them.
3. In each task, documents are taken in blocks. The block is turned to term-major order with whole impacts (int64), and
   the product is formed row by row (Gustavson): an item's row is the sum of the rows of its terms, merged in an
   accumulator over the block's documents. The best k of each item are kept from block to block, and the best k over
   all tasks stay.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with only A-Z lower-cased. They are found
by hashes of 64 bits, and what is found is compared byte by byte. Two terms of the items that share a hash are an error.

Defined cases: a null or empty text has no term and is never found; an item without terms, or whose terms no document
has, gives no rows; rows with the same item_id are one item with the terms of all; a null item_id is an item too; a
document with a null doc_id counts and ranks after equal scores; repeated documents rank each; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import own, written
from .textkit import LOWER, chunks, hashes, pieces, sums

TOP = 10
#: Distinct pairs of item and term that one pass over the documents answers, on average.
ITEM_TERMS = 400_000
#: Postings and documents of a block.
POSTINGS, ROWS = 2_000_000, 16_384
#: Shares of a document's length in its impact, in hundredths, and the scale of the impacts.
FLAT, BY_LENGTH, SCALE = 100, 90, 1_000_000_000
#: Bytes between terms: ASCII without letters and digits.
GAP = np.zeros(256, bool)
GAP[:0x80] = True
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, begin, end) of every term of a chunk of texts, and the chunk in lower case."""
    data = LOWER[data]
    starts, ends, row = pieces(data, offs, GAP[data])
    return hashes(sums(data), starts, ends), row, starts, ends, data


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, word, times) of every item: times is how often its texts hold the term, term the hash of its bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in chunks(batch.column(1)):
                term, row, starts, ends, low = terms(data, offs)
                raw = low.tobytes()
                words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).take(pa.array(row + first)), pa.array(term.view(np.int64)), pa.array(words, pa.binary())],
                                      names=["item_id", "term", "word"])

    found = own(items, "item_id", "text").mapInArrow(read, "item_id long, term long, word binary")
    return found.groupBy("item_id", "term", "word").agg(F.count("*").alias("times"))


class Vocabulary:
    """Terms by hash, with their bytes."""

    def __init__(self, words: dict[int, bytes]) -> None:
        self.keys = np.array(sorted(words), np.uint64)
        ordered = [words[k] for k in self.keys.tolist()]
        self.size = np.array([len(w) for w in ordered], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(ordered), np.uint8)

    def find(self, term: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pieces are terms of the vocabulary, their places in it), by hash and then by every byte."""
        at = np.minimum(np.searchsorted(self.keys, term), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[at] == term) & (self.size[at] == ends - starts))
        at = at[hit]
        size = self.size[at]
        if not len(hit):
            return hit, at
        total = np.cumsum(size)
        step = np.arange(total[-1]) - np.repeat(total - size, size)
        same = data[np.repeat(starts[hit], size) + step] == self.data[np.repeat(self.begin[at], size) + step]
        good = np.logical_and.reduceat(same, total - size)
        return hit[good], at[good]


def sparse_rows(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts): each document's number of terms, and places in vocabulary with occurrences."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in chunks(batch.column(1), 1 << 20):
                term, row, starts, stops, low = terms(data, offs)
                rows, width = len(offs) - 1, len(vocabulary.keys)
                hit, at = vocabulary.find(term, starts, stops, low)
                key, count = np.unique(row[hit] * width + at, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(rows + 1) * width).astype(np.int32))
                yield pa.record_batch(
                    [batch.column(0).slice(first, rows), pa.array(np.bincount(row, minlength=rows)),
                     pa.ListArray.from_arrays(ends, pa.array((key % width).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "counts"])

    return own(docs, "doc_id", "text").mapInArrow(read, "doc_id long, n long, terms array<int>, counts array<int>")


class Product:
    """The items of a pass times one block of documents after another, and the best k documents of each so far."""

    def __init__(self, begin: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, k: int) -> None:
        self.begin, self.term, self.times, self.weight, self.k = begin, term, times, weight, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 for _ in begin[1:]]

    def block(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """One block: ids and m of its documents, and its postings (place of the document in ids, term, occurrences)."""
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
        impact = self.weight[term] * (SCALE * tf // (1000 * tf + 8 * m[doc]))
        row = np.searchsorted(term, np.arange(len(self.weight) + 1))
        total = np.zeros(len(ids), np.int64)
        for item in range(len(self.best)):
            total[:] = 0
            for at in range(self.begin[item], self.begin[item + 1]):
                a, b = row[self.term[at]], row[self.term[at] + 1]
                if a < b:  # a term has each document once, so that nothing is lost in the sum
                    total[doc[a:b]] += self.times[at] * impact[a:b]
            score, who = self.best[item]
            least = score[-1] if len(score) == self.k else 1
            new = np.flatnonzero(total >= least)
            if len(new) > 4 * self.k:  # all that may be among the best k, ties included
                new = new[total[new] >= np.partition(total[new], -self.k)[-self.k]]
            if len(new):
                score, who = np.concatenate([score, total[new]]), np.concatenate([who, ids[new]])
                keep = np.lexsort((who, -score))[: self.k]
                self.best[item] = score[keep], who[keep]


def _pass(docs: DataFrame, entries: list, k: int, once: bool) -> DataFrame:
    """search() for the items of one block of entries (item_id, term, word, times)."""
    spark = docs.sparkSession
    item_ids = list(dict.fromkeys(e[0] for e in entries))
    number = {x: i for i, x in enumerate(item_ids)}
    item = np.array([number[e[0]] for e in entries], np.int64)
    key = np.array([e[1] for e in entries], np.int64).view(np.uint64)
    words = dict(zip(key.tolist(), (bytes(e[2]) for e in entries), strict=True))
    if len(words) < len({bytes(e[2]) for e in entries}):
        raise ValueError("lexical_search: two terms share a hash")
    vocabulary = Vocabulary(words)
    place = np.searchsorted(vocabulary.keys, key)
    order = np.lexsort((place, item))
    times = np.ones(len(entries), np.int64) if once else np.array([e[3] for e in entries], np.int64)[order]
    begin = np.searchsorted(item[order], np.arange(len(item_ids) + 1))
    term = place[order]

    rows = written(sparse_rows(docs, vocabulary), "sparse-rows")
    df = np.zeros(len(vocabulary.keys), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # the items' terms only
        df[r[0]] = r[1]
    holding, length = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.array([math.floor(1000 * math.log((2 * holding + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    last = np.iinfo(np.int64).max

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = Product(begin, term, times, weight, k)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> None:
            if held:
                ids, n, size, t, tf = (np.concatenate(x) for x in zip(*held, strict=True))
                m = FLAT - BY_LENGTH + BY_LENGTH * n * holding // length
                product.block(ids, m, np.repeat(np.arange(len(ids)), size), t, tf)
                held.clear()

        rows_held = postings = 0
        for batch in batches:
            lists, counts = batch.column(2), batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            held.append((batch.column(0).fill_null(last).to_numpy(), batch.column(1).to_numpy(), size,
                         lists.flatten().to_numpy(), counts.flatten().to_numpy()))
            rows_held, postings = rows_held + len(size), postings + int(size.sum())
            if rows_held >= ROWS or postings >= POSTINGS:
                flush()
                rows_held = postings = 0
        flush()
        n = [len(score) for score, _ in product.best]
        if sum(n):
            found = pa.array(np.concatenate([who for _, who in product.best]))
            yield pa.record_batch(
                [pa.array(np.repeat(np.arange(len(n)), n)), found, pa.array(np.concatenate([score for score, _ in product.best]))],
                names=["item", "doc_id", "score"])

    best = rows.where("size(terms) > 0").mapInArrow(multiply, "item long, doc_id long, score long")
    best = best.withColumn("rank", F.row_number().over(
        Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(item_ids)), "item long, item_id long")
    return best.join(names, "item").select(
        "item_id", "rank", F.when(F.col("doc_id") < last, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, once: bool = True) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents(doc_id, text) of every item(item_id, text) with a score above
    0. once: each term of an item counts once, else as often as the item has it."""
    entries = written(item_terms(items), "item-terms")
    n = entries.count()
    passes = -(-n // ITEM_TERMS)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for p in range(passes):
        some = entries.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).orderBy("item_id", "term").collect()
        if some:
            out = out.union(_pass(docs, some, k, once)) if p or passes > 1 else _pass(docs, some, k, once)
    return out
