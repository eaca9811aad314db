"""Quality classifier by compression: how much better a text packs with a dictionary of good text than of bad text.

Two zstandard dictionaries are built from labelled texts. A text's evidence is the difference of its two compressed
sizes, normalised by its length and by what is left of it; a logistic curve over that difference, whose slope may change
with the length, fitted on labelled texts that no dictionary saw, turns it into a score from 0 to 1. Labels, language,
source and doc_id are never inputs of a score. Fitting uses at most SAMPLE labelled rows (smallest hash of doc_id);
DICTIONARY_TEXT bytes of each class's texts come to the driver, which builds the dictionaries, and no other text: the
curve's evidence is taken where texts are read. Every document is scored whole, in one pass without a shuffle.

Defined cases: a null or empty text gets the score of no evidence; a null doc_id is in no fold (held_out null-safe
false) and scored; repeated rows are scored alike; extra columns are ignored; without labels of both kinds every score
is the share of good labels (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import own, written

SAMPLE, DICTIONARY_TEXT, DICTIONARY_SIZE, LEVEL, LEAST = 12_000, 8 << 20, 1 << 17, 12, 8
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out() -> object:
    """Whether crc32 of the id as text leaves remainder 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Two dictionaries (good, bad) and the curve's weights over _evidence, after scaling."""

    dictionaries: tuple[bytes, bytes] | None
    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """For each text: difference of compressed sizes, bad less good, over the root of its length; log of its length."""
        if not hasattr(self, "_packers"):
            self._packers = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False,
                             write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d)) for d in self.dictionaries]
        good, bad = self._packers
        sizes = np.array([(len(bad.compress(t)) - len(good.compress(t)), len(t)) for t in texts], float).reshape(-1, 2)
        n = sizes[:, 1] + 16
        return np.column_stack([sizes[:, 0] / np.sqrt(n), np.log(n)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), self.weights[0])
        x = (self.evidence(texts) - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(_terms(x) @ self.weights, -40, 40)))


def _terms(x: np.ndarray) -> np.ndarray:
    """Constant and difference, the latter with a slope that changes with the length."""
    a, c = x.T
    return np.column_stack([np.ones(len(x)), a, a * c])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of texts; their joined end where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, texts, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_SIZE:]


def calibrated(dictionaries: tuple[bytes, bytes], x: np.ndarray, good: np.ndarray) -> Model:
    """The model with a curve fitted on the evidence x of labelled texts that no dictionary saw."""
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Model(dictionaries, _logistic(_terms((x - middle) / spread), good.astype(float)), middle, spread)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows outside the held-out fold: half of each class by a hash for the
    dictionaries, the rest for the curve. Of repeated ids the smallest label and the smallest text count."""
    known = own(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = own(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "good").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = written(rows.withColumn("turn", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0), "labelled")
    share = rows.groupBy("good").agg(F.count("*").alias("n"), F.count_if("turn").alias("seen")).toPandas()
    if len(share) < 2 or share["seen"].min() < LEAST // 2 or (share["n"] - share["seen"]).min() < LEAST // 2:
        n = share["n"].sum()
        return Model(None, np.array([share.loc[share["good"], "n"].sum() / n if n else 0.5]), np.zeros(2), np.ones(2))
    # no text may fill the dictionary alone; lengths of at most `sample` rows are summed up in order
    size = rows.where("turn").select("doc_id", "good", F.octet_length("text").alias("size")).where(F.col("size") <= DICTIONARY_TEXT // 8)
    upto = F.sum("size").over(Window.partitionBy("good").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id"))
    taken = size.withColumn("upto", upto).where(F.col("upto") <= DICTIONARY_TEXT).select("doc_id")
    texts = rows.join(F.broadcast(taken), "doc_id", "left_semi").select("doc_id", "good", "text").toPandas().sort_values("doc_id")
    both = tuple(dictionary([t.encode() for t in texts.loc[texts["good"] == kind, "text"] if t]) for kind in (True, False))
    if not all(both):
        return Model(None, np.array([share.loc[share["good"], "n"].sum() / share["n"].sum()]), np.zeros(2), np.ones(2))
    blank = docs.sparkSession.sparkContext.broadcast(Model(both, np.zeros(3), np.zeros(2), np.ones(2)))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = blank.value.evidence(batch.column(2).cast(pa.binary()).to_pylist())
            yield pa.record_batch([*batch.columns[:2], pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "good", "a", "c"])

    rest = rows.where("not turn").select("doc_id", "good", "text").mapInArrow(seen, "doc_id long, good boolean, a double, c double")
    x = rest.toPandas().sort_values("doc_id")  # a few numbers for each of at most `sample` rows
    return calibrated(both, x[["a", "c"]].to_numpy(), x["good"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCHEMA for every row of docs."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_SIZE

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).fill_null(b"").to_pylist()
            s = spread.value.scores(texts)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                  names=[x.split()[0] for x in SCHEMA.split(", ")])

    return own(docs, "doc_id", "text").select("doc_id", held_out(), "text").mapInArrow(judge, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out and score every document."""
    return score(docs, fit(docs, labels))
