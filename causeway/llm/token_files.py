"""Token ids as Parquet files: one list column of ids beside the metadata.

Layout of a folder: `tokens` holds doc_id, part, before (ids of earlier documents of the same part), n_tokens, source,
lang and token_ids list<int>, range-partitioned and sorted by doc_id, so that the footers' and the page indexes'
ranges of doc_id let a reader skip to a few pages; `parts` holds the number of ids of each part. Ids are
dictionary-encoded (a vocabulary fits one dictionary page), the rising integers are delta-encoded, row groups and
pages have the sizes given below. Metadata can be read without ids, and ids without metadata.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; repeated rows are written each,
in any order among themselves; extra columns are ignored; an empty table gives an empty folder that can be read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import own, shared_dir
from .tokens import encoder, tokenizer_path

TOKENIZER, END = "byte_bpe_50k.json", 2
#: Row groups of about 32 MB, pages of at most 256 kB or 2,000 rows, version 2 pages (delta encoding of integers).
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
}
SCHEMA = "doc_id long, part int, before long, n_tokens long, source string, lang string, token_ids array<int>"


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, own_encoder = TaskContext.get().partitionId(), 0, encoder(path, True)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                ids, size = own_encoder.encode(batch.column(3))
                ids, n = np.insert(ids.astype(np.int32), np.cumsum(size), END), size + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.record_batch(
                    [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends[:-1]),
                     pa.array(n), batch.column(1), batch.column(2), lists],
                    names=[x.split()[0] for x in SCHEMA.split(", ")])
                before += int(ends[-1])

    return own(docs, "doc_id", "source", "lang", "text").mapInArrow(read, SCHEMA)


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the ids of docs under folder, in ascending order of doc_id over all parts."""
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    _encoded(ordered, path or tokenizer_path(TOKENIZER)).write.options(**FORMAT).parquet(f"{folder}/tokens")
    rows = docs.sparkSession.read.schema(SCHEMA).parquet(f"{folder}/tokens")
    rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).coalesce(1).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The rows of a folder with the named columns of SCHEMA (all where none is named) and start, the number of ids
    before the document. Only named columns are read; filters on doc_id reach row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/tokens")
    parts = spark.read.schema("part int, tokens long").parquet(f"{folder}/parts")
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    base = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(run), F.lit(0)).alias("base"))
    named = list(columns) or [x.split()[0] for x in SCHEMA.split(", ")]
    start = (F.col("base") + F.col("before")).alias("start")
    return rows.join(base, F.col("part") == F.col("p")).select(*named, start)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            data = lists.values.to_numpy().astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())],
                                  names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(
        sum_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest of docs from files written to the shared folder and read back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return digest(read(docs.sparkSession, folder, "doc_id", "n_tokens", "token_ids"))
