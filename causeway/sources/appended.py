"""A folder of growing text files as a stream that can be stopped and resumed without loss or repeat.

The offset of the stream is, for each file, how many bytes of whole lines have been read; Spark keeps it in the query's
checkpoint. A line without its end waits until it has one. Files are read in ranges of RANGE bytes, so one large file is
many tasks. Offsets name every file of the folder: a recorder should roll its files by day or size, not by event.

Files are found and read through pyarrow's file systems, local or remote (s3, gs, hdfs), not through the driver. A file
that has become shorter than what was read of it is an error.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import adapters
from .files import RECORD

NAME, SCHEMA = "appended_lines", "value string, file string, place long"
RANGE, BLOCK, ROWS = 16 << 20, 1 << 20, 10_000


def _file_system(path: str):
    from pyarrow import fs

    if re.match(r"file:/(?!/)", path):
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _whole(system, path: str, size: int, known: int) -> int:
    """Where the last whole line of a file ends; known: that much is whole lines."""
    if size == known:
        return known
    with system.open_input_file(path) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


def sizes(folder: str, known: dict[str, int]) -> dict[str, int]:
    """Bytes of whole lines of each file of the folder, hidden ones left out."""
    from pyarrow import fs

    system, path = _file_system(folder)
    out = {}
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            old = known.get(info.base_name, 0)
            if info.size < old:
                raise ValueError(f"{info.base_name} has become shorter than what was read of it")
            out[info.base_name] = _whole(system, info.path, info.size, old)
    return {**known, **out}


@dataclass
class Lines(InputPartition):
    """Lines of a file that begin in [begin, end); start: where reading began, a line's beginning."""

    file: str
    start: int
    begin: int
    end: int


def split(old: dict[str, int], new: dict[str, int]) -> list[Lines]:
    return [Lines(name, old.get(name, 0), at, min(at + RANGE, size)) for name, size in sorted(new.items())
            for at in range(old.get(name, 0), size, RANGE)]


def lines(folder: str, part: Lines) -> Iterator:
    """Arrow batches of SCHEMA; place is where a line begins in its file."""
    import pyarrow as pa

    system, path = _file_system(folder)
    with system.open_input_file(posixpath.join(path, part.file)) as f:
        at = part.begin
        if at > part.start:  # a line that began before belongs to the range before
            at -= 1
            f.seek(at)
            while True:
                block = f.read(BLOCK)
                k = block.find(b"\n")
                if k >= 0 or not block:
                    at += k + 1 if k >= 0 else 0
                    break
                at += len(block)
        f.seek(at)
        values, places, rest, begin = [], [], b"", at

        def batch():
            return pa.record_batch([pa.array(values, pa.string()), pa.array([part.file] * len(values), pa.string()), pa.array(places, pa.int64())],
                                   names=["value", "file", "place"])

        while begin < part.end and (block := f.read(BLOCK)):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if begin >= part.end:
                    break
                values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                places.append(begin)
                begin += len(line) + 1
                if len(values) == ROWS:
                    yield batch()
                    values, places = [], []
        if values:
            yield batch()


class _Batch(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[Lines]:
        return split({}, sizes(self.folder, {}))

    def read(self, partition: Lines) -> Iterator:
        return lines(self.folder, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.known = folder, {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        self.known = sizes(self.folder, self.known)
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return split(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: Lines) -> Iterator:
        return lines(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """spark.read or spark.readStream .format(NAME).load(folder)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def recorded(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Events (stream, id, at, outcome, signal, file, place) of a folder of recordings in JSON lines, as a stream that
    resumes where its checkpoint stands, or as a batch; torn or foreign lines are skipped."""
    spark.dataSource.register(AppendedLines)
    rows = (spark.readStream if stream else spark.read).format(NAME).load(folder)
    rows = rows.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"), "file", "place")
    return rows.where("r.kind = 'event' and r.stream is not null").select(
        "r.stream", "r.id", "r.at", "r.outcome", "r.signal", "file", "place")


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of events without those that a reconnecting recorder wrote again: the first of each stream and id, as long
    as repeats come within delay of each other's time; events without an id are kept all."""
    marked = events.withColumn("event_time", F.to_timestamp("at")).withColumn(
        "mark", F.coalesce("id", F.concat_ws(":", "file", F.col("place").cast("string"))))
    return marked.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["stream", "mark"]).drop("mark")


#: Which adapter reads the payloads of a stream: by the last part of its name.
ROUTES = {"logs": adapters.log_lines, "cloudwatch": adapters.alarms, "grafana": adapters.dashboard_alerts}


def dispatched(events: DataFrame) -> DataFrame:
    """events(stream, raw, received_us) to signals, each stream by its own adapter. Streams of other names give nothing:
    see unrouted()."""
    last = F.element_at(F.split("stream", "-"), -1)
    return adapters.union(*[read(events.where(last == name).select("raw", "received_us")) for name, read in ROUTES.items()])


def unrouted(events: DataFrame) -> DataFrame:
    """Events of streams that no adapter reads."""
    return events.where(~F.element_at(F.split("stream", "-"), -1).isin(list(ROUTES)))


def resume_points(events: DataFrame) -> DataFrame:
    """(stream, events, signals, skipped, errors, last_id): the counters of each stream and the last id it can be asked
    to go on from, by place in the recording."""
    many = lambda name: F.count_if(F.col("outcome") == name)
    last = F.max(F.when(F.col("id").isNotNull(), F.struct("file", "place", "id")))["id"]
    return events.groupBy("stream").agg(F.count("*").alias("events"), many("signal").alias("signals"), many("skipped").alias(
        "skipped"), many("error").alias("errors"), last.alias("last_id"))


def replay(events: DataFrame, start_us: int, speed: float = 1.0, longest_s: float = 60.0) -> DataFrame:
    """events(stream, ts, ...) in their order with wait_s, how long a replay pauses before each: what lies before start_us
    comes at once, then gaps are as recorded, at most longest_s, divided by speed. The gap before an event is that to
    the event before it in its stream."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("stream").orderBy("ts", "file", "place"))
    gap = F.least(F.greatest((F.col("ts") - before) / 1e6, F.lit(0.0)), F.lit(longest_s)) / speed
    return events.withColumn("wait_s", F.when((F.col("ts") < start_us) | before.isNull() | (before < start_us), 0.0).otherwise(F.round(gap, 6)))
