"""Tables that many queries of one run share: judged signals, their pairs, links and clusters, each computed and written once
for the same input files in the same application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import written

_KEPT: dict[tuple, DataFrame] = {}


def input_mark(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    """What changes when a file of a table does: how many files, their bytes and the newest time, asked of the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return len(found), sum(x.getLen() for x in found), max((x.getModificationTime() for x in found), default=0)


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name over the events of sf_dir, built at first use."""
    key = spark.sparkContext.applicationId, sf_dir, name, input_mark(spark, sf_dir, "events")
    if key not in _KEPT:
        _KEPT[key] = written(build(), name)
    return _KEPT[key]
