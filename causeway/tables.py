"""Reading driver tables and writing intermediate ones to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def once(c: Column) -> Column:
    """c as the only row of an array that is exploded: filters and columns that name it read its value. A plain column is
    put into each of them, and all of it is computed again for each."""
    return F.explode(F.array(c))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what the context was given. A temporary one only where
    neither is set and all runs in one process (tests); elsewhere that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="causeway-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage of iterative plans and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
