"""Intermediate tables in the shared folder, kept apart by run, and what is known of their size."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from firstmonth.sources.shared import shared_folder

#: Bytes up to which a short table of keys is sent to every executor, counted as Spark holds it there.
BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_OVERHEAD = 192


def run_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/firstmonth-runs/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``df`` written to the shared folder and read back, and the aggregates ``counts`` of its rows, taken while writing."""
    folder = new_folder(df.sparkSession, name)
    seen = Observation()
    observed = df.observe(seen, *[column.alias(key) for key, column in counts.items()]) if counts else df
    observed.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), dict(seen.get) if counts else {}


def held_bytes(*keys: str) -> Column:
    """Aggregate: upper estimate of what a broadcast of text or number ``keys`` takes."""
    width = sum((F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) for key in keys), F.lit(0)).cast("bigint")
    return F.coalesce(F.sum(width * 2 + _ROW_OVERHEAD), F.lit(0))


def small(df: DataFrame, size: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for a map-side join if its measured ``size`` allows; otherwise for a sort-merge join."""
    return F.broadcast(df) if size <= bound else df.hint("merge")


def discard_run(spark: SparkSession) -> None:
    """Remove what this application has left in the shared folder; other runs keep theirs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
