"""Helpers shared by the operators: intermediate tables, row keys, joins of wide tables, files in the shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from firstmonth.sources.shared import shared_folder

#: Rows, and bytes of their values, up to which a table is broadcast: two longs a row are about 100 MB in Spark's hashed form.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128_000_000

#: Rows that Python code looks at together; bounds its memory next to Arrow's own limit of 64 MB a batch.
SLICE_ROWS = 256

#: Bytes of text that Python code turns into ids at once, if no single text is longer.
SLICE_BYTES = 2_000_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/llm/{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Together with the id this tells rows apart; equal rows share it. Nulls differ from empty values."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(text).isNull())


def measured_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a saved table, marked for broadcast if its rows and their bytes are few enough; else left to a shuffled join."""
    width = value_bytes(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
    measured = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if measured["n"] <= rows and measured["size"] <= size else df


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes; texts, lists and lists of texts by what they hold."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    if isinstance(kind, ArrayType):
        held = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType))
        return F.coalesce(held, F.lit(0)) + 8
    return F.lit(8).cast("long")


def join_keys(docs: DataFrame, keys: DataFrame, how: str, key: Callable[[], Column] = row_key) -> DataFrame:
    """Semi or anti join of whole documents with ``keys`` (a saved table of ``doc_id`` and ``row_key``, made by ``key``).

    The columns of ``docs`` stay as they are, whatever their names.
    """
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("left_id"),
        key().alias("left_key"),
    )
    right = keys.select(F.col("doc_id").alias("right_id"), F.col("row_key").alias("right_key"))
    on = F.col("left_id").eqNullSafe(F.col("right_id")) & (F.col("left_key") == F.col("right_key"))
    return kept.join(measured_broadcast(right), on, how).select("doc.*")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sliced_by_size(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``SLICE_ROWS`` rows whose texts in ``column`` take at most ``size`` bytes, or of one longer text."""
    for batch in sliced(batches):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for tasks that read or write files themselves."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class CommittedFile:
    """A file that takes its name only when complete; a retried task replaces it by an equal one."""

    def __init__(self, folder: str, name: str):
        self.system, root = filesystem(folder)
        self.path = f"{folder}/{name}"
        self._final = f"{root}/{name}"
        self._temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
        self.system.create_dir(root, recursive=True)
        self._stream = self.system.open_output_stream(self._temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self._stream.close()
        self.system.move(self._temporary, self._final)


def discard(spark: SparkSession) -> None:
    """Remove what the operators of this application have left in the shared folder, when their results are no longer needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
