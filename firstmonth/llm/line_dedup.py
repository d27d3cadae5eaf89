"""Lines that many documents share, as compressed keep bitmaps of each document.

Every line becomes two hashes of its key, the document and the position; no text is shuffled. Rows are partitioned by
ranges of hash, document and position, so that a line of any frequency is spread over as many tasks as its rows fill,
and sorted alike within them. Each task streams its rows once: it counts the documents of a run of equal hashes and
decides the run as soon as enough are seen, holding the rows of fewer than ``min_documents`` documents. Only the first and
the last run of a task may go on in another one: those leave a summary, and are decided when summaries are added up. Positions
to drop become one bitmap a document.

The key is the line without blanks at its ends and with A-Z lower-cased. Two keys are taken as equal when both 64-bit hashes are.
Null and empty texts have one empty line. Documents are told apart by id and text: rows equal in both are one document, count
once and share a bitmap; null ids are ordinary ids, before all others. An empty table gives no bitmaps. Other columns are
not read, and stay as they are in ``drop_lines``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstmonth.llm.common import measured_broadcast, row_key, save, sliced

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Documents that must share a line, and code points that its key must have.
MIN_DOCUMENTS = 10
MIN_CHARS = 1

_ORDER = ["hash", "check", "doc_id", "row_key", "position"]
_STREAMED = (
    "kind string, hash long, check long, doc_id long, row_key long, position int, "
    "n_documents long, last_id long, last_key long"
)
BITMAPS = "doc_id long, row_key long, n_lines long, n_dropped long, keep binary"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``hash``, ``check``, ``doc_id``, ``row_key``, ``position`` of all lines whose key is long enough; none twice."""
    keys = F.transform(split_lines(F.col("text")), line_key)
    lines = docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), F.posexplode(keys).alias("position", "key"))
    hashes = [F.xxhash64("key").alias("hash"), F.xxhash64(F.lit(1), "key").alias("check")]
    return lines.where(F.char_length("key") >= min_chars).select(*hashes, "doc_id", "row_key", "position").distinct()


class _Run:
    """The run of equal hashes that is open at the end of a batch."""

    def __init__(self, rows: dict[str, np.ndarray], start: int, is_first: bool):
        self.key = rows["hash"][start], rows["check"][start]
        self.first = {name: rows[name][start] for name in ("doc_id", "no_id", "row_key", "position")}
        self.is_first = is_first
        self.documents = 0
        self.last = None
        self.waiting: dict[str, np.ndarray] | None = None


def _rows_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    ids = batch.column(2)
    return {
        "hash": batch.column(0).to_numpy(),
        "check": batch.column(1).to_numpy(),
        "doc_id": ids.fill_null(0).to_numpy(),
        "no_id": ids.is_null().to_numpy(zero_copy_only=False),
        "row_key": batch.column(3).to_numpy(),
        "position": batch.column(4).to_numpy(),
    }


def _streamed(kind: str, rows: dict[str, np.ndarray], documents: int | None = None, last: tuple | None = None) -> pa.RecordBatch:
    n = len(rows["position"])
    last_id, last_none, last_key = last or (0, True, 0)
    columns = [
        pa.array([kind] * n),
        pa.array(rows["hash"]),
        pa.array(rows["check"]),
        pa.array(rows["doc_id"], mask=rows["no_id"]),
        pa.array(rows["row_key"]),
        pa.array(rows["position"]),
        pa.array([documents] * n, pa.int64()),
        pa.array([None if last_none else int(last_id)] * n, pa.int64()),
        pa.array([None if last is None else int(last_key)] * n, pa.int64()),
    ]
    names = ["kind", "hash", "check", "doc_id", "row_key", "position", "n_documents", "last_id", "last_key"]
    return pa.RecordBatch.from_arrays(columns, names)


def _summary(run: _Run) -> pa.RecordBatch:
    row = {"hash": run.key[0], "check": run.key[1], **run.first}
    return _streamed("summary", {k: np.array([v]) for k, v in row.items()}, run.documents, run.last)


def stream_runs(min_documents: int, keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sorted rows of one range: rows to ``drop``, rows of an ``edge`` run not decided here, a ``summary`` of each edge run."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows_of(batch)
            if run and run.waiting:
                rows = {k: np.concatenate([run.waiting[k], v]) for k, v in rows.items()}
                run.documents, run.last, run.waiting = 0, None, None
            new_run = np.ones(len(rows["hash"]), dtype=bool)
            new_run[1:] = (np.diff(rows["hash"]) != 0) | (np.diff(rows["check"]) != 0)
            new_doc = new_run.copy()
            for k in ("doc_id", "no_id", "row_key"):
                new_doc[1:] |= rows[k][1:] != rows[k][:-1]
            starts = np.flatnonzero(new_run)
            ends = np.append(starts[1:], len(new_run))
            documents = np.add.reduceat(new_doc.astype(np.int64), starts)
            goes_on = run is not None and run.key == (rows["hash"][0], rows["check"][0])
            if goes_on:
                same = run.last == (rows["doc_id"][0], rows["no_id"][0], rows["row_key"][0])
                documents[0] += run.documents - same
            elif run and run.is_first:
                yield _summary(run)
            in_first = run is None or (goes_on and run.is_first)
            drop = np.repeat(documents >= min_documents, ends - starts)
            if keep_first:  # the first row of a run stays; a run that goes on here began with one that was held or decided before
                drop[starts[1:] if goes_on and run.last is not None else starts] = False
            if in_first:
                yield _streamed("edge", {k: v[: ends[0]] for k, v in rows.items()})
                drop[: ends[0]] = False
            if drop.any():
                yield _streamed("drop", {k: v[drop] for k, v in rows.items()})
            if not goes_on:
                run = _Run(rows, 0, run is None)
            if len(starts) > 1:
                if run.is_first:
                    run.documents, run.last = int(documents[0]), _document(rows, ends[0] - 1)
                    yield _summary(run)
                run = _Run(rows, starts[-1], False)
            run.documents, run.last = int(documents[-1]), _document(rows, -1)
            if run.documents < min_documents and not run.is_first:
                run.waiting = {k: v[starts[-1] :].copy() for k, v in rows.items()}
        if run:
            if run.waiting:
                yield _streamed("edge", run.waiting)
            yield _summary(run)

    return stream


def _document(rows: dict[str, np.ndarray], at: int) -> tuple:
    return rows["doc_id"][at], rows["no_id"][at], rows["row_key"][at]


def dropped_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """``doc_id``, ``row_key``, ``position`` of lines that at least ``min_documents`` documents share.

    With ``keep_first`` the first of them, by document and position, is left out.
    """
    order = [F.col(name).asc_nulls_first() for name in _ORDER]
    ranges = lines.select(*_ORDER).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = save(ranges.mapInArrow(stream_runs(min_documents, keep_first), _STREAMED), "line-runs")
    summaries = streamed.where("kind = 'summary'")  # two a task at most
    before = Window.partitionBy("hash", "check").orderBy(*order[2:])
    again = F.lag("last_id").over(before).eqNullSafe(F.col("doc_id")) & (F.lag("last_key").over(before) == F.col("row_key"))
    edges = (
        summaries.withColumn("again", F.coalesce(again, F.lit(False)).cast("long"))
        .groupBy("hash", "check")
        .agg(F.sum(F.col("n_documents") - F.col("again")).alias("n"), F.min(F.struct("doc_id", "row_key", "position")).alias("first"))
        .where(F.col("n") >= min_documents)
        .select(F.col("hash").alias("edge_hash"), F.col("check").alias("edge_check"), "first")
    )
    on = (F.col("hash") == F.col("edge_hash")) & (F.col("check") == F.col("edge_check"))
    at_edges = streamed.where("kind = 'edge'").join(measured_broadcast(save(edges, "line-edges")), on)
    if keep_first:
        at_edges = at_edges.where(F.struct("doc_id", "row_key", "position") != F.col("first"))
    names = ["doc_id", "row_key", "position"]
    return streamed.where("kind = 'drop'").select(*names).unionByName(at_edges.select(*names))


def keep_bitmaps(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, keep_first: bool = False
) -> DataFrame:
    """One row a document: ``doc_id``, ``row_key``, ``n_lines``, ``n_dropped``, ``keep``; saved.

    ``keep`` holds a bit for each line, the first one highest, set if the line stays, compressed by zlib; null if all stay.
    """
    dropped = dropped_lines(line_hashes(docs, min_chars), min_documents, keep_first)
    sizes = docs.select(
        F.col("doc_id").cast("long"), row_key().alias("row_key"), F.size(split_lines(F.col("text"))).cast("long").alias("n_lines")
    )
    parts = sizes.withColumn("position", F.lit(None).cast("int")).unionByName(dropped.withColumn("n_lines", F.lit(None).cast("long")))
    # each task sends a position of a document once, so copies of a row add nothing to it
    positions = parts.groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("position").alias("positions"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            keep = []
            for n, start, end in zip(batch.column(2).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                bits = np.ones(n, dtype=bool)
                bits[values[start:end]] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()) if end > start else None)
            columns = [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(keep, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n_lines", "n_dropped", "keep"])

    return save(positions.mapInArrow(compress, BITMAPS), "keep-bitmaps")


def kept_text(text: str, keep: bytes | None) -> str:
    """The lines of ``text`` that its bitmap keeps."""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([lines[i] for i in np.flatnonzero(bits).tolist()])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of all documents, ``n_dropped`` and ``keep``; documents that keep all of their lines are not looked up."""
    left = docs.select(*columns, F.col("doc_id").cast("long").alias("left_id"), row_key().alias("left_key"))
    right = bitmaps.where("n_dropped > 0").select(
        F.col("doc_id").alias("right_id"), F.col("row_key").alias("right_key"), "n_dropped", "keep"
    )
    on = F.col("left_id").eqNullSafe(F.col("right_id")) & (F.col("left_key") == F.col("right_key"))
    return left.join(measured_broadcast(right), on, "left")


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines of their bitmaps taken out of ``text``; all other columns as they are. Null texts stay null."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    joined = _with_bitmaps(docs, bitmaps, [F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, names)])
    joined = joined.select(*names, "keep")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())
            texts = [None if text is None else kept_text(text, keep) for text, keep in pairs]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    schema = joined.drop("keep").schema
    return joined.mapInArrow(rewrite, schema).toDF(*docs.columns)


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the SHA-256 of what is left of each text."""
    joined = _with_bitmaps(docs, bitmaps, [F.coalesce("text", F.lit("")).alias("kept")]).select("left_id", "kept", "n_dropped", "keep")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            kept = [kept_text(text, keep) for text, keep in zip(texts, batch.column(3).to_pylist())]
            columns = [
                batch.column(0),
                pa.array([text.count("\n") + 1 for text in texts], pa.int64()),
                batch.column(2).fill_null(0),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in kept]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
