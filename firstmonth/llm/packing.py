"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens; a piece's length is all that matters for packing. The
histogram of lengths (at most ``capacity`` rows, whatever the input) goes to the driver. There each bin takes the
longest length left, and a subset-sum table held as the bits of an integer finds the fullest combination of other
lengths beside it. The combination is removed as often as its lengths last, as the same search would find it again. Pieces are
numbered within their length in the order in which they were written, without moving them, and look up their bin by that number.

Null text counts as empty: one piece that holds the end id only. Repeated rows are packed as often as they occur. Which of the
pieces of one length shares a bin with which others follows from the order in the files; any order fills the same bins. An empty table gives no pieces. Other columns are not read. A document is encoded within one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from firstmonth.llm.common import measured_broadcast, save, sliced_by_size
from firstmonth.llm.tokens import END_ID, ID_TYPE, KNOWN, encoder, forget_encoders, tokenizer_path

CAPACITY = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The task that wrote a piece, and how many pieces of its length the task had written before.
WRITTEN = "task int, place long"
PLACES = f"{PIECES}, sequence_id long, offset long"


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, known: int = KNOWN
) -> DataFrame:
    """Pieces of ``doc_id``, ``text``: ids of the whole text and the end id, cut so that all but the first piece are full.

    ``known`` bounds the memory of the encoder, not what it gives: fewer kept pieces of text are encoded more often.
    """
    path = path or tokenizer_path()
    end = np.array([END_ID], dtype=ID_TYPE).tobytes()
    size = ID_TYPE.itemsize
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path, known).encode, TaskContext.get().partitionId()
        written: Counter = Counter()
        for batch in sliced_by_size(batches, 1):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // size
                start, length, piece = 0, n % capacity or capacity, 0
                while start < n:
                    part = ids[start * size : (start + length) * size]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), task, written[length], part if with_ids else None))
                    written[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, f"{PIECES}, {WRITTEN}" + ", ids binary" * with_ids)


def fullest(room: int, available: dict[int, int]) -> list[int]:
    """Lengths, each used no more often than available, with the largest sum that is at most ``room``.

    Bit s of ``reached`` tells that s is the sum of lengths looked at so far. Longer lengths come first, so that
    short ones stay for later bins.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, take = min(available[length], room // length), 1
        while left and not reached >> room & 1:
            take = min(take, left)
            steps.append((length, take, reached))
            reached |= reached << (length * take) & mask
            left, take = left - take, take * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Combinations of lengths and how often each is used; together they use up all lengths."""
    left = {length: n for length, n in counts.items() if n}
    found = []
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        used = Counter([longest, *fullest(capacity - longest, {x: n for x, n in others.items() if n})])
        times = min(left[length] // n for length, n in used.items())
        found.append((used, times))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return found


def bin_ranges(combinations: list[tuple[Counter, int]]) -> np.ndarray:
    """Rows of (length, first number, first bin, pieces of this length in a bin, offset of the first), by length and number."""
    rows, taken, first_bin = [], Counter(), 0
    for used, times in combinations:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, taken[length], first_bin, used[length], offset))
            taken[length] += used[length] * times
            offset += used[length] * length
        first_bin += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each of ``parts`` (a saved table of pieces) its ``sequence_id`` and gapless ``offset``."""
    numbered, counts = _numbered(parts)
    ranges = parts.sparkSession.sparkContext.broadcast(bin_ranges(minimum_slack(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        lengths, firsts, bins, uses, offsets = ranges.value.T
        starts = lengths << 48 | firsts
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            at = np.searchsorted(starts, length << 48 | number, side="right") - 1
            into = number - firsts[at]
            sequence = bins[at] + into // uses[at]
            offset = offsets[at] + into % uses[at] * length
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    fields = [f for f in numbered.schema.fields if f.name != "number"]
    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return numbered.mapInArrow(place, schema)


def _numbered(parts: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``number``: 0, 1, 2, ... within each length; and how many pieces of each length there are.

    A piece knows its place among those of its length in the task that wrote it. Sums over the tasks tell how many there
    are before; a table of one row for each task and length, small beside the pieces, which therefore stay where they are.
    """
    names = [name for name in parts.columns if name not in ("task", "place")]
    written = save(parts.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    counts = {row["length"]: row["n"] for row in written.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = parts.join(measured_broadcast(save(offsets, "piece-offsets")), ["length", "task"])
    return joined.select(*names, (F.col("before") + F.col("place")).cast("long").alias("number")), counts


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, known: int = KNOWN
) -> DataFrame:
    """Encode, cut and pack ``docs``; one row a piece. ``with_ids`` keeps the ids as little-endian bytes."""
    return pack(save(pieces(docs, capacity, path, with_ids, known), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences of a table packed ``with_ids``: ``sequence_id``, ``ids``, ``n_tokens``. At most ``capacity`` ids each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.aggregate(ordered, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        F.sum("length").alias("n_tokens"),
    )
