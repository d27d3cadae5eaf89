"""How five filters interact, whatever their order: counted by a stream over the files of documents.

All files are read as available-now micro-batches. A task turns each text into its digest and the mask of the filters that it
fails by itself, and merges equal texts before anything is shuffled. The fifth filter, "equal to the text of a smaller id", is
keyed state: per text the smallest id so far and the masks of the documents that have it, in buckets of texts whose number grows
with the table. When a smaller id arrives, the earlier masks are retracted from the counters of their parts and come back with the
fifth filter failed. The stream writes changes of counters only; added up they are the number of documents by part and mask, from
which all 120 orders follow without another look at the documents. State of very many texts fits no heap: a cluster then
sets ``spark.sql.streaming.stateStore.providerClass`` to Spark's RocksDB provider.

Filters: A under 100 words; B distinct words under 80 % of words; C more than 10 % of code points are A-Z; D any of ``#$%&*|``;
E equal to the text of any smaller id. Null texts are empty ones. Null ids are smaller or larger than none, so they neither fail E nor make
others fail it. Rows of equal id and text both have the smallest id, if one has. A document has a label if any of its rows
in ``labels`` has it; labels of null ids and of unknown documents count for nothing. Null and empty ``lang`` are one part. An empty table
gives no rows. Other columns are not read. The result does not depend on the order of files or on how many make a batch.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from firstmonth.llm.common import measured_broadcast, new_folder, save, sliced

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PCT = 80
MAX_UPPER_PCT = 10
SYMBOLS = b"#$%&*|"

_UPPER = bytes(range(65, 91))
_EQUAL, _QUALITY, _TOXIC, _NO_ID = 16, 32, 64, 128

#: Micro-batches that the files are dealt to, and texts that a task merges before it sends them on.
BATCHES = 8
MERGED = 100_000

#: Documents for each bucket of texts. State is kept by bucket: one Python call for each text took 1.7 ms of a core.
BUCKET = 4_000

_MEASURED = "doc_id long, part string, flags int, text_key binary"
_MERGED = "text_key binary, doc_id long, part string, flags int, n long"
CHANGES = "part string, flags int, n long"
_HELD = pa.schema([("text_key", pa.binary()), ("least", pa.int64()), ("part", pa.string()), ("flags", pa.int32()), ("n", pa.int64())])


def own_mask(data: bytes, code_points: int) -> int:
    """Bits 1, 2, 4, 8: the text fails A, B, C, D."""
    words = data.split()  # at ASCII white space
    upper = len(data) - len(data.translate(None, _UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words)) << 1
        | (100 * upper > MAX_UPPER_PCT * code_points) << 2
        | (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column(1).fill_null("")
        data = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
        masks = [own_mask(x, n) for x, n in zip(data, pc.utf8_length(texts).to_pylist())]
        keys = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
        columns = [batch.column(0), batch.column(2).fill_null(""), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "flags", "text_key"])


class TextState:
    """Smallest id of one text and the documents that have it; ``changes`` of the counters since it was made."""

    def __init__(self, least: int | None = None, held: Counter | None = None):
        self.least = least
        self.held = Counter() if held is None else held
        self.changes: Counter = Counter()

    def add(self, doc_id: int, part: str, flags: int, n: int) -> None:
        if flags & (_EQUAL | _NO_ID):  # decided for good
            self.changes[part, flags & ~_NO_ID] += n
            return
        if self.least is None or doc_id < self.least:
            for (p, f), m in self.held.items():
                self.changes[p, f] -= m
                self.changes[p, f | _EQUAL] += m
            self.least, self.held = doc_id, Counter()
        if doc_id == self.least:
            self.held[part, flags] += n
            self.changes[part, flags] += n
        else:
            self.changes[part, flags | _EQUAL] += n


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one task: the rows of their smallest id, and all others as rows that fail E already."""
    texts: dict[bytes, TextState] = {}

    def merged() -> pa.RecordBatch:
        rows = []
        for key, text in texts.items():
            rows += [(key, text.least, part, flags, n) for (part, flags), n in text.held.items()]
            kept = {cell: n - text.held.get(cell, 0) for cell, n in text.changes.items()}
            rows += [(key, 0, part, flags if flags & _EQUAL else flags | _NO_ID, n) for (part, flags), n in kept.items() if n]
        texts.clear()
        columns = zip(*rows) if rows else [[]] * 5
        types = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["text_key", "doc_id", "part", "flags", "n"]
        )

    for batch in batches:
        for doc_id, part, flags, key in zip(*[c.to_pylist() for c in batch.columns]):
            known = texts.get(key)
            if known is None:
                known = texts[key] = TextState()
            known.add(doc_id or 0, part, flags | (_NO_ID if doc_id is None else 0), 1)
        if len(texts) > MERGED:
            yield merged()
    yield merged()


def _pack(texts: dict[bytes, tuple[int, dict]]) -> bytes:
    """State of a bucket: a row for each text and cell."""
    rows = [(key, least, part, flags, n) for key, (least, held) in texts.items() for (part, flags), n in held.items()]
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, _HELD) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HELD)], schema=_HELD))
    return sink.getvalue()


def _unpack(data: bytes) -> dict[bytes, tuple[int, dict]]:
    texts: dict[bytes, tuple[int, dict]] = {}
    for key, least, part, flags, n in zip(*[c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns]):
        texts.setdefault(key, (least, {}))[1][part, flags] = n
    return texts


def _update(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The texts of one bucket in one micro-batch."""
    texts = _unpack(state.get[0]) if state.exists else {}
    touched: dict[bytes, TextState] = {}
    for frame in frames:
        for key, *row in zip(*[frame[name].tolist() for name in ("text_key", "doc_id", "part", "flags", "n")]):
            text = touched.get(key)
            if text is None:
                least, held = texts.get(key, (None, {}))
                text = touched[key] = TextState(least, Counter(held))
            text.add(*row)
    changes: Counter = Counter()
    for key, text in touched.items():
        for cell, n in text.changes.items():
            changes[cell] += n
        if text.held:
            texts[key] = text.least, text.held
    if texts:
        state.update((_pack(texts),))
    changed = [(part, flags, n) for (part, flags), n in changes.items() if n]
    if changed:
        parts, flags, n = zip(*changed)
        yield pd.DataFrame({"part": parts, "flags": flags, "n": n})


def label_flags(labels: DataFrame) -> DataFrame:
    """``label_id``, ``labelled``: one saved row for each id that is of quality 1 or toxic 1 in any row."""
    bits = [F.max((F.col(name) == 1).cast("int")) * bit for name, bit in (("quality", _QUALITY), ("toxic", _TOXIC))]
    flags = F.coalesce(bits[0], F.lit(0)) + F.coalesce(bits[1], F.lit(0))
    found = labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
    return save(found.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(flags.alias("labelled")), "label-flags")


def part_counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``part``, ``flags``, ``n``: saved numbers of the documents in the Parquet files at ``path`` by part, failed filters and labels."""
    files = spark.read.parquet(path)
    names = files.inputFiles()
    buckets = max(1, files.count() // BUCKET)
    per_batch = max(1, math.ceil(len(names) / batches))
    folder, _, last = path.rstrip("/").rpartition("/")
    if len(names) == 1 and names[0].endswith(f"/{last}"):  # a stream takes a single file as a pattern only
        path = f"{folder}/{{{last}}}"
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    measured = stream.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(
        _measure, _MEASURED
    )
    # rows without an id match no label; each goes its own way, as null keys would meet in one task
    known = measured.withColumn("join_id", F.coalesce("doc_id", F.xxhash64("text_key"))).withColumn("has_id", F.col("doc_id").isNotNull())
    flags = measured_broadcast(label_flags(labels))
    on = (F.col("join_id") == F.col("label_id")) & F.col("has_id")
    flagged = known.join(flags, on, "left").select(
        "doc_id", "part", F.col("flags").bitwiseOR(F.coalesce("labelled", F.lit(0))).alias("flags"), "text_key"
    )
    changes = (
        flagged.mapInArrow(_merge, _MERGED)
        .withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(_update, CHANGES, "texts binary", "append", GroupStateTimeout.NoTimeout)
    )
    folder = new_folder(spark, "filter-audit")
    query = (
        changes.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/changes")
    )
    query.awaitTermination()
    added = spark.read.schema(CHANGES).parquet(f"{folder}/changes").groupBy("part", "flags").agg(F.sum("n").alias("n"))
    return save(added.where("n != 0"), "part-counters")


def interactions(counters: DataFrame) -> DataFrame:
    """All orders and steps of every part of ``counters``."""
    steps = [
        (order, k + 1, order[k], 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(x) for x in order[:k]))
        for order in map("".join, permutations(FILTERS))
        for k in range(len(FILTERS))
    ]
    every = F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(s, ("filter_order", "step", "letter", "own", "earlier"))]) for s in steps])
    mask = F.col("flags").bitwiseAND(31)
    labelled = [F.sum(F.when(F.col("flags").bitwiseAND(bit) > 0, F.col("n")).otherwise(0)) for bit in (_QUALITY, _TOXIC)]
    masks = counters.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), labelled[0].alias("good"), labelled[1].alias("toxic"))
    rows = masks.select("*", F.explode(every).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) > 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) > 0

    def total(condition, value="n"):
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    counted = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    over_orders = Window.partitionBy("part", "letter")  # 120 rows
    return counted.withColumn("shapley", F.sum("removed").over(over_orders)).drop("letter")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each part, order of filters and step."""
    return interactions(part_counters(spark, path, labels, batches))
