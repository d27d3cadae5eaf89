"""Token ids in files, as canonical length-limited Huffman codes.

Writing: documents are dealt out by ranges of ``doc_id``, encoded in that order and gathered into blocks of whole
documents. Global id counts (at most one row for each id) give the code lengths, by package-merge. Each block is then
coded on its own. Reading: every block can be decoded apart from the others with one table lookup an id; checkpoints hold
the bit offset of every ``STRIDE``-th id, so that all stretches of a block, and of a few blocks, are decoded side by side.

A file holds, one after another, blocks of:

    4 bytes  b"HUFB"
    u32      number of documents D
    u32      number of ids N
    u32      length of the code in 32-bit words W
    D times  u8 1 if the id is known, 0 if null; i64 doc_id; u32 number of ids (as three arrays)
    u32      for each stretch of STRIDE ids the bit offset of its first (ceil(N / STRIDE) numbers)
    W words  of the code, big-endian, first bit highest; the rest of the last word is zero

All other numbers are little-endian. The code lengths (one byte for each id) are in the file ``codebook``; codes follow
from them: shorter first, then by id. A table of files (``manifest``) keeps where blocks begin.

Null text counts as empty: the end id only. Null ids come first; rows of equal id are ordered by text, null text
first, repeated rows are written as often as they occur. An empty table gives a manifest without rows and reads back
as no rows. Other columns are not read. A document lies within one block, so a very long one makes a large block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firstmonth.llm.common import CommittedFile, filesystem, new_folder, save, sliced
from firstmonth.llm.tokens import END_ID, ID_TYPE, encoder, tokenizer_path

MAX_BITS = 20
BLOCK_IDS = 65_536
STRIDE = 128
MAGIC = b"HUFB"
#: Bytes of blocks that are decoded side by side, if no single block is longer.
TOGETHER_BYTES = 1_000_000
#: Low bits of an entry of the decoding table, for the length of its code.
_SIZE_BITS = 5

BLOCKS = """shard int, block long, known binary, doc_ids binary, lengths binary, n_ids long, ids binary,
    seen array<struct<id: long, n: long>>"""
MANIFEST = """path string, shard int, first_block long, n_ids long, offsets array<long>, sizes array<long>,
    starts array<long>"""
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass
class Archive:
    """Written files: where the code lengths are, and one row for each file."""

    codebook: str
    manifest: DataFrame


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths (0 for ids that don't occur) of an optimal prefix code of at most ``max_bits``, by package-merge.

    At each level the items are the ids, by count, and pairs of the level before. How many ids are among the first
    items of a level tells how many of the rarest ids get one more bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    rarest = used[np.argsort(counts[used], kind="stable")]
    weights = counts[rarest].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        items = np.concatenate([weights, packages])
        order = np.argsort(items, kind="stable")
        levels.append(order < len(weights))
        items = items[order]
        items = items[: len(items) // 2 * 2]
        packages = items[0::2] + items[1::2]
    taken = 2 * len(used) - 2
    for single in reversed(levels):
        n = int(single[:taken].sum())
        lengths[rarest[:n]] += 1
        taken = 2 * (taken - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter ones first, then by id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= 1
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every value of the next ``bits`` bits the id and, in the low bits, the length of its code."""
    bits = int(lengths.max(initial=1)) or 1
    kind = np.uint32 if len(lengths) <= 1 << 32 - _SIZE_BITS else np.int64
    entries = np.ones(1 << bits, dtype=kind)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    widths = (1 << (bits - lengths[order].astype(np.int64))).astype(np.int64)
    if len(order):
        first = int(codes[order[0]]) << (bits - int(lengths[order[0]]))
        entry = order.astype(kind) << kind(_SIZE_BITS) | lengths[order].astype(kind)
        entries[first : first + int(widths.sum())] = np.repeat(entry, widths)
    return entries, bits


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Checkpoints and code words of a block."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = np.zeros(int(ends[-1] + 31 >> 5) + 1 if len(ids) else 0, dtype=np.uint64)
    if len(ids):
        at = starts >> 5
        shifted = codes[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        both = np.add.reduceat(shifted, first)  # codes don't overlap, so sums hold all their bits
        words[at[first]] |= both >> np.uint64(32)
        words[at[first] + 1] |= both & np.uint64(0xFFFFFFFF)
        words = words[: int(ends[-1] + 31 >> 5)]
    return starts[::STRIDE].astype("<u4"), words.astype(">u4")


def decode_ids(n: int, checkpoints: np.ndarray, words: np.ndarray, table: tuple) -> np.ndarray:
    """The ids of a block."""
    return decode_blocks([(n, checkpoints, words)], table)[0]


def decode_blocks(blocks: list[tuple[int, np.ndarray, np.ndarray]], table: tuple) -> list[np.ndarray]:
    """The ids of each block (``n``, checkpoints, words): a step takes one id from every stretch of all of them."""
    entries, bits = table
    first_word = np.cumsum([0, *[len(words) for _, _, words in blocks]])
    lanes = np.cumsum([0, *[len(checkpoints) for _, checkpoints, _ in blocks]])
    at = np.concatenate([x.astype(np.int64) + 32 * w for (_, x, _), w in zip(blocks, first_word.tolist())])
    wide = np.concatenate([*[words.astype(np.uint64) for _, _, words in blocks], np.zeros(2, dtype=np.uint64)])
    wide = (wide[:-1] << np.uint64(32) | wide[1:]).view(np.int64)  # the bits of the sign are masked out
    mask, size_mask = np.int64((1 << bits) - 1), entries.dtype.type((1 << _SIZE_BITS) - 1)
    out = np.zeros((STRIDE, len(at)), dtype=entries.dtype)
    word, value = np.empty_like(at), np.empty_like(at)
    for step in range(min(STRIDE, max(n for n, _, _ in blocks))):
        np.right_shift(at, 5, out=word)
        wide.take(word, out=value, mode="clip")  # stretches that have ended run on, up to the last word
        np.bitwise_and(at, 31, out=word)
        np.subtract(64 - bits, word, out=word)
        np.right_shift(value, word, out=value)
        np.bitwise_and(value, mask, out=value)
        entries.take(value, out=out[step], mode="clip")
        at += out[step] & size_mask
    out >>= entries.dtype.type(_SIZE_BITS)
    parts = zip(blocks, lanes[:-1].tolist(), lanes[1:].tolist())
    return [out[:, start:end].T.reshape(-1)[:n].astype(ID_TYPE, copy=False) for (n, _, _), start, end in parts]


def id_blocks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Saved rows of one block each, numbered within shards that hold ascending ranges of ``doc_id``.

    One more row for each shard, without a block, tells in ``seen`` how often each id occurs in the shard.
    """
    path = path or tokenizer_path()
    end = np.array([END_ID], dtype=ID_TYPE).tobytes()
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        shard, block, doc_ids, encoded, n = 0, 0, [], [], 0
        seen = _Seen()
        for batch in sliced(batches):
            shard = batch.column(0)[0].as_py()
            texts = [x or "" for x in batch.column(2).to_pylist()]
            for doc_id, ids in zip(batch.column(1).to_pylist(), encode(texts)):
                doc_ids.append(doc_id)
                encoded.append(ids + end)
                n += len(ids) // ID_TYPE.itemsize + 1
                if n >= BLOCK_IDS:
                    yield _block_row(shard, block, doc_ids, encoded, seen)
                    block, doc_ids, encoded, n = block + 1, [], [], 0
        if doc_ids:
            yield _block_row(shard, block, doc_ids, encoded, seen)
        if len(seen.counts):
            yield seen.row(shard)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text").select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    return save(ordered.mapInArrow(gather, BLOCKS), "id-blocks")


class _Seen:
    """How often each id has come so far."""

    def __init__(self) -> None:
        self.counts = np.zeros(0, dtype=np.int64)

    def add(self, ids: np.ndarray) -> None:
        n = np.bincount(ids)
        if len(n) > len(self.counts):
            n, self.counts = self.counts, n
        self.counts[: len(n)] += n

    def row(self, shard: int) -> pa.RecordBatch:
        ids = np.flatnonzero(self.counts)
        pairs = pa.StructArray.from_arrays([pa.array(ids), pa.array(self.counts[ids])], ["id", "n"])
        return _blocks_batch({"shard": shard}, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pairs))


_BLOCK_TYPES = {
    "shard": pa.int32(),
    "block": pa.int64(),
    "known": pa.binary(),
    "doc_ids": pa.binary(),
    "lengths": pa.binary(),
    "n_ids": pa.int64(),
    "ids": pa.binary(),
}
_SEEN_TYPE = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def _blocks_batch(row: dict, seen: pa.Array | None = None) -> pa.RecordBatch:
    columns = {name: pa.array([row.get(name)], kind) for name, kind in _BLOCK_TYPES.items()}
    return pa.RecordBatch.from_pydict(columns | {"seen": pa.nulls(1, _SEEN_TYPE) if seen is None else seen})


def _block_row(shard: int, block: int, doc_ids: list, encoded: list[bytes], seen: _Seen) -> pa.RecordBatch:
    lengths = np.array([len(x) // ID_TYPE.itemsize for x in encoded], dtype="<u4")
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], dtype="<i8")
    ids = np.frombuffer(b"".join(encoded), dtype=ID_TYPE)
    seen.add(ids)
    return _blocks_batch(
        {
            "shard": shard,
            "block": block,
            "known": known.tobytes(),
            "doc_ids": numbers.tobytes(),
            "lengths": lengths.tobytes(),
            "n_ids": len(ids),
            "ids": _narrow(ids),
        }
    )


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough; the first byte tells."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + ids.tobytes()


def _widen(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, dtype="<u2" if stored[0] == 2 else ID_TYPE, offset=1).astype(ID_TYPE)


def id_counts(blocks: DataFrame) -> DataFrame:
    """``id``, ``n``: how often each id occurs in all documents."""
    counted = blocks.where("seen is not null").select(F.inline("seen"))
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def write_archive(docs: DataFrame, folder: str | None = None, path: str | None = None) -> Archive:
    """Write the token ids of ``docs`` (``doc_id``, ``text``) to files in ``folder`` of the shared store."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "huffman")
    blocks = id_blocks(docs, path)
    counted = id_counts(blocks).toPandas()  # one row for each id of the vocabulary at most
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, dtype=np.int64)
    counts[counted["id"].to_numpy(dtype=np.int64)] = counted["n"]
    lengths = code_lengths(counts)
    book = CommittedFile(folder, "codebook")
    book.write(lengths.tobytes())
    book.commit()
    shared = spark.sparkContext.broadcast(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        codes = canonical_codes(lengths)
        out, row, after = None, None, None
        for batch in batches:
            for x in sliced([batch], 1):
                block = {k: v[0] for k, v in x.to_pydict().items()}
                if out is not None and (block["shard"], block["block"]) != after:
                    yield _close(out, row)
                    out = None
                if out is None:
                    out = CommittedFile(folder, f"shard-{block['shard']:06d}-{block['block']:09d}.huf")
                    row = [out.path, block["shard"], block["block"], 0, [], [], []]
                data = _coded(block, lengths, codes)
                row[4].append(out.size)
                row[5].append(len(data))
                row[6].append(row[3])
                row[3] += block["n_ids"]
                out.write(data)
                after = (block["shard"], block["block"] + 1)
        if out is not None:
            yield _close(out, row)

    blocks = blocks.where("block is not null").drop("seen")
    return Archive(book.path, save(blocks.mapInArrow(code, MANIFEST), "huffman-manifest"))


def _close(out: CommittedFile, row: list) -> pa.RecordBatch:
    out.commit()
    names = ["path", "shard", "first_block", "n_ids", "offsets", "sizes", "starts"]
    longs = pa.list_(pa.int64())
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), longs, longs, longs]
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, types)], names)


def _coded(block: dict, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    checkpoints, words = encode_ids(_widen(block["ids"]), lengths, codes)
    head = MAGIC + struct.pack("<III", len(block["known"]), block["n_ids"], len(words))
    return b"".join(
        [head, block["known"], block["doc_ids"], block["lengths"], checkpoints.tobytes(), words.tobytes()]
    )


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, np.ndarray, np.ndarray]]:
    """Known flags, ids and lengths of the documents of a block, and its token ids as ``decode_blocks`` takes them."""
    if data[:4] != MAGIC:
        raise ValueError("not a block")
    n_docs, n_ids, n_words = struct.unpack_from("<III", data, 4)
    at, parts = 16, []
    for kind, n in (("u1", n_docs), ("<i8", n_docs), ("<u4", n_docs), ("<u4", -(-n_ids // STRIDE)), (">u4", n_words)):
        parts.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += parts[-1].nbytes
    known, doc_ids, lengths, checkpoints, words = parts
    return known, doc_ids, lengths, (n_ids, checkpoints, words)


def block_places(archive: Archive) -> DataFrame:
    """``path``, ``offset``, ``size``, ``start`` of every block; ``start`` counts the ids of all blocks before it."""
    manifest = archive.manifest
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(earlier), F.lit(0)).alias("before"))
    files = Window.partitionBy("shard").orderBy("first_block").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.join(shards, "shard").withColumn(
        "before", F.col("before") + F.coalesce(F.sum("n_ids").over(files), F.lit(0))
    )
    return manifest.select("path", "before", F.inline(F.arrays_zip("offsets", "sizes", "starts"))).select(
        "path", F.col("offsets").alias("offset"), F.col("sizes").alias("size"), (F.col("before") + F.col("starts")).alias("start")
    )


def read_archive(spark: SparkSession, archive: Archive, with_ids: bool = False) -> DataFrame:
    """Decode all files: per document ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, its ``ids``."""
    codebook = archive.codebook
    tables: dict[str, tuple] = {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if codebook not in tables:
                system, name = filesystem(codebook)
                with system.open_input_stream(name, compression=None) as f:
                    tables[codebook] = decoding_table(np.frombuffer(f.read(), dtype=np.uint8))
            blocks, starts, held = [], [], 0
            for path, offset, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                if blocks and held + size > TOGETHER_BYTES:
                    yield _decoded(blocks, starts, tables[codebook], with_ids)
                    blocks, starts, held = [], [], 0
                system, name = filesystem(path)
                with system.open_input_file(name) as f:
                    blocks.append(read_block(f.read_at(size, offset)))
                starts.append(start)
                held += size
            if blocks:
                yield _decoded(blocks, starts, tables[codebook], with_ids)

    places = block_places(archive)
    places = places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset")
    return places.mapInArrow(decode, f"{DOCUMENTS}, ids binary" if with_ids else DOCUMENTS)


def _decoded(blocks: list[tuple], starts: list[int], table: tuple, with_ids: bool) -> pa.RecordBatch:
    """A row for each document of the blocks."""
    decoded = decode_blocks([block[3] for block in blocks], table)
    first, crcs, each, width = [], [], [], ID_TYPE.itemsize
    for (_, _, lengths, _), start, ids in zip(blocks, starts, decoded):
        ends = np.cumsum(lengths.astype(np.int64))
        first.append(start + ends - lengths)
        raw = memoryview(ids.tobytes())
        documents = [raw[(e - n) * width : e * width] for e, n in zip(ends.tolist(), lengths.tolist())]
        crcs += [zlib.crc32(x) for x in documents]
        if with_ids:
            each += [bytes(x) for x in documents]
    known, doc_ids, lengths = [np.concatenate([block[i] for block in blocks]) for i in range(3)]
    columns = [
        pa.array(doc_ids, pa.int64(), mask=known == 0),
        pa.array(np.concatenate(first)),
        pa.array(lengths.astype(np.int64)),
        pa.array(crcs, pa.int64()),
    ]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns, names = [*columns, pa.array(each, pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)
