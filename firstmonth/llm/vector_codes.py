"""Product codes of vectors by a dual-tree Lloyd iteration in whole numbers.

Vectors are cut into equal consecutive parts; every part position has a codebook. Blocks of vectors are built once, each with
one balanced tree a part position: nodes hold the box, the sum and the number of their parts. Each round builds a small
tree over the entries of every codebook and walks both trees together: a pair of nodes goes when its least distance is above
what another pair grants every part of the node. A node with one entry left is added to it by its cached sum; the parts of
leaves that stay uncertain are compared one by one. All of this is in integers, so bounds and ties are exact, and sums
are added up over the cluster; only the codebooks are on the driver.

Vectors that are null or hold a null or non-finite component are left out, and so are those of another length than the vector of the
smallest id. Components beyond ``limit(length)`` (32,768 before scaling for 64 components) are taken as that limit, so that
distances fit 64 bits. A length that the number of parts does not divide is filled up with zeros. Repeated rows and ids are rows of their own;
the first entries come by id, then by vector, null ids last, and are fewer than asked for if there are fewer vectors. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from firstmonth.llm.common import measured_broadcast, save

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6

#: Vectors of a block, and parts of a leaf.
BLOCK = 4096
LEAF = 16

_FAR = np.iinfo(np.int64).max


def limit(length: int) -> int:
    """Largest size of a component: the distance of two vectors is at most 2^62."""
    return math.isqrt(2**60 // max(length, 1))


def whole(vector: Column, length: int, parts: int = PARTS) -> Column:
    """Integer components of a vector, filled up to a multiple of ``parts``."""
    most = F.lit(limit(length)).cast("double")
    cells = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE).cast("double"), most), -most).cast("int"))
    return F.concat(cells, F.array_repeat(F.lit(0), -length % parts))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` holds finite numbers only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def tree_shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start``, ``end``, ``left`` of the nodes of a balanced tree over ``n`` places; ``left`` is -1 for leaves, else right follows left."""
    start, end, left = [0], [n], []
    for i in range(2 * n):
        if i == len(start):
            break
        if end[i] - start[i] <= LEAF:
            left.append(-1)
            continue
        middle = (start[i] + end[i]) // 2
        left.append(len(start))
        start += [start[i], middle]
        end += [middle, end[i]]
    return np.array(start), np.array(end), np.array(left)


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``points`` (n x d) in the tree, and each node's lower and upper corner and sum. Nodes are halved along their longest side."""
    start, end, left = tree_shape(len(points))
    order = np.arange(len(points))
    low, high, total = (np.empty((len(start), points.shape[1]), dtype=np.int64) for _ in range(3))
    for i in range(len(start)):
        inside = points[order[start[i] : end[i]]]
        low[i], high[i], total[i] = inside.min(axis=0), inside.max(axis=0), inside.sum(axis=0)
        if left[i] >= 0:
            side = np.argmax(high[i] - low[i])
            half = end[left[i]] - start[i]
            order[start[i] : end[i]] = order[start[i] : end[i]][np.argpartition(inside[:, side], half)]
    return order, low, high, total


class EntryTree:
    """A tree over the entries of one codebook; a leaf is one entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.children, self.entry = [], [], [], []
        self._add(np.arange(len(entries)))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.children, self.entry = np.array(self.children), np.array(self.entry)

    def _add(self, members: np.ndarray) -> int:
        at = len(self.low)
        inside = self.entries[members]
        self.low.append(inside.min(axis=0))
        self.high.append(inside.max(axis=0))
        self.children.append((-1, -1))
        self.entry.append(members[0] if len(members) == 1 else -1)
        if len(members) > 1:
            side = np.argmax(self.high[at] - self.low[at])
            members = members[np.argsort(inside[:, side], kind="stable")]
            half = len(members) // 2
            self.children[at] = (self._add(members[:half]), self._add(members[half:]))
        return at


def assign(points: np.ndarray, tree: tuple, entries: EntryTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of every point (ties: the lower index), and sum and number of points of every entry."""
    order, low, high, total = tree
    start, end, left = tree_shape(len(points))
    codes = np.full(len(points), -1, dtype=np.int64)
    sums = np.zeros_like(entries.entries)
    counts = np.zeros(len(entries.entries), dtype=np.int64)
    nodes, others = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    uncertain: list[tuple[np.ndarray, np.ndarray]] = []
    while len(nodes):
        above = np.maximum(low[nodes] - entries.high[others], 0)
        below = np.maximum(entries.low[others] - high[nodes], 0)
        least = (np.maximum(above, below) ** 2).sum(axis=1)
        widest = np.maximum(high[nodes] - entries.low[others], entries.high[others] - low[nodes])
        granted = np.full(len(start), _FAR)
        np.minimum.at(granted, nodes, (widest**2).sum(axis=1))
        kept = least <= granted[nodes]
        nodes, others = nodes[kept], others[kept]
        single = entries.entry[others] >= 0
        alone = (np.bincount(nodes, minlength=len(start))[nodes] == 1) & single
        for node, entry in zip(nodes[alone], entries.entry[others[alone]]):
            codes[order[start[node] : end[node]]] = entry
        np.add.at(sums, entries.entry[others[alone]], total[nodes[alone]])
        np.add.at(counts, entries.entry[others[alone]], (end - start)[nodes[alone]])
        nodes, others, single = nodes[~alone], others[~alone], single[~alone]
        # a leaf waits until single entries only are left for it, or bounds of those still open could be taken for all
        is_leaf = left[nodes] < 0
        done = is_leaf & (np.bincount(nodes[~single], minlength=len(start))[nodes] == 0)
        uncertain.append((nodes[done], entries.entry[others[done]]))
        nodes, others, single, is_leaf = nodes[~done], others[~done], single[~done], is_leaf[~done]
        # the children of both; a leaf and an entry stay as they are
        first = np.where(is_leaf, nodes, left[nodes])
        second = np.where(is_leaf, -1, left[nodes] + 1)
        one = np.where(single, others, entries.children[others, 0])
        two = np.where(single, -1, entries.children[others, 1])
        pairs = np.concatenate([np.stack(p) for p in ((first, one), (first, two), (second, one), (second, two))], axis=1)
        nodes, others = pairs[:, (pairs >= 0).all(axis=0)]
    _compare(points, order, start, end, uncertain, entries.entries, codes, sums, counts)
    return codes, sums, counts


def _compare(points, order, start, end, uncertain, entries, codes, sums, counts) -> None:
    """The parts of uncertain leaves against the entries left for them."""
    nodes = np.concatenate([x[0] for x in uncertain])
    chosen = np.concatenate([x[1] for x in uncertain])
    if not len(nodes):
        return
    sizes = (end - start)[nodes]
    places = np.repeat(start[nodes] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    members, candidates = order[places], np.repeat(chosen, sizes)
    distances = ((points[members] - entries[candidates]) ** 2).sum(axis=1)
    rows, at = np.unique(members, return_inverse=True)
    table = np.full((len(rows), len(entries)), _FAR)
    table[at, candidates] = distances
    nearest = table.argmin(axis=1)
    codes[rows] = nearest
    np.add.at(sums, nearest, points[rows])
    np.add.at(counts, nearest, 1)


def build_blocks(vectors: DataFrame, length: int, parts: int = PARTS) -> DataFrame:
    """Saved blocks of ``vec_id``, ``label``, ``embedding``: ids, labels, integer parts, and a tree for each part position."""
    cells = vectors.select(F.col("vec_id").cast("long"), "label", whole(F.col("embedding"), length, parts).alias("cells"))
    label_type = vectors.schema["label"].dataType
    binary = ["cells", "orders", "lows", "highs", "totals"]
    schema = StructType(
        [StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(label_type))]
        + [StructField(name, BinaryType()) for name in binary]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(begin, BLOCK)
                n = batch.num_rows
                points = batch.column(2).flatten().to_numpy().reshape(n, parts, -1).astype(np.int64)
                trees = list(zip(*[build_tree(points[:, p]) for p in range(parts)]))
                data = [points.astype(np.int32), np.array(trees[0], dtype=np.int32)]
                data += [np.array(trees[1], dtype=np.int32), np.array(trees[2], dtype=np.int32), np.array(trees[3])]
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*lists, *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["ids", "labels", *binary]
                )

    return save(cells.mapInArrow(build, schema), "vector-blocks")


def _read_block(row: dict, parts: int) -> tuple[np.ndarray, list[tuple]]:
    n = len(row["orders"]) // 4 // parts
    points = np.frombuffer(row["cells"], np.int32).astype(np.int64).reshape(n, parts, -1)
    shape = (parts, -1, points.shape[2])
    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, n)
    low, high = (np.frombuffer(row[x], np.int32).astype(np.int64).reshape(shape) for x in ("lows", "highs"))
    total = np.frombuffer(row["totals"], np.int64).reshape(shape)
    return points, [(orders[p], low[p], high[p], total[p]) for p in range(parts)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield {name: row.column(name)[0].as_py() for name in ("cells", "orders", "lows", "highs", "totals")}, row


def first_codebooks(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts x entries x components: the parts of the vectors of the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").cast("long").asc_nulls_last(), "embedding").limit(entries)
    cells = [row["cells"] for row in rows.select(whole(F.col("embedding"), length, parts).alias("cells")).collect()]
    return np.array(cells, dtype=np.int64).reshape(len(cells), parts, -1).transpose(1, 0, 2).copy()


def lloyd_round(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floor of the mean of its parts, unused ones as they were."""
    books = blocks.sparkSession.sparkContext.broadcast(codebooks)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = books.value
        trees = [EntryTree(book) for book in given]
        sums, counts = np.zeros_like(given), np.zeros(given.shape[:2], dtype=np.int64)
        for block, _ in _blocks(batches):
            points, built = _read_block(block, len(given))
            for p, tree in enumerate(trees):
                _, part_sums, part_counts = assign(points[:, p], built[p], tree)
                sums[p] += part_sums
                counts[p] += part_counts
        cell = np.arange(given.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), given.shape[2]))], ["cell", "total", "n"]
        )

    found = blocks.mapInArrow(totals, "cell long, total long, n long").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    after = codebooks.copy().ravel()
    for row in found.collect():  # one row a component of the codebooks
        if row["n"]:
            after[row["cell"]] = row["total"] // row["n"]
    return after.reshape(codebooks.shape)


def encode(blocks: DataFrame, codebooks: np.ndarray, label_type) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error`` of all vectors."""
    books = blocks.sparkSession.sparkContext.broadcast(codebooks)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = books.value
        trees = [EntryTree(book) for book in given]
        for block, row in _blocks(batches):
            points, built = _read_block(block, len(given))
            error = np.zeros(len(points), dtype=np.int64)
            digits = np.empty((len(points), len(given)), dtype=np.uint8)
            for p, tree in enumerate(trees):
                code, _, _ = assign(points[:, p], built[p], tree)
                error += ((points[:, p] - given[p][code]) ** 2).sum(axis=1)
                digits[:, p] = code
            text = [x.tobytes().hex() for x in digits]
            yield pa.RecordBatch.from_arrays(
                [row.column("ids").flatten(), row.column("labels").flatten(), pa.array(text), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    fields = [("vec_id", LongType()), ("label", label_type), ("code", StringType()), ("error", LongType())]
    return blocks.mapInArrow(codes, StructType([StructField(*field) for field in fields]))


def fit(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray] | None:
    """Saved blocks of ``vectors`` and their codebooks after all rounds; None if no vector is usable."""
    if not 1 <= entries <= 256:
        raise ValueError(f"An entry is one byte of a code: from 1 to 256 of them, not {entries}.")
    good = usable(vectors.select("vec_id", "label", "embedding"))
    first = good.orderBy(F.col("vec_id").cast("long").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).first()
    if first is None:
        return None
    good = good.where(F.size("embedding") == first["n"])
    blocks = build_blocks(good, first["n"], parts)
    codebooks = first_codebooks(good, first["n"], parts, entries)
    for _ in range(rounds):
        codebooks = lloyd_round(blocks, codebooks)
    return blocks, codebooks


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of all usable vectors."""
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    fitted = fit(vectors, parts, entries, rounds)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks, codebooks = fitted
    coded = save(encode(blocks, codebooks, vectors.schema["label"].dataType), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(measured_broadcast(save(by_label, "label-errors")), F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
