"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact verification.

Texts are sets of hashes of five consecutive words (lower case, split at white space; fewer words make one shingle).
Texts with equal sets form a class, which from then on counts as one text. Two classes are linked if the Jaccard
similarity of their sets is at least 0.8.

The forest has ``TREES`` tries. The path of a class in a trie is its ``DEPTH`` MinHash values there; classes that share
a long prefix in any trie are similar. Prefixes are shortened until the chance to miss a pair at the threshold is
below ``1 - RECALL``, at most to ``shortest_prefix``; within a node of that prefix, tasks sort paths and go from long shared
prefixes to short ones, and only for classes that are not yet connected: at each step those whose whole signatures
agree well enough are tied together. Components of these ties hold all classes that can be linked. The shingles of
their texts are then read again, and all pairs of a component are compared exactly, in blocks of bounded size.

No pair is ever a row: tasks return a count of links for each class and one tie to the smallest class it is linked with.
A node or component of any size is dealt out over pairs of blocks. Exact copies, be they a third of all rows, are
summed map-side to one class. Signatures are written once; texts are read twice, the second time for classes in
components only.

Null and empty texts have no shingles: they are linked to nothing and each is its own class. Repeated rows are copies.
Null ids are allowed: an id is only a label, rows are told apart by id and text. An empty table gives no rows. Other
columns are not read by ``near_duplicates`` and passed on by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth.llm.common import join_keys, measured_broadcast, row_key, save, sliced
from firstmonth.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 6
RECALL = 0.99999
#: Signatures may agree less than the sets do: 4.5 standard deviations at the threshold.
SLACK = 4.5 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5

#: Members of a node, and members and shingles of a component, that one block holds; a task sees two blocks.
NODE_BLOCK = 1000
PAIR_BLOCK = 512
PAIR_SHINGLES = 1_000_000
_COLUMNS = 4096

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_POSITIONS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = np.dtype("<u4")

SIGNED = "doc_id long, row_key long, digest binary, n_shingles long, signature binary"


def shortest_prefix(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the threshold meet in some trie with a chance of ``recall``."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.full(n, len(words) if len(words) < SHINGLE else 0, dtype=np.uint64)
    for i in range(min(SHINGLE, len(words))):
        mixed += hashes[i : i + n] * _POSITIONS[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles, ``DEPTH`` for each tree in turn."""
    small = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MULTIPLY), 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(small), _COLUMNS):
        values = np.multiply.outer(_MULTIPLY, small[start : start + _COLUMNS])
        values += _ADD[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """Saved rows, one a document: its key, the digest of its set of shingles, and its signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            digests, sizes, signed = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signed.append(signature(found).astype(_VALUE).tobytes() if len(found) else None)
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.binary())]
            names = ["doc_id", "row_key", "digest", "n_shingles", "signature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return save(rows.mapInArrow(sign, SIGNED), "signatures")


def text_classes(signed: DataFrame) -> DataFrame:
    """Saved rows, one a set of shingles: ``digest``, smallest ``doc_id``, a ``row_key``, and what its texts share."""
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("copy_id"),
        F.min("row_key").alias("row_key"),
        F.count(F.lit(1)).alias("n_copies"),
        F.max("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),  # all are equal
    )
    return save(classes, "text-classes")


def _block_pairs(n_blocks: str, block: str):
    """The pairs of blocks that ``block`` takes part in; one block makes a pair with itself."""
    other = F.sequence(F.lit(0).cast("long"), F.col(n_blocks) - 1)
    own = F.col(block)
    pairs = F.transform(other, lambda x: F.struct(F.least(x, own).alias("left"), F.greatest(x, own).alias("right")))
    return F.filter(pairs, lambda pair: (F.col(n_blocks) == 1) | (pair["left"] != pair["right"]))


def candidate_ties(classes: DataFrame) -> DataFrame:
    """``a``, ``b``: digests of classes that meet in a trie and whose signatures agree well enough, as a forest."""
    prefix, width = shortest_prefix(), DEPTH * _VALUE.itemsize
    nodes = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda tree: F.struct(
            tree.alias("tree"),
            F.xxhash64(tree, F.substring("signature", tree * width + 1, F.lit(prefix * _VALUE.itemsize))).alias("node"),
        ),
    )
    paths = classes.select("digest", F.inline(nodes))
    # near copies meet in most tries: of all nodes with the same members one is enough, as their signatures are compared as a whole
    members = [F.bit_xor(F.xxhash64(F.lit(i), "digest")).alias(f"members{i}") for i in range(2)]
    nodes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    shared = nodes.groupBy("n", "members0", "members1").agg(F.min("node").alias("node")).select("node", "n")
    members = paths.join(shared, "node").withColumn("n_blocks", F.ceil(F.col("n") / NODE_BLOCK))
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), "n_blocks"))
    members = members.select("digest", "tree", "node", F.inline(_block_pairs("n_blocks", "block")))
    members = members.join(classes.select("digest", "signature"), "digest")
    return members.groupBy("node", "left", "right").applyInPandas(_tie_node, "a binary, b binary").distinct()


def _tie_node(members: pd.DataFrame) -> pd.DataFrame:
    """Tie the members of a node whose signatures agree, starting from the longest shared prefixes."""
    signed = np.frombuffer(b"".join(members["signature"]), dtype=_VALUE).reshape(len(members), -1)
    tree = int(members["tree"].iloc[0])
    path = signed[:, tree * DEPTH : (tree + 1) * DEPTH]
    order = np.lexsort(path.T[::-1])
    signed, path = signed[order], path[order]
    digests = members["digest"].to_numpy()[order]
    group = np.arange(len(members))
    enough = (THRESHOLD - SLACK) * signed.shape[1]
    for length in range(DEPTH, shortest_prefix() - 1, -1):
        changes = np.flatnonzero((path[1:, :length] != path[:-1, :length]).any(axis=1)) + 1
        bounds = np.concatenate([[0], changes, [len(group)]])
        for start, end in zip(bounds[:-1], bounds[1:]):
            for i in range(start, end):
                others = np.flatnonzero(group[start:end] != group[i]) + start
                if len(others):
                    alike = others[(signed[others] == signed[i]).sum(axis=1) >= enough]
                    tied = np.unique(np.append(group[alike], group[i]))
                    group[np.isin(group, tied)] = tied[0]
    tied = np.flatnonzero(group != np.arange(len(group)))
    return pd.DataFrame({"a": digests[tied], "b": digests[group[tied]]}, dtype=object)


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Saved rows, one a linked class: ``digest``, ``n_links`` (classes it is linked with) and its ``root``."""
    candidates = components(candidate_ties(classes)).select(F.col("vertex").alias("digest"), F.col("root").alias("scope"))
    sized = candidates.join(classes.drop("signature"), "digest")
    scopes = sized.groupBy("scope").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    n_blocks = F.ceil(F.greatest(F.col("n") / PAIR_BLOCK, F.col("total") / PAIR_SHINGLES))
    members = sized.join(scopes, "scope").withColumn("n_blocks", n_blocks)
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), "n_blocks"))
    members = save(members.select("digest", "scope", "row_key", "n_blocks", "block"), "scope-members")
    texts = docs.select(row_key().alias("row_key"), "text").join(measured_broadcast(members), "row_key")
    texts = texts.dropDuplicates(["row_key"])  # a class needs one text; copies are merged before they move

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(text).tobytes() for text in batch.column(0).to_pylist()]
            true = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
            kept = pa.array([a == b for a, b in zip(true, batch.column(1).to_pylist())])  # else the keys only collide
            columns = [batch.column(i) for i in range(1, 5)] + [pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "scope", "n_blocks", "block", "shingles"]).filter(kept)

    sets = texts.select("text", "digest", "scope", "n_blocks", "block").mapInArrow(
        read, "digest binary, scope binary, n_blocks long, block long, shingles binary"
    )
    dealt = sets.select("digest", "scope", "n_blocks", "block", "shingles", F.inline(_block_pairs("n_blocks", "block")))
    compared = dealt.groupBy("scope", "left", "right").applyInPandas(
        _compare, "digest binary, n_links long, tied binary"
    )
    compared = save(compared, "compared")
    roots = components(compared.select(F.col("digest").alias("a"), F.col("tied").alias("b")))
    counted = compared.groupBy("digest").agg(F.sum("n_links").alias("n_links"))
    return save(counted.join(roots.withColumnRenamed("vertex", "digest"), "digest"), "links")


def _compare(members: pd.DataFrame) -> pd.DataFrame:
    """Exact links among the members of two blocks. Pairs within a block count in one of its pairs of blocks only."""
    members = members.drop_duplicates("digest").sort_values("digest", ignore_index=True)
    linked = similar([np.frombuffer(x, dtype=np.uint64) for x in members["shingles"]])
    block = members["block"].to_numpy()
    left, right, n_blocks = (int(members[c].iloc[0]) for c in ("left", "right", "n_blocks"))
    counts = linked & (block[:, None] != block[None, :])
    for b in {left, right}:
        at_home = (b, n_blocks - 1) if b < n_blocks - 1 else (0, n_blocks - 1)
        if (left, right) == at_home:
            counts |= linked & (block[:, None] == b) & (block[None, :] == b)
    n_links = counts.sum(axis=1)
    root = _roots(linked)
    some = np.flatnonzero(linked.any(axis=1))
    digests = members["digest"].to_numpy()
    return pd.DataFrame({"digest": digests[some], "n_links": n_links[some], "tied": digests[root[some]]})


def similar(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of at least ``threshold``; none with itself."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for start in range(0, int(shared.sum()), _COLUMNS):
        first, last = np.searchsorted(column, [start, start + _COLUMNS])
        has = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        has[owner[first:last], column[first:last] - start] = 1
        common += (has @ has.T).astype(np.int64)  # a product counts at most _COLUMNS, which float32 holds exactly
    least = Fraction(threshold).limit_denominator(1000)  # in whole numbers, as pairs may lie at the threshold itself
    close = least.denominator * common >= least.numerator * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(close, False)
    return close


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest index of its component."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _judged(docs: DataFrame) -> DataFrame:
    """Per document its key, ``class_id``, ``copy_id``, ``n_copies``, ``n_links``, and ``class_key``: null if alone."""
    signed = signatures(docs)
    classes = text_classes(signed)
    linked = links(docs, classes).withColumnRenamed("digest", "linked")
    labelled = classes.drop("signature", "row_key").join(linked, F.col("digest") == F.col("linked"), "left")
    labelled = save(labelled.where("n_copies > 1 or linked is not null"), "labelled-classes")
    groups = labelled.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("copy_id").alias("group_id"))
    labelled = labelled.join(measured_broadcast(save(groups, "groups")), F.col("root") == F.col("of"), "left").select(
        F.col("digest").alias("of_digest"),
        "copy_id",
        "n_copies",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("of").isNull(), F.col("copy_id")).otherwise(F.col("group_id")).alias("class_id"),
        F.coalesce("root", "digest").alias("class_key"),
    )
    labelled = measured_broadcast(save(labelled, "document-classes"))
    alone = F.col("of_digest").isNull()
    return signed.drop("signature", "n_shingles").join(labelled, F.col("digest") == F.col("of_digest"), "left").select(
        "doc_id",
        "row_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "class_key",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs`` (``doc_id``, ``text``).

    ``class_id`` is the smallest id among all documents connected by links; ``copy_id`` the smallest among the
    ``n_copies`` with the same shingles; ``n_links`` the number of other texts (not documents) at or over the threshold.
    """
    return _judged(docs).drop("row_key", "class_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class left: the one of smallest id (nulls last), and of equal rows one."""
    grouped = _judged(docs).where(F.col("class_key").isNotNull())
    rows = grouped.groupBy("class_key", "doc_id", "row_key").agg(F.count("*").alias("n"))  # repeated rows meet here
    rows = save(rows, "rows-of-classes")
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    first = rows.groupBy("class_key").agg(F.min(F.struct(last.alias("id"), "row_key")).alias("first"))
    chosen = (last == F.col("first.id")) & (F.col("row_key") == F.col("first.row_key"))
    rows = save(rows.join(first, "class_key").withColumn("chosen", chosen), "chosen-rows")
    kept = join_keys(docs, save(rows.where("not chosen or n > 1").select("doc_id", "row_key"), "left-out"), "left_anti")
    repeated = save(rows.where("chosen and n > 1").select("doc_id", "row_key"), "repeated-rows")
    if repeated.isEmpty():  # no need to read all texts again
        return kept
    return kept.unionByName(join_keys(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
