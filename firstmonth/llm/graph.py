"""Connected components by alternating stars, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """``vertex``, ``root`` (the smallest vertex of its component) of all ends of ``edges`` (``a``, ``b``), saved.

    Each round ties all larger neighbours of a vertex to its smallest neighbour, then all smaller ones, until nothing
    changes; the number of rounds grows with the logarithm of the longest path. Minima are taken map-side first, so a
    vertex of any degree is one row a task. Edges stay linear in number. Equal ends and repeated edges do no harm.
    """
    current = save(edges.where("a != b").select("a", "b").distinct(), "edges")
    before = None
    while (mark := _mark(current)) != before:
        before = mark
        current = save(_tie_smaller(_tie_larger(current)), "edges")
    # now every edge leads from a vertex to its root
    roots = current.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return save(roots.unionByName(roots.select(F.col("root").alias("vertex"), "root").distinct()), "components")


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the edges as larger and smaller end."""
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")))
    ).first()
    return tuple(row)


def _tie_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _tie_smaller(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(smallest.withColumnRenamed("m", "b")).distinct()
