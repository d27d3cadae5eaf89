"""Token counts: an exact length histogram that answers totals, quantiles and truncated totals for every context limit.

Documents are aggregated by encoded length; everything else comes from sums over the histogram. The suffix sums
work in two levels (blocks of lengths, then lengths within a block), so no task holds the whole histogram.

Null text counts as empty (length 0, or 1 with an end id). Repeated rows count as often as they occur. An empty
table gives an empty histogram. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstmonth.llm.common import save, sliced
from firstmonth.llm.tokens import ID_TYPE, encoder, tokenizer_path

#: Lengths that one task adds up; the blocks before or after it come as sums.
BLOCK = 4096


def token_lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """One row for each document: ``length``, the number of its token ids."""
    path = path or tokenizer_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in sliced(batches):
            texts = [x or "" for x in batch.column(0).to_pylist()]
            n = np.array([len(x) // ID_TYPE.itemsize for x in encode(texts)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n)], ["length"])

    return docs.select(F.col(text)).mapInArrow(lengths, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """For each length that occurs, the answers for a context limit of that many tokens.

    Columns: ``length``; ``n_docs`` of that length; ``docs_up_to`` and ``tokens_up_to`` it; ``docs_over`` and
    ``tokens_over`` beyond it (suffix sums); ``truncated_total``, the tokens left if every document is cut to
    ``length``; ``quantile``, the share of documents that fit uncut.
    """
    counts = save(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "length-counts")
    counts = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn(
        "tokens", F.col("length") * F.col("n_docs")
    )
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        _or_zero(F.sum("block_docs").over(later)).alias("later_docs"),
        _or_zero(F.sum("block_tokens").over(later)).alias("later_tokens"),
        F.sum("block_docs").over(Window.partitionBy()).alias("all_docs"),
        F.sum("block_tokens").over(Window.partitionBy()).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    suffix = counts.join(blocks, "block").select(
        "length",
        "n_docs",
        "all_docs",
        "all_tokens",
        (_or_zero(F.sum("n_docs").over(longer)) + F.col("later_docs")).alias("docs_over"),
        (_or_zero(F.sum("tokens").over(longer)) + F.col("later_tokens")).alias("tokens_over"),
    )
    return suffix.select(
        "length",
        "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_up_to"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_up_to"),
        "docs_over",
        "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit``, ``total``: tokens of all documents cut to each limit, also for limits that no document has.

    The number of limits is the caller's; the histogram is read once.
    """
    total = [
        F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias(str(limit))
        for limit in limits
    ]
    sums = histogram.agg(*total)
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("limit"), F.col(str(x)).alias("total")) for x in limits])
    return sums.select(F.inline(rows))


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """``length``: the smallest one that at least ``share`` of the documents do not exceed; null if there are none."""
    return histogram.where(F.col("quantile") >= F.lit(share)).agg(F.min("length").alias("length"))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))
