"""Benchmark decontamination: n-gram windows of test items, looked up among the windows of all documents.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A window is ``WINDOW``
consecutive words of an item; an item with fewer words, but not none, is one window. The hashes of all windows form
the broadcast set; each window of a document is looked up by its hash. The documents with hits are read again, and the
words of their hit windows compared with the item's. Equal windows of equal length alone count.

Only DataFrame functions are used. The set is broadcast up to a counted number of windows and bytes, joined by a shuffle
beyond. Hash work stays beside the scan; only hits are shuffled.

Null text has no words, so such documents are clean and such items have no windows. Items of null id count as one item
with an empty id. Repeated documents each get their row; repeated items of one id count once. Empty tables give
empty results (no items: every document is clean). Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstmonth.llm.common import join_keys, let, measured_broadcast, row_key, save

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEGMENT = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    known = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(known) == F.char_length(known)
    lower = F.when(ascii_only, F.lower(known)).otherwise(F.translate(known, _UPPER, _LOWER))  # lower() is faster
    return F.array_remove(F.split(lower, _GAPS), "")


def _starts(w: Column, length: int) -> Column:
    """Where windows of ``length`` words begin, from 1."""
    n = F.size(w) - F.lit(length - 1)
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda word: F.xxhash64(word))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Saved rows ``item_id`` (string), ``length``, ``hash`` and ``window`` (words joined by spaces), each once."""

    def windows(w: Column) -> Column:
        length = F.least(F.lit(WINDOW), F.size(w))
        starts = F.when(length >= 1, F.sequence(F.lit(1), F.size(w) - length + 1)).otherwise(F.array().cast("array<int>"))
        return let(
            _hashes(w),
            lambda h: F.transform(
                starts,
                lambda at: F.struct(
                    length.alias("length"),
                    F.xxhash64(F.slice(h, at, length)).alias("hash"),
                    F.array_join(F.slice(w, at, length), " ").alias("window"),
                ),
            ),
        )

    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        let(words(F.col("text")), windows).alias("windows"),
    )
    return save(items.select("item_id", F.inline("windows")).distinct(), "benchmark-windows")


def scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Saved rows of candidate hits: ``doc_id``, ``row_key``, ``n_words``, ``at``, ``length``.

    Each document also has one row of ``length`` 0, so that a single pass counts the words of all documents.
    """
    lengths = [row["length"] for row in windows.select("length").distinct().collect()]  # WINDOW values at most

    def looked_up(w: Column) -> Column:
        def of(h: Column) -> Column:
            def row(length: Column, at: Column, hash_: Column) -> Column:
                return F.struct(length.alias("length"), at.alias("at"), hash_.alias("hash"))

            def of_length(n: int) -> Column:
                return F.transform(
                    _starts(w, n), lambda at: row(F.lit(n), at, F.xxhash64(F.slice(h, at, n)))
                )

            document = F.array(row(F.lit(0), F.lit(0), F.lit(0).cast("long")))
            return F.concat(document, *[of_length(n) for n in sorted(lengths)])

        return F.struct(F.size(w).alias("n_words"), let(_hashes(w), of).alias("windows"))

    scanned = docs.select("doc_id", row_key().alias("row_key"), let(words(F.col("text")), looked_up).alias("w"))
    scanned = scanned.select("doc_id", "row_key", "w.n_words", F.inline("w.windows"))
    every_document = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"))
    known = save(windows.select("hash").union(every_document).distinct(), "window-hashes")
    return save(scanned.join(measured_broadcast(known), "hash").select("doc_id", "row_key", "n_words", "at", "length"), "window-hits")


def verify(docs: DataFrame, windows: DataFrame, scanned: DataFrame) -> DataFrame:
    """Saved rows of documents with true hits: ``doc_id``, ``row_key``, ``hits`` (``at``, ``length``), ``item_ids``."""
    hits = scanned.where("length > 0").select("doc_id", "row_key", "at", "length").distinct()
    hits = hits.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("at", "length")).alias("hits"))
    hits = save(hits, "documents-hit").withColumnsRenamed({"doc_id": "hit_id", "row_key": "hit_key"})
    texts = docs.select("doc_id", row_key().alias("row_key"), "text")
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
    spelled = texts.join(measured_broadcast(hits), on).select(
        "doc_id",
        "row_key",
        F.inline(
            let(
                words(F.col("text")),
                lambda w: F.transform(
                    "hits",
                    lambda x: F.struct(
                        x["at"].alias("at"),
                        x["length"].alias("length"),
                        F.array_join(F.slice(w, x["at"], x["length"]), " ").alias("window"),
                    ),
                ),
            )
        ),
    )
    true = spelled.join(measured_broadcast(windows.select("window", "length", "item_id")), ["window", "length"])
    found = true.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_set(F.struct("at", "length"))).alias("hits"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    return save(found, "documents-contaminated")


def _covered(hits: Column) -> Column:
    """Words under the hits, which are sorted by where they begin; each word counts once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(seen: Column, hit: Column) -> Column:
        end = (hit["at"] + hit["length"]).cast("long")
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(seen["end"], hit["at"].cast("long")))
        return F.struct((seen["n"] + new).alias("n"), F.greatest(seen["end"], end).alias("end"))

    return F.aggregate(hits, start, add, lambda seen: seen["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` words, ``n_items``, ``items_sha256``, ``contaminated``, ``item_ids``."""
    windows = benchmark_windows(benchmark)
    scanned = scan(docs, windows)
    found = verify(docs, windows, scanned).withColumnsRenamed({"doc_id": "hit_id", "row_key": "hit_key"})
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
    joined = scanned.where("length = 0").join(measured_broadcast(found), on, "left")
    items = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(_covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("hits").isNotNull().alias("contaminated"),
        items.alias("item_ids"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean documents, as they are."""
    windows = benchmark_windows(benchmark)
    return join_keys(docs, verify(docs, windows, scan(docs, windows)).select("doc_id", "row_key"), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents; ``text`` without the hit words and what follows each of them up to the next word."""
    windows = benchmark_windows(benchmark)
    found = verify(docs, windows, scan(docs, windows)).select(
        F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "hits"
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("left_id"),
        row_key().alias("left_key"),
    )
    on = F.col("left_id").eqNullSafe(F.col("hit_id")) & (F.col("left_key") == F.col("hit_key"))
    text = F.col("doc.text")

    def hit_words(hits: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1))))

    before = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    segments = F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0))
    gone = F.transform(hit_words(F.col("hits")), lambda at: at - 1)
    kept = let(
        segments,
        lambda all_: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), gone), lambda i: F.get(all_, i)), ""
        ),
    )
    cleaned = F.when(F.col("hits").isNull(), text).otherwise(F.concat(before, kept))
    joined = rows.join(measured_broadcast(found), on, "left")
    return joined.select(F.col("doc").withField("text", cleaned).alias("doc")).select("doc.*")
