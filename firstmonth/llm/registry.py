"""Registered queries of this package and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firstmonth.llm import (
    decontaminate,
    filter_audit,
    host_quality,
    huffman,
    langid,
    line_dedup,
    lsh_forest,
    oracle,
    packing,
    secret_scan,
    token_counts,
    url_filter,
    vector_codes,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages and documents, by all evidence there is for them."""
    documents, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    rows = langid.page_rows(pages).unionByName(langid.document_rows(documents))
    return langid.identify(rows, langid.train(documents))


def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents to Huffman files and decode them."""
    return huffman.read_archive(spark, huffman.write_archive(_table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts in all documents."""
    return secret_scan.scan(_table(spark, sf_dir, "documents")).drop("links")


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return host_quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents."""
    return token_counts.length_histogram(token_counts.token_lengths(_table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the addresses of all pages."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to web archives and read them back by byte ranges."""
    return warc.read(spark, warc.write(_table(spark, sf_dir, "pages")))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents."""
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of five filters over all documents, in all orders."""
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share."""
    documents = _table(spark, sf_dir, "documents")
    return line_dedup.digests(documents, line_dedup.keep_bitmaps(documents))


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_huffman": op2_huffman,
        "op3_secret_scan": op3_secret_scan,
        "op4_host_quality": op4_host_quality,
        "op5_decontamination": op5_decontamination,
        "op6_token_counts": op6_token_counts,
        "op7_url_filter": op7_url_filter,
        "op8_packing": op8_packing,
        "op9_warc": op9_warc,
        "op10_lsh_forest": op10_lsh_forest,
        "op11_filter_audit": op11_filter_audit,
        "op12_vector_codes": op12_vector_codes,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
