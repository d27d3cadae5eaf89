"""Appending rows that are not stored yet, without reading the stored rows again.

Beside a table stands one of fingerprints: for each stored row a hash of its columns and the file that holds it, eight
bytes and a name that repeats. An append merges its own copies, looks its hashes up there, and reads only the files that
hold a candidate; candidates are compared column by column, so two rows of equal hash stay two rows. A short batch is sent
to the fingerprints, which are then not shuffled.

Files of the table that have no fingerprints yet, however they were written, are taken in before every append: an append that
died between its two writes is made up for. Fingerprints of files that are no longer served do not count. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.operators.quality import deduplicate
from firstmonth.sources import saved, sinks

_FINGERPRINT, _FILE = "fingerprint", "file"


def append_distinct(
    df: DataFrame, database: str, table: str, ignore_keys: bool = True, broadcast_bytes: int = saved.BROADCAST_BYTES
) -> int:
    """Store the rows of ``df`` that differ from all stored ones and from each other; how many those are.

    Nulls are equal. With ``ignore_keys`` the surrogate key does not count: of copies in the batch the lowest key stays,
    and what is stored stays as it is.
    """
    rows = sinks.aligned(df, database, table)
    ignored = [schemas.SURROGATE_KEYS[table]] if ignore_keys and table in schemas.SURROGATE_KEYS else []
    same = [name for name in rows.columns if name not in ignored]
    refresh(rows.sparkSession, database, table, ignored)
    hashed = deduplicate(rows, ignored).withColumn(_FINGERPRINT, fingerprint(same))
    batch, counts = saved.save(hashed, f"distinct-{table}", n=F.count(F.lit(1)), size=saved.held_bytes(_FINGERPRINT))
    if not counts["n"]:
        return 0
    keys = saved.small(batch.select(_FINGERPRINT).distinct(), counts["size"], broadcast_bytes)
    hits, found = saved.save(
        _fingerprints(rows.sparkSession, database, table, ignored).join(keys, _FINGERPRINT, "left_semi").distinct(),
        f"candidates-{table}",
        size=saved.held_bytes(_FINGERPRINT),
    )
    served = _files(rows.sparkSession, database, table)
    held = hits.select(_FILE).distinct().collect()  # as many as files at most
    files = sorted(served[row[_FILE]] for row in held if row[_FILE] in served)
    new = batch
    if files:
        stored = rows.sparkSession.read.schema(rows.schema).parquet(*files).withColumn(_FINGERPRINT, fingerprint(same))
        wanted = saved.small(hits.select(_FINGERPRINT).distinct(), found["size"], broadcast_bytes)
        candidates = stored.join(wanted, _FINGERPRINT, "left_semi").select(
            F.col(_FINGERPRINT).alias("_known"), F.struct(*same).alias("_row")
        )
        equal = (F.col(_FINGERPRINT) == F.col("_known")) & F.struct(*same).eqNullSafe(F.col("_row"))
        new = batch.join(candidates, equal, "left_anti")
    new, added = saved.save(new.select(*rows.columns), f"new-{table}", n=F.count(F.lit(1)))
    if added["n"]:
        sinks.insert(new, database, table)
        refresh(rows.sparkSession, database, table, ignored)
    return added["n"]


def refresh(spark: SparkSession, database: str, table: str, ignored: list[str]) -> int:
    """Add the fingerprints of files that have none; how many files those are."""
    name = _name(database, table, ignored)
    schema = f"{_FINGERPRINT} bigint, {_FILE} string"
    if not spark.catalog.tableExists(name):
        folder = f"{sinks.location(spark, database)}/{name.rpartition('.')[2]}"
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet LOCATION '{folder}'")
    known = {row[0] for row in spark.table(name).select(_FILE).distinct().collect()}
    missing = sorted(path for file, path in _files(spark, database, table).items() if file not in known)
    if missing:
        target = spark.table(f"{database}.{table}").schema
        same = [f.name for f in target if f.name not in ignored]
        rows = spark.read.schema(target).parquet(*missing)
        rows.select(fingerprint(same).alias(_FINGERPRINT), _short(F.col("_metadata.file_path")).alias(_FILE)).write.mode("append").insertInto(name)
    return len(missing)


def fingerprint(columns: list[str]) -> Column:
    """Hash of the columns in which a null differs from every value, also from the lack of one beside it."""
    parts = reduce(list.__add__, [[F.col(f"`{name}`"), F.col(f"`{name}`").isNull()] for name in columns])
    return F.xxhash64(*parts)


def _fingerprints(spark: SparkSession, database: str, table: str, ignored: list[str]) -> DataFrame:
    return spark.table(_name(database, table, ignored))


def _name(database: str, table: str, ignored: list[str]) -> str:
    return f"{database}.{table}_{'fingerprints_without_key' if ignored else 'fingerprints'}"


def _short(path: Column) -> Column:
    """Version folder and file name: the same however the rest of the address is written."""
    return F.substring_index(path, "/", -2)


def _files(spark: SparkSession, database: str, table: str) -> dict[str, str]:
    """Files of the version that is served: short name to path."""
    spark.catalog.refreshTable(f"{database}.{table}")
    return {"/".join(path.split("/")[-2:]): path for path in spark.table(f"{database}.{table}").inputFiles()}
