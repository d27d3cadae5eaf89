"""The bundle of three tables: loading, conforming to the declared types, and SQL access."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstmonth import schemas
from firstmonth.functions.predicates import blank_to_null, moment_or_raise, number_or_null


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


@dataclass(frozen=True)
class Tables:
    """Onboarding progress, tool usage and support requests, in any stage of processing."""

    onboarding: DataFrame
    tool_usage: DataFrame
    support_requests: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in schemas.TABLE_NAMES]

    def has_rows(self) -> bool:
        """False when all three tables are empty and there is nothing to analyse."""
        return any(not df.isEmpty() for _, df in self.items())


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast known columns to their declared types and add absent optional ones with their defaults.

    Columns the schema does not know stay as they are. Bad date text raises; a resolution time that
    is not a number becomes null.
    """
    fields = {field.name: field.dataType for field in schemas.SCHEMAS[table]}
    defaults = schemas.OPTIONAL_DEFAULTS[table]
    types = {field.name: field.dataType for field in df.schema}
    if all(fields.get(name, kind) == kind for name, kind in types.items()) and set(defaults) <= set(types):
        return df
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"Times are stored in UTC; set spark.sql.session.timeZone to UTC, not {zone}.")
    columns = []
    for name in df.columns:
        column = F.col(f"`{name}`")
        is_text = isinstance(types[name], T.StringType)
        if name == "resolution_time" and is_text:
            column = number_or_null(column)
        elif isinstance(fields.get(name), T.TimestampNTZType) and is_text:
            column = moment_or_raise(column)
        elif name in fields and is_text and not isinstance(fields[name], T.StringType):
            column = blank_to_null(column).cast(fields[name])
        elif name in fields:
            column = column.cast(fields[name])
        columns.append(column.alias(name))
    for name, default in defaults.items():
        if name not in types:
            columns.append(F.lit(default).cast(fields[name]).alias(name))
    return df.select(*columns)


def load_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One Parquet table in its declared types. A missing path fails, it is not read as empty."""
    return conform(spark.read.parquet(path), table)


def load_tables(spark: SparkSession, root: str) -> Tables:
    """All three tables from ``root/<table>``."""
    return Tables(*(load_table(spark, name, f"{root}/{name}") for name in schemas.TABLE_NAMES))


def load_catalog_tables(spark: SparkSession, database: str) -> Tables:
    """All three tables from a catalog database."""
    return Tables(*(conform(spark.table(f"{database}.{name}"), name) for name in schemas.TABLE_NAMES))


def load_jdbc_table(
    spark: SparkSession,
    table: str,
    url: str,
    properties: Mapping[str, str],
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 32,
    single_task: bool = False,
    predicates: list[str] | None = None,
) -> DataFrame:
    """One table of an operational database, read in parallel ranges of a numeric key, or one task for each of ``predicates``.

    ``moment_ranges`` and ``hash_parts`` make predicates for tables without a numeric key. Bounds that are not given come from
    one ``min``/``max`` query. Reading all of it in one task has to be asked for.
    """
    if single_task:
        return conform(_jdbc(spark, url, table, properties, {}).load(), table)
    if predicates:
        options = {"preferTimestampNTZ": "true", **properties}
        return conform(spark.read.jdbc(url, table, predicates=predicates, properties=options), table)
    if not partition_column:
        raise ValueError(f"Name a numeric key of {table} to read it in parallel, or ask for a single task.")
    if lower is None or upper is None:
        query = f"(select min({partition_column}) as low, max({partition_column}) as high from {table}) bounds"
        found = _jdbc(spark, url, query, properties, {}).load().first()
        lower = found["low"] if lower is None else lower
        upper = found["high"] if upper is None else upper
    return conform(_jdbc(spark, url, table, properties, range_options(partition_column, lower, upper, partitions)).load(), table)


def range_options(partition_column: str, lower: int | None, upper: int | None, partitions: int) -> dict[str, Any]:
    """Options for a read in ``partitions`` ranges; a key with one value or none needs a single range."""
    if lower is None or upper is None or lower == upper:
        return {}
    if lower > upper or partitions < 1:
        raise ValueError(f"No ranges from {lower} to {upper} in {partitions} parts.")
    return {
        "partitionColumn": partition_column,
        "lowerBound": int(lower),
        "upperBound": int(upper) + 1,
        "numPartitions": partitions,
    }


def moment_ranges(column: str, lower: date, upper: date, partitions: int) -> list[str]:
    """Predicates over equal spans from ``lower`` to ``upper``, both dates or both datetimes; every row fits exactly one.

    Rows before, after and without a value belong to the first and the last of them.
    """
    if lower > upper or partitions < 1:
        raise ValueError(f"No ranges from {lower} to {upper} in {partitions} parts.")
    kind = "TIMESTAMP" if isinstance(lower, datetime) else "DATE"
    bounds = sorted({lower + (upper - lower) * i / partitions for i in range(1, partitions)} - {lower})
    bounds = [f"{kind} '{b.isoformat(*([' '] if kind == 'TIMESTAMP' else []))}'" for b in bounds]
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *inner, f"{column} >= {bounds[-1]}"]


#: Part number of a text key, by the database that evaluates it.
TEXT_HASH = {
    "postgresql": "mod(abs(hashtext({column})::bigint), {n})",
    "mysql": "mod(crc32({column}), {n})",
    "sqlserver": "abs(cast(checksum({column}) as bigint)) % {n}",
    "oracle": "ora_hash({column}, {n} - 1)",
}


def hash_parts(column: str, partitions: int, text_hash: str = TEXT_HASH["postgresql"]) -> list[str]:
    """Predicates that deal the rows by the hash of a text key; every row fits exactly one, those without a key the first.

    A database may hash a missing key to a number as well, hence the test for it in all parts.
    """
    if partitions < 1:
        raise ValueError(f"No rows in {partitions} parts.")
    number = text_hash.format(column=column, n=partitions)
    return [f"{column} IS NULL OR {number} = 0", *[f"{column} IS NOT NULL AND {number} = {i}" for i in range(1, partitions)]]


def _jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str], ranges: Mapping[str, Any]) -> DataFrameReader:
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, preferTimestampNTZ="true", **properties)
    return reader.options(**ranges)


def register_tables(tables: Tables) -> None:
    """Make the three tables available to SQL under their own names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """SQL over the registered tables; values are bound to ``:name`` markers, never pasted in."""
    return spark.sql(sql, args=dict(params or {}))
