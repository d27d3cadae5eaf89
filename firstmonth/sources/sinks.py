"""Creating, appending to, replacing and clearing the stored tables (Parquet tables of the catalog)."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firstmonth import schemas
from firstmonth.sources.tables import conform


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the three tables where absent, each in its own folder of the database."""
    root = location(spark, database)
    for table in schemas.TABLE_NAMES:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SCHEMAS[table])
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet LOCATION '{_folder(root, table)}'"
        )


def aligned(df: DataFrame, database: str, table: str) -> DataFrame:
    """Rows in the columns of the stored table; optional ones that ``df`` lacks get their defaults, a key stays null."""
    target = df.sparkSession.table(f"{database}.{table}").schema
    rows = conform(df, table)
    unknown = [name for name in rows.columns if name not in target.names]
    if unknown:
        raise ValueError(f"Table '{table}' has no column(s) {unknown}.")
    columns = [
        (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in target
    ]
    return rows.select(*columns)


def insert(rows: DataFrame, database: str, table: str) -> None:
    """Add rows that have the columns of the stored table."""
    _by_date(rows, table).write.mode("append").insertInto(f"{database}.{table}")


def append_rows(df: DataFrame, database: str, table: str) -> None:
    """Add rows by column name, whatever constraints they break; ``enforced.append_enforced`` refuses those."""
    insert(aligned(df, database, table), database, table)


def replace_table(df: DataFrame, database: str, table: str) -> None:
    """Put ``df`` in the place of the table, columns included.

    The rows are written to a folder of their own, a version. With the same columns the table is pointed at it in one
    catalog call. With others a table is created beside the old one and takes its name by renaming; if that fails the old one
    gets its name back. Until then readers see the old rows, so ``df`` may be derived from the table itself. Old versions
    stay until ``remove_old_versions``, as running queries may read them.
    """
    spark = df.sparkSession
    folder = _folder(location(spark, database), table)
    _by_date(df, table).write.parquet(folder)
    name = f"{database}.{table}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{folder}'")
    elif _same_columns(spark.table(name).schema, df.schema):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
    else:
        mark = uuid.uuid4().hex
        spark.sql(f"CREATE TABLE {name}_new_{mark} USING parquet LOCATION '{folder}'")
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old_{mark}")
        try:
            spark.sql(f"ALTER TABLE {name}_new_{mark} RENAME TO {name}")
        except Exception:
            spark.sql(f"ALTER TABLE {name}_old_{mark} RENAME TO {name}")
            raise
        spark.sql(f"DROP TABLE {name}_old_{mark}")  # the catalog entry; its files are an old version
    spark.catalog.refreshTable(name)


def remove_old_versions(spark: SparkSession, database: str, table: str, hours: float = 24.0) -> int:
    """Delete versions of the table that are not served and were last written more than ``hours`` ago; how many there were.

    Choose more hours than the longest query runs.
    """
    context = spark.sparkContext
    served = _served_folder(spark, database, table)
    root = context._jvm.org.apache.hadoop.fs.Path(location(spark, database))
    system = root.getFileSystem(context._jsc.hadoopConfiguration())
    before = (time.time() - hours * 3600) * 1000
    removed = 0
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if re.fullmatch(rf"{re.escape(table)}-[0-9a-f]{{32}}", name) and name != served and status.getModificationTime() <= before:
            removed += bool(system.delete(status.getPath(), True))
    return removed


def _served_folder(spark: SparkSession, database: str, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{table}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"].rstrip("/").rpartition("/")[2]


def _same_columns(left: StructType, right: StructType) -> bool:
    return [(f.name, f.dataType) for f in left] == [(f.name, f.dataType) for f in right]


def clear_tables(spark: SparkSession, database: str) -> None:
    """Leave all tables that exist empty, with the columns they have."""
    for table in schemas.TABLE_NAMES:
        if spark.catalog.tableExists(f"{database}.{table}"):
            current = spark.table(f"{database}.{table}")
            replace_table(spark.createDataFrame([], current.schema), database, table)


def _by_date(df: DataFrame, table: str) -> DataFrame:
    """Rows of each file in date order, so that scans with date bounds skip row groups. No shuffle."""
    date_column = schemas.EVENT_DATE.get(table)
    return df.sortWithinPartitions(date_column) if date_column in df.columns else df


def location(spark: SparkSession, database: str) -> str:
    return spark.catalog.getDatabase(database).locationUri


def _folder(root: str, table: str) -> str:
    return f"{root}/{table}-{uuid.uuid4().hex}"
