"""Batch entry point: ``python -m firstmonth <command>`` or through spark-submit.

import   validate a CSV upload and put it in the place of a stored table
append   validate a CSV upload and add the rows that keep all constraints; the others are written to a folder
clean    remove versions of replaced tables that are older than some hours
report   write the audit and every frame of the six dashboard pages as Parquet
sql      run one query over the tables and the four views, values bound by name
"""

from __future__ import annotations

import argparse
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession

from firstmonth import schemas
from firstmonth.operators.kept_day_zero import STATE
from firstmonth.operators.views import register_catalog_views
from firstmonth.plans.dashboard import build_dashboard
from firstmonth.session import build_session
from firstmonth.sources import sinks
from firstmonth.sources.enforced import append_enforced
from firstmonth.sources.tables import load_catalog_tables, register_tables, run_sql
from firstmonth.sources.uploads import read_upload


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    options = _parser().parse_args(arguments)
    spark = spark or build_session(f"firstmonth-{options.command}")
    sinks.create_tables(spark, options.database)
    if options.command == "import":
        sinks.replace_table(read_upload(spark, options.csv, options.table), options.database, options.table)
    elif options.command == "append":
        result = append_enforced(read_upload(spark, options.csv, options.table), options.database, options.table)
        print(f"{result.accepted} rows stored, {result.rejected} refused.")
        result.rejects.write.parquet(options.refused)
    elif options.command == "clean":
        for table in (*schemas.TABLE_NAMES, STATE):
            if spark.catalog.tableExists(f"{options.database}.{table}"):
                print(f"{sinks.remove_old_versions(spark, options.database, table, options.hours)} old versions of {table} removed.")
    elif options.command == "report":
        report(spark, options.database, options.out, options.stage, options.ignore_keys)
    elif options.command == "sql":
        tables = load_catalog_tables(spark, options.database)
        register_tables(tables)
        register_catalog_views(spark, options.database)
        run_sql(spark, options.query, dict(map(typed_parameter, options.param))).write.parquet(options.out)


def typed_parameter(text: str) -> tuple[str, Any]:
    """``NAME=VALUE`` binds text, ``NAME:type=VALUE`` a value of one of ``TYPES``; an empty typed value is null."""
    name, equals, value = text.partition("=")
    name, _, kind = name.partition(":")
    if not equals or not name or (kind and kind not in TYPES):
        raise ValueError(f"Parameters are NAME=VALUE or NAME:type=VALUE with a type of {sorted(TYPES)}, not {text!r}.")
    return name, (TYPES[kind](value) if value else None) if kind else value


def _truth(value: str) -> bool:
    if value.lower() not in ("true", "false"):
        raise ValueError(f"true or false, not {value!r}.")
    return value.lower() == "true"


TYPES = {
    "int": int, "float": float, "decimal": Decimal, "bool": _truth, "date": date.fromisoformat,
    "timestamp": datetime.fromisoformat, "text": str,
}


def report(spark: SparkSession, database: str, out: str, stage: str | None = None, ignore_keys: bool = False) -> None:
    """One folder per frame. Nothing is written when all tables are empty."""
    board = build_dashboard(load_catalog_tables(spark, database), stage, ignore_keys)
    if board is None:
        print("No rows in any of the three tables.")
        return
    board.audit.write.parquet(f"{out}/audit")
    board.audit_warnings.write.parquet(f"{out}/audit_warnings")
    board.stage_list.write.parquet(f"{out}/stage_list")
    for page, frames in board.pages.items():
        for name, df in frames.items():
            df.write.parquet(f"{out}/{page}/{name}")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="firstmonth", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    upload, append = commands.add_parser("import"), commands.add_parser("append")
    for command in (upload, append):
        command.add_argument("--table", choices=schemas.TABLE_NAMES, required=True)
        command.add_argument("--csv", required=True)
    append.add_argument("--refused", required=True, help="folder for refused rows")
    clean = commands.add_parser("clean")
    clean.add_argument("--hours", type=float, default=24.0, help="longer than any query runs")
    pages = commands.add_parser("report")
    pages.add_argument("--stage", help="only employees seen at this onboarding stage")
    pages.add_argument("--ignore-keys", action="store_true", help="rows that differ in their key only are copies")
    query = commands.add_parser("sql")
    query.add_argument("--query", required=True)
    query.add_argument("--param", action="append", default=[], metavar="NAME[:type]=VALUE")
    for command in (pages, query):
        command.add_argument("--out", required=True)
    for command in (upload, append, clean, pages, query):
        command.add_argument("--database", default="default", help="catalog database that holds the tables")
    return parser


if __name__ == "__main__":
    main()
