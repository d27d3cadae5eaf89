"""Audit, deduplication and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.sources.tables import Tables


def deduplicate(df: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """One row per distinct row; nulls are equal.

    Copies are merged before the shuffle, so a large group of them costs one row per task. With
    ``ignore`` the named key columns do not count and the lowest key of each group is kept.
    """
    ignore = [name for name in ignore or [] if name in df.columns]
    if not ignore:
        return df.distinct()
    same = [name for name in df.columns if name not in ignore]
    return df.groupBy(*same).agg(F.min(F.struct(*ignore)).alias("_key")).select(
        *[F.col(f"_key.{name}").alias(name) if name in ignore else name for name in df.columns]
    )


def audit_by_table(tables: Tables, ignore_keys: bool = False) -> DataFrame:
    """Counts per table. Missing employees are counted before deduplication, bad values after it.

    With ``ignore_keys`` rows that differ in their surrogate key only are copies, as for cleaning.
    """
    parts = []
    for name, df in tables.items():
        ignored = [schemas.SURROGATE_KEYS[name]] if ignore_keys and name in schemas.SURROGATE_KEYS else []
        parts.append(_audit_table(df.drop(*ignored), name))
    return reduce(DataFrame.unionByName, parts)


def audit(tables: Tables, ignore_keys: bool = False) -> DataFrame:
    """One row of counts over all three tables."""
    return audit_totals(audit_by_table(tables, ignore_keys))


def audit_warnings(tables: Tables) -> DataFrame:
    """One line of text per table and finding."""
    return warning_lines(audit_by_table(tables))


def audit_totals(by_table: DataFrame) -> DataFrame:
    return by_table.agg(*[F.sum(name).alias(name) for name in by_table.columns if name != "table_name"])


def warning_lines(by_table: DataFrame) -> DataFrame:
    # The wording of the two warnings.
    missing = F.format_string(
        "Found %d missing employee_ids in table '%s'.", F.col("missing_employee_ids"), F.col("table_name")
    )
    duplicates = F.format_string(
        "Deduplicated %d duplicate records from '%s'.", F.col("duplicate_records"), F.col("table_name")
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("missing_employee_ids") > 0, missing),
            F.when(F.col("duplicate_records") > 0, duplicates),
        )
    )
    return by_table.select("table_name", F.explode(found).alias("warning"))


def _audit_table(df: DataFrame, table: str) -> DataFrame:
    # A distinct row with its number of copies answers all four questions in one pass.
    distinct_rows = df.groupBy(*[F.col(f"`{name}`") for name in df.columns]).agg(
        F.count(F.lit(1)).alias("_copies")
    )

    def total(condition: Column, n: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    copies, nothing = F.col("_copies"), F.lit(0).cast("bigint")
    has_employee = "employee_id" in df.columns
    inverted = negative = nothing
    if table == schemas.ONBOARDING and {"start_date", "completion_date"} <= set(df.columns):
        start, completion = (F.col(c).try_cast("timestamp_ntz") for c in ("start_date", "completion_date"))
        inverted = F.count_if(completion < start)
    if table == schemas.SUPPORT_REQUESTS and "resolution_time" in df.columns:
        negative = F.count_if(F.col("resolution_time").try_cast("double") < 0)
    return distinct_rows.agg(
        (total(F.col("employee_id").isNull(), copies) if has_employee else nothing).alias("missing_employee_ids"),
        total(copies > 1, copies - 1).alias("duplicate_records"),
        inverted.alias("invalid_timestamps"),
        negative.alias("negative_resolution_times"),
    ).select(F.lit(table).alias("table_name"), "*")


def constraint_rules(table: str) -> dict[str, Column]:
    """Rule name to the condition under which a row breaks it. A null breaks only NOT NULL rules."""
    rules = {f"{name}_not_null": F.col(name).isNull() for name in schemas.NOT_NULL[table]}
    for name, length in schemas.MAX_LENGTH[table].items():
        rules[f"{name}_max_length"] = F.char_length(name) > length
    if table == schemas.ONBOARDING:
        rules["stage_status_domain"] = ~F.col("stage_status").isin(schemas.STAGE_STATUSES)
        rules["completion_not_before_start"] = F.col("completion_date") < F.col("start_date")
    if table == schemas.TOOL_USAGE:
        rules["usage_status_domain"] = ~F.col("usage_status").isin(schemas.USAGE_STATUSES)
    if table == schemas.SUPPORT_REQUESTS:
        rules["request_status_domain"] = ~F.col("request_status").isin(schemas.REQUEST_STATUSES)
        rules["resolution_time_not_negative"] = F.col("resolution_time") < 0
    return rules


def constraint_violations(tables: Tables) -> DataFrame:
    """Rows that break each declared constraint, one line per table and rule."""
    reports = []
    for table, df in tables.items():
        rules = constraint_rules(table)
        counts = df.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
        reports.append(_long(counts, table))
        key = schemas.PRIMARY_KEYS[table]
        if key in df.columns:
            per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            repeats = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"{key}_unique")
            reports.append(_long(per_key.agg(repeats), table))
    return reduce(DataFrame.unionByName, reports)


def broken_rules(table: str) -> Column:
    """Names of the row-level constraints that a row breaks."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition in constraint_rules(table).items()]))


def split_violations(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every row-level constraint, and the others with the names of the broken rules."""
    checked = df.withColumn("broken_rules", broken_rules(table))
    clean = F.size("broken_rules") == 0
    return checked.filter(clean).drop("broken_rules"), checked.filter(~clean)


def _long(counts: DataFrame, table: str) -> DataFrame:
    return counts.unpivot([], counts.columns, "rule", "violations").select(
        F.lit(table).alias("table_name"), "rule", F.col("violations").cast("bigint").alias("violations")
    )
