"""Appending under the declared constraints: rows that break one are refused and returned, not stored.

A batch is judged once. Row rules (not null, length, domain, dates in order, no negative time) need no shuffle. Where
the batch brings the primary key, equal rows are merged first, so that copies of one row cost one row a task; of the rows
of a key that keep all other rules the first in the order of their columns stays, unless the key is stored already. The
stored table is read for its key column only, against the short list of keys of the batch where that fits the
broadcast bound, so it is not shuffled. The judged batch is written once; rows are counted while it is written.

One writer at a time: two appends that run together do not see each other's keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.operators.quality import broken_rules
from firstmonth.sources import saved, sinks

BROKEN, COPIES = "broken_rules", "copies"


@dataclass(frozen=True)
class Appended:
    """Rows stored and refused; ``rejects`` has each refused row once, its rules and how many copies there were."""

    accepted: int
    rejected: int
    rejects: DataFrame


def append_enforced(df: DataFrame, database: str, table: str, broadcast_bytes: int = saved.BROADCAST_BYTES) -> Appended:
    """Store the rows of ``df`` that keep every constraint of ``table``. A surrogate key the batch does not bring stays null."""
    rows = sinks.aligned(df, database, table)
    key = schemas.PRIMARY_KEYS[table]
    if key in df.columns:
        judged = _judged_by_key(rows, database, table, key, broadcast_bytes)
    else:
        judged = rows.select("*", broken_rules(table).alias(BROKEN), F.lit(1).cast("bigint").alias(COPIES))
    keeps = F.size(BROKEN) == 0
    staged, n = saved.save(
        judged, f"append-{table}", accepted=_total(F.when(keeps, F.col(COPIES))), rejected=_total(F.when(~keeps, F.col(COPIES)))
    )
    if n["accepted"]:
        sinks.insert(staged.where(keeps).select(*rows.columns), database, table)
    return Appended(n["accepted"], n["rejected"], staged.where(~keeps))


def _judged_by_key(rows: DataFrame, database: str, table: str, key: str, broadcast_bytes: int) -> DataFrame:
    others = [name for name in rows.columns if name != key]
    merged = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(COPIES)).withColumn(BROKEN, broken_rules(table))
    candidates = merged.where((F.size(BROKEN) == 0) & F.col(key).isNotNull())
    first, n = saved.save(
        candidates.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*others)).alias("_first")),
        f"keys-{table}",
        size=saved.held_bytes("_key"),
    )
    keys = saved.small(first.select("_key"), n["size"], broadcast_bytes)
    stored = rows.sparkSession.table(f"{database}.{table}").select(F.col(key).alias("_stored"))
    known, m = saved.save(
        stored.join(keys, F.col("_stored") == F.col("_key"), "left_semi").distinct(), f"stored-keys-{table}", size=saved.held_bytes("_stored")
    )
    chosen = first.join(saved.small(known, m["size"], broadcast_bytes), F.col("_key") == F.col("_stored"), "left")
    joined = merged.join(chosen.hint("merge"), F.col(key) == F.col("_key"), "left")
    repeats = F.array(F.lit(f"{key}_unique"))
    nothing = F.array().cast("array<string>")
    stays = F.col("_stored").isNull() & F.struct(*others).eqNullSafe(F.col("_first"))
    one = F.struct(nothing.alias(BROKEN), F.lit(1).cast("bigint").alias(COPIES))
    rest = F.struct(repeats.alias(BROKEN), (F.col(COPIES) - 1).alias(COPIES))
    outcome = (
        F.when((F.size(BROKEN) > 0) | F.col(key).isNull(), F.array(F.struct(BROKEN, COPIES)))
        .when(~stays, F.array(F.struct(repeats.alias(BROKEN), COPIES)))
        .when(F.col(COPIES) > 1, F.array(one, rest))
        .otherwise(F.array(one))
    )
    return joined.select(*rows.columns, F.inline(outcome))


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))
