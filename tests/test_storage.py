"""What is stored, refused and served: constraints, versions, kept state."""

from __future__ import annotations

import uuid
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from helpers import day, moment, onboarding, support, tables, tool_usage
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.__main__ import main, typed_parameter
from firstmonth.operators import cohort_friction, friction, kept_day_zero, views
from firstmonth.plans.first_month import prepare
from firstmonth.sources import enforced, fingerprints, saved, sinks
from firstmonth.sources.event_mapping import map_events, read_events
from firstmonth.sources.tables import hash_parts, moment_ranges, run_sql


@pytest.fixture
def database(spark, tmp_path):
    name = f"test_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    sinks.create_tables(spark, name)
    return name


def rejects(result, key):
    return {(r[key], r.employee_id, tuple(r.broken_rules), r.copies) for r in result.rejects.collect()}


# constraints


def test_broken_rows_are_returned_and_not_stored(spark, database):
    rows = support(
        spark,
        ("a", "e1", "C", moment(0), "Resolved", 1.0),
        ("b", None, "C", moment(0), "Resolved", 1.0),
        ("c", "e1", "C", moment(0), "Lost", -1.0),
        (None, "e1", "C", moment(0), "Resolved", None),
        ("x" * 51, "e1", "C", moment(0), "Pending", None),
    )
    result = enforced.append_enforced(rows, database, schemas.SUPPORT_REQUESTS)
    assert (result.accepted, result.rejected) == (1, 4)
    assert [r.request_id for r in spark.table(f"{database}.support_requests").collect()] == ["a"]
    assert rejects(result, "request_id") == {
        ("b", None, ("employee_id_not_null",), 1),
        ("c", "e1", ("request_status_domain", "resolution_time_not_negative"), 1),
        (None, "e1", ("request_id_not_null",), 1),
        ("x" * 51, "e1", ("request_id_max_length",), 1),
    }


@pytest.mark.parametrize("broadcast_bytes", [saved.BROADCAST_BYTES, 0])
def test_a_key_is_stored_once(spark, database, broadcast_bytes):
    def request(key, employee, status="Pending"):
        return (key, employee, "C", moment(0), status, None)

    def append(*rows):
        return enforced.append_enforced(support(spark, *rows), database, schemas.SUPPORT_REQUESTS, broadcast_bytes)

    first = append(request("a", "e2"), request("a", "e1"), request("a", "e1"), request("b", "e0", "Lost"), request("b", "e5"))
    unique = ("request_id_unique",)
    assert (first.accepted, first.rejected) == (2, 3)
    assert rejects(first, "request_id") == {("a", "e2", unique, 1), ("a", "e1", unique, 1), ("b", "e0", ("request_status_domain",), 1)}
    second = append(request("a", "e0"), request("b", "e5"), request("c", "e1"), *[request("d", "e1")] * 500)
    assert rejects(second, "request_id") == {("a", "e0", unique, 1), ("b", "e5", unique, 1), ("d", "e1", unique, 499)}
    stored = {(r.request_id, r.employee_id) for r in spark.table(f"{database}.support_requests").collect()}
    assert stored == {("a", "e1"), ("b", "e5"), ("c", "e1"), ("d", "e1")}
    assert second.accepted == 2 and append().accepted == 0


def test_copies_without_a_key_are_rows_of_their_own(spark, database):
    rows = tool_usage(spark, *[("e", "Wiki", moment(1), "Success")] * 3, ("e", "Wiki", moment(1), "Odd"), ("e", "Wiki", moment(1), None))
    result = enforced.append_enforced(rows.drop("usage_activity"), database, schemas.TOOL_USAGE)
    assert (result.accepted, result.rejected) == (4, 1)
    assert {r.usage_activity for r in spark.table(f"{database}.tool_usage").collect()} == {"General Activity"}
    with pytest.raises(ValueError, match="no column"):
        enforced.append_enforced(rows.withColumn("team", F.lit(1)), database, schemas.TOOL_USAGE)


def test_stored_keys_are_not_shuffled_for_a_short_batch(spark, database, monkeypatch):
    rows = support(spark, ("a", "e", "C", moment(0), "Pending", None))
    enforced.append_enforced(rows, database, schemas.SUPPORT_REQUESTS)
    plans = []
    original = saved.save
    monkeypatch.setattr(saved, "save", lambda df, *a, **k: plans.append(df) or original(df, *a, **k))
    enforced.append_enforced(rows, database, schemas.SUPPORT_REQUESTS)
    text = plans[1]._jdf.queryExecution().executedPlan().toString()  # the stored keys of the batch
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "ReadSchema: struct<request_id:string>" in text


# versions


def names(spark, database):
    return Counter(r.onboarding_stage for r in spark.table(f"{database}.onboarding").collect())


def stages(spark, *values):
    return onboarding(spark, *[("e", v, "Completed", day(0), None) for v in values])


def with_key(df):
    return df.select(F.lit(1).cast("bigint").alias("onboarding_id"), "*")


def test_replacing_with_the_same_columns_is_one_catalog_call(spark, database, monkeypatch):
    sinks.replace_table(with_key(stages(spark, "old")), database, schemas.ONBOARDING)
    calls, original = [], spark.sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: calls.append(text) or original(text, *a, **k))
    sinks.replace_table(with_key(stages(spark, "new")), database, schemas.ONBOARDING)
    monkeypatch.undo()
    assert len(calls) == 1 and calls[0].startswith("ALTER TABLE")
    assert names(spark, database) == {"new": 1}
    sinks.append_rows(with_key(stages(spark, "more")), database, schemas.ONBOARDING)
    assert names(spark, database) == {"new": 1, "more": 1}


@pytest.mark.parametrize("failing", ["CREATE TABLE", "RENAME TO {name}_old", "RENAME TO {name}\n"])
def test_old_rows_are_served_when_a_replacement_fails(spark, database, monkeypatch, failing):
    sinks.replace_table(stages(spark, "old"), database, schemas.ONBOARDING)
    original = spark.sql
    failing = failing.format(name=f"{database}.onboarding")
    state = {"left": 1}

    def sql(self, text, *args, **kwargs):
        if failing in text + "\n" and state["left"]:
            state["left"] = 0
            raise RuntimeError("catalog down")
        return original(text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", sql)
    wider = stages(spark, "new").withColumn("team", F.lit("x"))
    with pytest.raises(RuntimeError, match="catalog down"):
        sinks.replace_table(wider, database, schemas.ONBOARDING)
    assert names(spark, database) == {"old": 1}
    monkeypatch.undo()
    sinks.replace_table(wider, database, schemas.ONBOARDING)
    assert names(spark, database) == {"new": 1} and "team" in spark.table(f"{database}.onboarding").columns


def test_a_table_may_be_replaced_by_its_own_rows(spark, database):
    sinks.replace_table(stages(spark, "a", "b"), database, schemas.ONBOARDING)
    sinks.replace_table(spark.table(f"{database}.onboarding").where("onboarding_stage = 'a'"), database, schemas.ONBOARDING)
    assert names(spark, database) == {"a": 1}


def test_old_versions_go_when_they_are_old_enough(spark, database):
    for value in ("a", "b", "c"):
        sinks.replace_table(stages(spark, value), database, schemas.ONBOARDING)
    sinks.replace_table(tool_usage(spark, ("e", "Wiki", moment(0), "Success")), database, schemas.TOOL_USAGE)
    assert sinks.remove_old_versions(spark, database, schemas.ONBOARDING) == 0  # all written just now
    assert sinks.remove_old_versions(spark, database, schemas.ONBOARDING, hours=0) >= 2
    assert names(spark, database) == {"c": 1} and spark.table(f"{database}.tool_usage").count() == 1
    assert sinks.remove_old_versions(spark, database, schemas.ONBOARDING, hours=0) == 0


def test_only_the_own_run_is_discarded(spark):
    kept, counts = saved.save(spark.range(3), "numbers", n=F.count(F.lit(1)), size=saved.held_bytes("id"))
    assert kept.count() == counts["n"] == 3 and counts["size"] == 3 * (2 + 192)
    assert spark.sparkContext.applicationId in saved.run_folder(spark) and kept.inputFiles()[0].find(saved.run_folder(spark)) >= 0


# duplicates against stored rows


def used(spark, *rows):
    """(key, employee, tool)"""
    table = tool_usage(spark, *[(e, t, moment(1), "Success") for _, e, t in rows])
    keys = spark.createDataFrame([(k, e, t) for k, e, t in rows], "usage_id bigint, employee_id string, tool_name string")
    return keys.join(table.distinct(), [keys.employee_id.eqNullSafe(table.employee_id), keys.tool_name == table.tool_name]).select(
        "usage_id", *[table[c] for c in table.columns]
    )


def kept(spark, database):
    return sorted((r.usage_id, r.employee_id, r.tool_name) for r in spark.table(f"{database}.tool_usage").collect())


@pytest.mark.parametrize("broadcast_bytes", [saved.BROADCAST_BYTES, 0])
def test_copies_of_stored_rows_are_not_stored(spark, database, broadcast_bytes):
    def append(*rows, **options):
        return fingerprints.append_distinct(used(spark, *rows), database, schemas.TOOL_USAGE, broadcast_bytes=broadcast_bytes, **options)

    assert append((5, "a", "T"), (3, "a", "T"), (4, "b", "T")) == 2
    assert append((1, "a", "T"), (9, "c", "T"), (8, "b", "T")) == 1
    assert kept(spark, database) == [(3, "a", "T"), (4, "b", "T"), (9, "c", "T")]
    assert append((3, "a", "T"), (2, "a", "T"), ignore_keys=False) == 1  # with the key it is another row
    assert append() == 0


def test_rows_stored_by_other_ways_are_found(spark, database):
    sinks.append_rows(used(spark, (1, "a", "T")), database, schemas.TOOL_USAGE)
    assert fingerprints.append_distinct(used(spark, (2, "a", "T"), (3, "b", "T")), database, schemas.TOOL_USAGE) == 1
    sinks.replace_table(used(spark, (7, "c", "T")), database, schemas.TOOL_USAGE)  # fingerprints of the old version do not count
    assert fingerprints.append_distinct(used(spark, (8, "a", "T"), (9, "c", "T")), database, schemas.TOOL_USAGE) == 1
    assert kept(spark, database) == [(7, "c", "T"), (8, "a", "T")]


def test_only_files_with_candidates_are_read(spark, database, monkeypatch):
    for i in range(4):
        fingerprints.append_distinct(used(spark, (i, f"e{i}", "T")), database, schemas.TOOL_USAGE)
    read, original = [], type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **k: read.append(paths) or original(self, *paths, **k))
    fingerprints.append_distinct(used(spark, (10, "e2", "T"), (11, "new", "T")), database, schemas.TOOL_USAGE)
    of_table = [p for paths in read for p in paths if "/tool_usage-" in p]
    assert len(of_table) == 2  # the file that holds e2, and afterwards the file just written


def test_equal_fingerprints_are_no_copies(spark, database, monkeypatch):
    monkeypatch.setattr(fingerprints, "fingerprint", lambda columns: F.lit(1).cast("bigint"))
    assert fingerprints.append_distinct(used(spark, (1, "a", "T"), (2, "b", "T")), database, schemas.TOOL_USAGE) == 2
    assert fingerprints.append_distinct(used(spark, (3, "a", "T"), (4, "c", "T")), database, schemas.TOOL_USAGE) == 1


def test_nulls_are_equal_and_stay_in_their_column(spark, database):
    rows = tool_usage(spark, ("e", "Wiki", moment(1), None), (None, "Wiki", moment(1), "Success"))
    assert fingerprints.append_distinct(rows, database, schemas.TOOL_USAGE) == 2
    assert fingerprints.append_distinct(rows, database, schemas.TOOL_USAGE) == 0


# kept Day 0


def days(spark, database):
    return {r.employee_id: (str(r.joining_date), r.source_rows) for r in kept_day_zero.kept_days(spark, database).collect()}


def test_appends_move_day_zero_back_only(spark, database):
    def merge(**parts):
        kept_day_zero.merge(tables(spark, **parts), database)

    merge(onb=[("a", "S", "Completed", day(9), None), (None, "S", "Completed", day(0), None), ("n", "S", "Completed", None, None)])
    assert days(spark, database) == {"a": (str(day(9)), 1)}
    merge(tool=[("a", "Wiki", moment(4), "Success"), ("b", "Wiki", moment(8, 23), "Success"), ("n", "Wiki", moment(3), "Success")])
    merge(sup=[("r", "a", "C", moment(20), "Pending", None)])
    merge()
    assert days(spark, database) == {"a": (str(day(4)), 3), "b": (str(day(8)), 1), "n": (str(day(3)), 2)}
    kept_day_zero.rebuild(tables(spark, onb=[("z", "S", "Completed", day(1), None)]), database)
    assert days(spark, database) == {"z": (str(day(1)), 1)}


def test_a_given_day_zero_reads_no_table(spark, database):
    raw = tables(spark, onb=[("a", "S", "Completed", day(2), day(4))], tool=[("a", "Wiki", moment(1), "Success")])
    kept_day_zero.merge(raw, database)
    month = prepare(raw, day_zero=kept_day_zero.load(spark, database))
    assert [r.days_since_joining for r in month.tables.onboarding.collect()] == [1]
    assert month.day_zero.source_rows == 2


# parts of a database table


def fitting(predicates, values, kind):
    """How many predicates each value fits, by DuckDB."""
    connection = duckdb.connect()
    connection.execute(f"create table t (k {kind})")
    connection.executemany("insert into t values (?)", [(v,) for v in values])
    each = " + ".join(f"coalesce(({p})::int, 0)" for p in predicates)
    return [row[0] for row in connection.execute(f"select {each} from t").fetchall()]


@pytest.mark.parametrize("partitions", [1, 2, 7, 50])
def test_ranges_of_moments_hold_every_row_once(partitions):
    values = [None, *[day(n) for n in (-400, 0, 1, 15, 29, 30, 31, 900)]]
    assert set(fitting(moment_ranges("k", day(0), day(30), partitions), values, "date")) == {1}
    values = [None, moment(-9), *[moment(n, n % 24, n % 60) for n in range(0, 31)], moment(99)]
    predicates = moment_ranges("k", moment(0), moment(30, 23), partitions)
    assert len(predicates) == partitions and set(fitting(predicates, values, "timestamp")) == {1}
    assert moment_ranges("k", day(3), day(3), partitions) == ["1 = 1"]
    with pytest.raises(ValueError):
        moment_ranges("k", day(1), day(0), 2)


def test_hash_parts_hold_every_row_once():
    values = [None, "", *[f"REQ-{i}" for i in range(500)]]
    predicates = hash_parts("k", 8, "hash({column}) % {n}")
    assert len(predicates) == 8 and set(fitting(predicates, values, "varchar")) == {1}
    assert hash_parts("request_id", 2)[1] == "request_id IS NOT NULL AND mod(abs(hashtext(request_id)::bigint), 2) = 1"
    with pytest.raises(ValueError):
        hash_parts("k", 0)


# cohorts of all stages


def test_cohorts_of_all_stages_equal_one_run_each(spark):
    month = prepare(map_events(read_events(spark, "/root/testdata/sf0.001")))
    together = cohort_friction.cohort_friction(month.tables)
    found = [tuple(r) for r in together.collect()]
    expected = []
    for stage in sorted({r[0] for r in found}):
        expected += [(stage, *r) for r in friction.friction_points(month.cohort(stage).tables).collect()]
    assert found == expected and len({r[0] for r in found}) == 6


def test_more_stages_than_bits_of_a_word(spark):
    rows = [("a", f"S{i:03}", "Delayed", day(0), day(1)) for i in range(130)] + [("b", "S129", "Delayed", day(0), None)]
    month = prepare(tables(spark, onb=rows))
    by_stage = Counter(r.onboarding_stage for r in cohort_friction.cohort_friction(month.tables).collect())
    assert by_stage == {f"S{i:03}": 130 for i in range(130)}
    assert cohort_friction.cohort_friction(prepare(tables(spark)).tables).collect() == []


# views


def test_views_outlive_the_session(spark, database):
    views.register_catalog_views(spark, database)
    sinks.append_rows(onboarding(spark, ("a", "S", "Completed", day(3), None)), database, schemas.ONBOARDING)
    other = spark.newSession()
    assert [r.employee_id for r in other.table(f"{database}.{schemas.VIEW_START_DATES}").collect()] == ["a"]
    assert other.sql(f"select start_day_offset from {database}.{schemas.VIEW_ONBOARDING}").first()[0] == 0


# command line


def test_append_refuses_and_cleans(spark, database, tmp_path, capsys):
    (tmp_path / "up.csv").write_text("employee_id,onboarding_stage,start_date,stage_status\nA,S,2026-01-05,Delayed\nB,S,2026-01-05,Lost\n,S,2026-01-05,Delayed\n")
    arguments = ["append", "--database", database, "--table", "onboarding", "--csv", f"{tmp_path}/up.csv", "--refused", f"{tmp_path}/refused"]
    main(arguments, spark)
    assert "1 rows stored, 2 refused" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/refused").count() == 2
    sinks.clear_tables(spark, database)
    main(["clean", "--database", database, "--hours", "0"], spark)
    assert "old versions of onboarding removed" in capsys.readouterr().out


def test_typed_parameters(spark, tmp_path):
    assert typed_parameter("a=b=c") == ("a", "b=c") and typed_parameter("a=") == ("a", "")
    assert typed_parameter("n:int=3") == ("n", 3) and typed_parameter("n:int=") == ("n", None)
    assert typed_parameter("d:date=2026-01-05") == ("d", day(0)) and typed_parameter("b:bool=TRUE") == ("b", True)
    assert typed_parameter("t:timestamp=2026-01-05 01:00:00") == ("t", moment(0, 1))
    bound = run_sql(spark, "select :n + 1 as n, :d as d, :x as x", dict(map(typed_parameter, ["n:int=3", "d:date=2026-01-05", "x:decimal=1.50"])))
    assert tuple(bound.first()) == (4, day(0), Decimal("1.50"))
    for bad in ("a", "=1", "a:what=1", "a:int=x", "a:bool=1"):
        with pytest.raises(ValueError):
            typed_parameter(bad)
