from __future__ import annotations

import uuid

import pytest
from helpers import by, day, moment, only, tables

from firstmonth import schemas
from firstmonth.operators import views
from firstmonth.sources import sinks
from firstmonth.sources.shared import shared_folder
from firstmonth.sources.tables import (
    conform,
    load_catalog_tables,
    load_jdbc_table,
    load_tables,
    range_options,
    register_tables,
    run_sql,
)
from firstmonth.sources.uploads import files_with_line_breaks, has_line_breaks, read_csv, read_upload, validate_upload


@pytest.fixture
def database(spark, tmp_path):
    name = f"test_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    return name


def csv_file(tmp_path, text):
    path = tmp_path / "upload.csv"
    path.write_text(text)
    return str(path)


def test_upload_in_any_column_order_with_extra_columns(spark, tmp_path):
    path = csv_file(
        tmp_path,
        " usage_date ,team,employee_id,tool_name\n"
        "2026-01-05 09:30:00.5,x,  EMP-1 ,\tWiki\n"
        "2026-01-06T10:00:00,NA,,\"Mail, \"\"new\"\" \"\n",
    )
    got = read_upload(spark, path, schemas.TOOL_USAGE)
    assert got.dtypes[:4] == [
        ("usage_date", "timestamp_ntz"), ("team", "string"), ("employee_id", "string"), ("tool_name", "string"),
    ]
    rows = by(got, "tool_name")
    assert rows["Wiki"]["employee_id"] == "EMP-1"
    assert rows["Wiki"]["usage_date"] == moment(0, 9).replace(minute=30, microsecond=500000)
    other = rows['Mail, "new"']
    assert (other["employee_id"], other["team"], other["usage_status"]) == (None, None, "Success")


def test_upload_with_byte_order_mark(spark, tmp_path):
    path = csv_file(tmp_path, "\ufeffemployee_id,onboarding_stage,start_date\na,S,2026-01-05\n")
    assert only(read_upload(spark, path, schemas.ONBOARDING))["employee_id"] == "a"


def test_upload_numbers(spark, tmp_path):
    lines = ["abc", "nan", " 3 ", "-1", "", "2.5"]
    text = "employee_id,request_category,request_date,resolution_time\n" + "".join(
        f"e{i},C,2026-01-05 00:00:00,{value}\n" for i, value in enumerate(lines)
    )
    got = read_upload(spark, csv_file(tmp_path, text), schemas.SUPPORT_REQUESTS)
    hours = {r.employee_id: r.resolution_time for r in got.collect()}
    assert hours == {"e0": None, "e1": None, "e2": 3.0, "e3": -1.0, "e4": None, "e5": 2.5}


def test_cells_with_line_breaks_stay_whole(spark, tmp_path):
    path = csv_file(tmp_path, 'employee_id,onboarding_stage,start_date\na,"first\nstep",2026-01-05\nb,x,2026-01-05\n')
    assert has_line_breaks(spark, path)
    assert {r.onboarding_stage for r in read_csv(spark, path).collect()} == {"first\nstep", "x"}
    path = csv_file(tmp_path, 'employee_id,onboarding_stage,start_date\na,"one ""quoted"" cell",2026-01-05\n')
    assert not has_line_breaks(spark, path)


def test_upload_without_rows_or_required_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        validate_upload(read_csv(spark, csv_file(tmp_path, "employee_id,tool_name\n")), schemas.TOOL_USAGE)
    for table, required in schemas.REQUIRED_COLUMNS.items():
        for column in required:
            rest = [c for c in required if c != column]
            df = spark.createDataFrame([("x",) * len(rest)], rest)
            with pytest.raises(ValueError) as error:
                validate_upload(df, table)
            assert f"lacks ['{column}']" in str(error.value)
            assert str(required) in str(error.value)
    assert validate_upload(spark.createDataFrame([("x",)], ["any"]), "unknown").count() == 1


def test_create_append_replace_clear(spark, database):
    sinks.create_tables(spark, database)
    sinks.create_tables(spark, database)
    stored = load_catalog_tables(spark, database)
    assert not stored.has_rows()
    for name, df in stored.items():
        assert df.schema.names == schemas.SCHEMAS[name].names

    t = tables(spark, tool=[("a", "T", moment(0), "Failed"), ("b", "T", moment(0), None)])
    assert t.has_rows()
    for _ in range(2):
        sinks.append_rows(t.tool_usage.drop("usage_activity"), database, schemas.TOOL_USAGE)
    stored = load_catalog_tables(spark, database).tool_usage
    assert stored.count() == 4
    assert {(r.usage_id, r.usage_activity) for r in stored.collect()} == {(None, "General Activity")}
    with pytest.raises(ValueError, match="team"):
        sinks.append_rows(t.tool_usage.selectExpr("*", "1 as team"), database, schemas.TOOL_USAGE)

    # A replacement may have other columns and may be derived from the table itself.
    half = spark.table(f"{database}.tool_usage").filter("employee_id = 'a'").selectExpr("*", "'x' as team")
    sinks.replace_table(half, database, schemas.TOOL_USAGE)
    replaced = spark.table(f"{database}.tool_usage")
    assert (replaced.count(), replaced.columns[-1]) == (2, "team")

    sinks.clear_tables(spark, database)
    cleared = load_catalog_tables(spark, database)
    assert not cleared.has_rows()
    assert cleared.tool_usage.columns[-1] == "team"


def test_clearing_skips_absent_tables(spark, database):
    sinks.clear_tables(spark, database)


def test_load_from_folders_and_fail_on_a_missing_one(spark, tmp_path):
    t = tables(spark, onb=[("a", "S", "Delayed", day(0), None)])
    for name, df in t.items():
        df.write.parquet(f"{tmp_path}/{name}")
    assert only(load_tables(spark, str(tmp_path)).onboarding)["start_date"] == day(0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_tables(spark, f"{tmp_path}/nothing")


def test_sql_binds_values(spark):
    register_tables(tables(spark, tool=[("a", "O'T", moment(0), "Failed"), ("a", "U", moment(0), "Success")]))
    got = run_sql(spark, "select employee_id from tool_usage where tool_name = :name", {"name": "O'T"})
    assert only(got) == {"employee_id": "a"}
    assert run_sql(spark, "select count(*) as n from onboarding").first().n == 0


def test_registered_views(spark):
    t = tables(spark, onb=[("a", "S", "Delayed", day(0), day(4))], sup=[("1", "a", "C", moment(2), "Closed", 1.0)])
    onb = t.onboarding.selectExpr("1L as onboarding_id", "*")
    tool = t.tool_usage.selectExpr("1L as usage_id", "*")
    views.register_views(type(t)(onb, tool, t.support_requests))
    got = run_sql(
        spark,
        f"""select o.start_day_offset, o.stage_duration_days, s.days_since_joining
            from {schemas.VIEW_ONBOARDING} o join {schemas.VIEW_SUPPORT} s using (employee_id)
            join {schemas.VIEW_START_DATES} using (employee_id)""",
    )
    assert only(got) == {"start_day_offset": 0, "stage_duration_days": 4, "days_since_joining": 2}
    assert spark.table(schemas.VIEW_TOOL_USAGE).count() == 0


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == named if named else folder
    assert spark.sparkContext.getCheckpointDir()


def test_blank_dates_and_numbers_are_missing(spark, tmp_path):
    text = "employee_id,onboarding_stage,start_date,completion_date\nE1,S1,2024-01-01,  \nE2,S1, ,2024-01-03\n"
    got = by(read_upload(spark, csv_file(tmp_path, text), schemas.ONBOARDING), "employee_id")
    assert got["E1"]["completion_date"] is None and got["E2"]["start_date"] is None
    assert str(got["E2"]["completion_date"]) == "2024-01-03"


def test_rows_longer_than_the_header_are_refused(spark, tmp_path):
    head = "employee_id,onboarding_stage,start_date\n"
    for row in ("E2,S1,2024-01-01,LOST\n", 'E2,"S,1",2024-01-01,"a ""b"""\n'):
        with pytest.raises(ValueError, match="more cells than the header: 1 in .*upload.csv"):
            read_upload(spark, csv_file(tmp_path, head + "E1,S1,2024-01-01\n" + row), schemas.ONBOARDING)
    short = read_upload(spark, csv_file(tmp_path, head + 'E1,"S,1",2024-01-01\nE2,S1\nE3,S1,2024-01-01,\n'), schemas.ONBOARDING)
    assert {r.employee_id: r.start_date is None for r in short.collect()} == {"E1": False, "E2": True, "E3": False}


@pytest.mark.parametrize("row", ["E2,S1,2024-01-01,,LOST", 'E2,"S,\n1",2024-01-01,,"LO\nST"', "E2,S1,2024-01-01,,,,LOST,", ",,,,LOST"])
def test_blank_cells_hide_no_longer_row(spark, tmp_path, row):
    text = f"employee_id,onboarding_stage,start_date\nE1,S1,2024-01-01\n{row}\n"
    with pytest.raises(ValueError, match="more cells than the header: 1 in .*upload.csv"):
        read_upload(spark, csv_file(tmp_path, text), schemas.ONBOARDING)


def test_short_rows_and_commas_at_the_end_are_kept(spark, tmp_path):
    rows = ["E1", 'E2,"S,1"', 'E3,"S\n""1"""', "E4,S1,2024-01-01,,,", "E5,,", 'E6,"open, ', ""]
    got = read_csv(spark, csv_file(tmp_path, "employee_id,onboarding_stage,start_date\n" + "\n".join(rows)))
    assert sorted(r.employee_id for r in got.collect()) == ["E1", "E2", "E3", "E4", "E5", "E6"]


@pytest.mark.parametrize(
    ("cells", "expected"),
    [
        (["01/15/2024", "02/03/2024"], ["2024-01-15", "2024-02-03"]),
        (["15/01/2024", "02/03/2024"], ["2024-01-15", "2024-03-02"]),
        (["15-Jan-2024", "3-Feb-2024"], ["2024-01-15", "2024-02-03"]),
        (['"Jan 15, 2024"', '"Feb 3, 2024"'], ["2024-01-15", "2024-02-03"]),
    ],
)
def test_other_date_formats(spark, tmp_path, cells, expected):
    text = "employee_id,onboarding_stage,start_date\n" + "".join(f"E{i},S,{c}\n" for i, c in enumerate(cells))
    got = by(read_upload(spark, csv_file(tmp_path, text), schemas.ONBOARDING), "employee_id")
    assert [str(got[f"E{i}"]["start_date"]) for i in range(len(cells))] == expected


def test_dates_that_fit_no_format_fail(spark, tmp_path):
    text = "employee_id,onboarding_stage,start_date\nE1,S,01/15/2024\nE2,S,soon\n"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_upload(spark, csv_file(tmp_path, text), schemas.ONBOARDING).collect()


def test_only_files_with_line_breaks_are_read_whole(spark, tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    head = "employee_id,onboarding_stage,start_date\n"
    (folder / "a.csv").write_text(head + 'a,"first\nstep",2026-01-05\n')
    (folder / "b.csv").write_text(head + 'b,5" disk,2026-01-05\nc,say "x,2026-01-06\n')
    assert [name.rsplit("/", 1)[1] for name in files_with_line_breaks(spark, str(folder))] == ["a.csv"]
    got = by(read_csv(spark, str(folder)), "employee_id")
    assert {k: v["onboarding_stage"] for k, v in got.items()} == {"a": "first\nstep", "b": '5" disk', "c": 'say "x'}


def test_ranges_of_a_database_table(spark):
    assert range_options("id", 1, 100, 8) == {"partitionColumn": "id", "lowerBound": 1, "upperBound": 101, "numPartitions": 8}
    assert range_options("id", 5, 5, 8) == {} == range_options("id", None, None, 8)
    with pytest.raises(ValueError):
        range_options("id", 9, 1, 8)
    with pytest.raises(ValueError, match="numeric key"):
        load_jdbc_table(spark, "tool_usage", "jdbc:none", {})


def test_times_need_a_utc_session(spark):
    df = spark.createDataFrame([("a", "S", "2026-01-05")], "employee_id string, onboarding_stage string, start_date string")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            conform(df, schemas.ONBOARDING)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_catalog_views_follow_their_tables(spark, database):
    sinks.create_tables(spark, database)
    views.register_catalog_views(spark, database)
    starts, first = schemas.VIEW_START_DATES, schemas.VIEW_ONBOARDING
    assert spark.table(starts).count() == 0
    for n, expected in ((9, {("a", str(day(9)))}), (2, {("a", str(day(2)))})):
        t = tables(spark, onb=[("a", "S", "Completed", day(n), day(n + 1))])
        sinks.append_rows(t.onboarding, database, schemas.ONBOARDING)
        assert {(r.employee_id, str(r.joining_date)[:10]) for r in spark.table(starts).collect()} == expected
    assert {r.start_day_offset for r in spark.table(first).collect()} == {0, 7}
