from __future__ import annotations

import uuid

import pytest

from firstmonth.__main__ import main

ONBOARDING = """employee_id,onboarding_stage,stage_status,start_date,completion_date
EMP-1,Setup,Delayed,2026-01-05,
EMP-1,Setup,Delayed,2026-01-05,
EMP-2,Access,Completed,2026-01-06,2026-01-08
"""


@pytest.fixture
def database(spark, tmp_path):
    name = f"test_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    return name


def test_import_report_and_sql(spark, database, tmp_path, capsys):
    out = str(tmp_path / "out")
    main(["report", "--database", database, "--out", f"{out}/none"], spark)
    assert "No rows" in capsys.readouterr().out

    (tmp_path / "onboarding.csv").write_text(ONBOARDING)
    main(["import", "--database", database, "--table", "onboarding", "--csv", str(tmp_path / "onboarding.csv")], spark)
    main(["report", "--database", database, "--out", f"{out}/all"], spark)
    points = spark.read.parquet(f"{out}/all/friction/points").collect()
    assert [(p.friction_point, p.frequency, p.affected_pct) for p in points] == [
        ("Onboarding Stage Delay: Setup", 1, 50.0)
    ]
    assert spark.read.parquet(f"{out}/all/audit").first().duplicate_records == 1
    main(["report", "--database", database, "--out", f"{out}/access", "--stage", "Access"], spark)
    assert spark.read.parquet(f"{out}/access/overview/kpis").first().total_hires == 1
    assert spark.read.parquet(f"{out}/access/friction/points").count() == 0


def test_sql_over_tables_and_views(spark, database, tmp_path):
    (tmp_path / "onboarding.csv").write_text(ONBOARDING)
    main(["import", "--database", database, "--table", "onboarding", "--csv", str(tmp_path / "onboarding.csv")], spark)
    query = "select onboarding_stage, count(*) as n from vw_first_30_days_onboarding where employee_id = :who group by 1"
    main(["sql", "--database", database, "--query", query, "--param", "who=EMP-1", "--out", f"{tmp_path}/sql"], spark)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/sql").collect()] == [("Setup", 2)]
