"""Uploads read in one pass, against Python's own CSV reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from firstmonth import schemas
from firstmonth.sources import uploads
from firstmonth.sources.uploads import read_csv, read_upload, scan

HEAD = "employee_id,onboarding_stage,start_date\n"


def expected(texts, n=3):
    """Rows of all files by Python's reader, short ones filled up; blank and missing marks are None."""
    found = []
    for text in texts:
        for row in list(csv.reader(io.StringIO(text)))[1:]:
            if row:
                cells = (row + [""] * n)[:n]
                found.append(tuple(None if c in uploads.MISSING_MARKS else c for c in cells))
    return sorted(found, key=repr)


def written(tmp_path, texts):
    folder = tmp_path / "uploads"
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"{i}.csv").write_text(text, newline="")
    return str(folder)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def quoted(cell, rng):
    if any(c in cell for c in ',"\n') or rng.random() < 0.2:
        return '"' + cell.replace('"', '""') + '"'
    return cell


@pytest.mark.parametrize("breaks", [False, True])
def test_random_files(spark, tmp_path, breaks):
    rng = random.Random(breaks)
    cells = ["a", " b ", "", "NA", "null", "x,y", 'say "x"', "é😀", "\tz", "1.5", '""'] + (["two\nlines"] if breaks else [])
    texts = []
    for f in range(6):
        end = "\r\n" if f == 2 else "\n"
        rows = [",".join(quoted(rng.choice(cells), rng) for _ in range(rng.randrange(2, 4))) for _ in range(40)]
        texts.append(HEAD.strip() + end + end.join(rows) + (end if f % 2 else ""))
    path = written(tmp_path, texts)
    assert got(read_csv(spark, path)) == expected(texts)
    assert scan(spark, path).n_rows == len(expected(texts))


def test_small_splits_of_one_file(spark, tmp_path):
    text = HEAD + "".join(f"e{i},\"s, {i}\",2026-01-0{i % 9 + 1}\n" for i in range(3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        upload = scan(spark, written(tmp_path, [text]), ["start_date"])
        assert upload.n_rows == 3000 and upload.rows.rdd.getNumPartitions() > 4
        assert upload.readings["start_date"]["iso"] == 3000
        assert got(upload.rows) == expected([text])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_of_every_file(spark, tmp_path):
    texts = ["﻿" + HEAD + "a,x,2026-01-05\n", "\n" + HEAD, "", HEAD + "b,y,2026-01-06\n" + HEAD + "c,,\n"]
    rows = got(read_csv(spark, written(tmp_path, texts)))
    assert [r[0] for r in rows] == ["a", "b", "c", "employee_id"]  # a row equal to the header is a row


def test_another_header_is_an_error(spark, tmp_path):
    path = written(tmp_path, [HEAD + "a,x,2026-01-05\n", "onboarding_stage,employee_id,start_date\nx,a,2026-01-05\n"])
    with pytest.raises(Exception, match="header"):
        read_csv(spark, path).collect()


def test_long_rows_are_counted_by_file(spark, tmp_path):
    path = written(tmp_path, [HEAD + "a,x,,1\nb,y,,,2\n", HEAD + "c,z,\n", HEAD + 'd,"z,z",,,,\ne,"",,"3"\n'])
    with pytest.raises(ValueError, match=r"2 in .*0.csv, 1 in .*2.csv"):
        read_csv(spark, path)


def test_nothing_to_read(spark, tmp_path):
    for name, text in (("empty", ""), ("blank", "\n \n"), ("head", HEAD)):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="no rows"):
            read_upload(spark, str(tmp_path / name), schemas.ONBOARDING)
    (tmp_path / "odd").write_text("employee_id,stage\na,b\n")
    with pytest.raises(ValueError, match=r"lacks \['onboarding_stage', 'start_date'\]"):
        read_upload(spark, str(tmp_path / "odd"), schemas.ONBOARDING)


def test_dates_over_plain_and_whole_files(spark, tmp_path):
    """The format must fit the cells of all files, also of those that are read whole."""
    texts = [HEAD + "a,x,01/02/2026\n", HEAD + 'b,"two\nlines",25/02/2026\n']
    rows = {r.employee_id: str(r.start_date) for r in read_upload(spark, written(tmp_path, texts), schemas.ONBOARDING).collect()}
    assert rows == {"a": "2026-02-01", "b": "2026-02-25"}


def test_two_scans_of_an_upload(spark, tmp_path, monkeypatch):
    """One for all counts, one when the rows are used; nothing else but first lines is read."""
    plans = []
    original = uploads._profile
    monkeypatch.setattr(uploads, "_profile", lambda *a: plans.append(original(*a)) or plans[-1])
    monkeypatch.setattr(uploads, "_read", None)  # whole files are not looked at
    path = written(tmp_path, [HEAD + "a,x,2026-01-05\n"])
    plans.append(read_upload(spark, path, schemas.ONBOARDING))
    texts = [df._jdf.queryExecution().optimizedPlan().toString() for df in plans]
    assert [t.count("Relation [") for t in texts] == [1, 1]
    assert [t.count("from_csv") for t in texts] == [1, 1]  # a line is parsed once
