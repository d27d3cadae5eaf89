"""CSV uploads: header row in any column order, extra columns allowed, cells trimmed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampNTZType

from firstmonth import schemas
from firstmonth.functions.predicates import WHITESPACE, blank_to_null, strip
from firstmonth.sources.tables import conform

# Cells that mean "missing".
MISSING_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

#: Tried in this order; month before day where both fit.
DATE_FORMATS = [
    f"{day}[ H:mm[:ss]]"
    for day in (
        "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
        "d.M.yyyy", "yyyyMMdd",
    )
]

_CORRUPT, _FILE = "__row_text", "__file"

BYTE_ORDER_MARK = "\ufeff"


@dataclass(frozen=True)
class Upload:
    """The cells of an upload as text, how many rows there are, and how its date columns can be read."""

    rows: DataFrame
    n_rows: int
    #: Per date column: cells that are not ISO text, cells that are, and per format those that are neither.
    readings: dict[str, dict[str, int]]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, named by the header; missing marks become null.

    Files are split between tasks, except those in which a quoted cell holds a line break. A row with more cells than
    the header is an error, unless only commas follow; one with fewer ends in missing cells.
    """
    return scan(spark, path).rows


def scan(spark: SparkSession, path: str, date_columns: Iterable[str] = ()) -> Upload:
    """Look at all rows once: cells, cells beyond the header, and all readings of the ``date_columns`` come from one parse of each line.

    One line of counts a file comes back. Files with an open quote, another header, or a row equal to the header go
    through Spark's reader of whole files instead; the others are parsed line by line, again when ``rows`` are used.
    """
    lines = _lines(spark, path)
    found = lines.where("_start = 0").select("value", _FILE).first()
    if found is None:
        return Upload(spark.createDataFrame([], StructType([])), 0, {})
    header = found["value"].lstrip(BYTE_ORDER_MARK)
    names = _reader(spark, False).csv(found[_FILE]).columns
    dates = {i: name for i, name in enumerate(names) if _plain(name) in set(date_columns)}
    files = _profile(lines, header, len(names), dates).collect()
    plain = [f for f in files if _is_plain(f)]
    _refuse({f[_FILE]: f["n_long"] for f in plain if f["n_long"]})
    parts, counts = [], [f.asDict() for f in plain]
    if plain:
        kept = lines if len(plain) == len(files) else _lines(spark, [f[_FILE] for f in plain])
        rows = kept.where(~_is_header(header)).select(_cells(len(names)).alias("_cells"))
        parts.append(rows.select(*[F.col(f"_cells.c{i}").alias(name) for i, name in enumerate(names)]))
    for multi_line in (False, True):
        others = sorted(f[_FILE] for f in files if not _is_plain(f) and (f["n_open"] > 0) == multi_line)
        if others:
            whole = _whole_files(spark, others, multi_line)
            if [_plain(name) for name in whole.columns] != [_plain(name) for name in names]:
                raise ValueError(f"The header of {others[0]} is {whole.columns}, that of {found[_FILE]} {names}.")
            whole = whole.toDF(*names)
            parts.append(whole)
            values = {i: F.col(f"`{name}`") for i, name in enumerate(whole.columns) if i in dates}
            counts.append(whole.agg(F.count(F.lit(1)).alias("n_rows"), *_readings(values)).first().asDict())
    readings = {name: {k: sum(c[f"{i}:{k}"] for c in counts) for k in _READINGS} for i, name in dates.items()}
    return Upload(reduce(DataFrame.unionByName, parts), sum(c["n_rows"] for c in counts), readings)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are not blank, with their file and where the part of it starts that a task reads."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"[^\x00-\x20]"))
    return lines.select("value", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias("_start"))


def _is_header(header: str) -> Column:
    return F.ltrim("value", F.lit(BYTE_ORDER_MARK)) == F.lit(header)


def _is_plain(file) -> bool:
    """Its first line, and no other, is the header, and every quote is closed in its line."""
    return file["n_open"] == 0 and file["n_header"] == 1 and file["first"] == file["first_header"]


def _profile(lines: DataFrame, header: str, n_cells: int, dates: dict[int, str]) -> DataFrame:
    """One line of counts a file."""
    is_header, at_start = F.col("_is_header"), F.col("_start") == 0
    parsed = lines.select(
        _FILE,
        "_start",
        _is_header(header).alias("_is_header"),
        _opens_a_quote(F.col("value")).alias("_opens"),
        F.monotonically_increasing_id().alias("_at"),
        _cells(n_cells).alias("_cells"),
    )
    values = {i: F.when(~is_header, F.col(f"_cells.c{i}")) for i in dates}
    return parsed.groupBy(_FILE).agg(
        F.count_if(~is_header).alias("n_rows"),
        F.count_if(is_header).alias("n_header"),
        F.min(F.when(at_start, F.col("_at"))).alias("first"),
        F.min(F.when(at_start & is_header, F.col("_at"))).alias("first_header"),
        F.count_if("_opens").alias("n_open"),
        F.count_if(~is_header & ~F.col("_cells.fits")).alias("n_long"),
        *_readings(values),
    )


def _cells(n: int) -> Column:
    """Struct of the cells ``c0`` to ``c{n-1}`` of a line, missing marks as null, and ``fits``: no cell stands beyond them.

    Blank and absent cells read alike, so each line gets one cell more, longer than the line itself. It is the last of
    ``n + 1`` cells, or stands earlier in a short row, unless there are too many before it.
    """
    line = F.regexp_replace(F.col("value"), r",+\z", "")  # nothing is lost with commas alone
    end = F.repeat(F.lit("x"), F.length(line) + 1)
    names = [f"c{i}" for i in range(n + 1)]
    parsed = F.from_csv(F.concat(line, F.lit(","), end), ", ".join(f"{name} string" for name in names), {"escape": '"'})

    def made(both: Column) -> Column:
        cells, mark = both["cells"], both["mark"]
        fits = [F.coalesce(cells[name] == mark, F.lit(False)) for name in names]
        kept = [F.when(~fits[i] & ~cells[names[i]].isin(MISSING_MARKS), cells[names[i]]).alias(names[i]) for i in range(n)]
        return F.struct(*kept, reduce(Column.__or__, fits).alias("fits"))

    # a transform over one element, so that a line is parsed once
    return F.get(F.transform(F.array(F.struct(parsed.alias("cells"), end.alias("mark"))), made), F.lit(0))


def _whole_files(spark: SparkSession, files: list[str], multi_line: bool) -> DataFrame:
    df = _read(spark, files, multi_line)
    cells = [(F.col(f"`{name}`"), name) for name in df.columns if name not in (_CORRUPT, _FILE)]
    _refuse_long_rows(df, len(cells))
    return df.select(*[F.when(~cell.isin(MISSING_MARKS), cell).alias(name) for cell, name in cells])


def _refuse(found: dict[str, int]) -> None:
    if found:
        where = ", ".join(f"{n} in {file}" for file, n in sorted(found.items())[:5])
        raise ValueError(f"Rows with more cells than the header: {where}.")


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return spark.read.options(header=True, escape='"', enforceSchema=False, multiLine=multi_line)


def _read(spark: SparkSession, files: list[str], multi_line: bool) -> DataFrame:
    reader = _reader(spark, multi_line)
    names = reader.csv(files).columns
    schema = StructType([StructField(name, StringType()) for name in [*names, _CORRUPT]])
    rows = reader.options(columnNameOfCorruptRecord=_CORRUPT, columnPruning=False).schema(schema).csv(files)
    return rows.withColumn(_FILE, F.col("_metadata.file_path"))


def _refuse_long_rows(df: DataFrame, n_cells: int) -> None:
    """Spark marks rows of another length than the header; of those, count the ones with a cell beyond it.

    Blank and absent cells read alike, so each row gets one cell more, longer than the row itself: it is found among
    the first ``n_cells + 1`` unless that many stand before it. An open quote takes it into the last cell.
    """
    beyond = ", ".join(f"c{i} string" for i in range(n_cells + 1))
    row = F.regexp_replace(F.col(_CORRUPT), r",*[\r\n]*\z", "")  # nothing is lost with commas alone
    end = F.repeat(F.lit("x"), F.length(row) + 1)
    cells = F.from_csv(F.concat(row, F.lit(","), end), beyond, {"escape": '"'})
    inside = [F.coalesce(F.length(cells[f"c{i}"]) > F.length(row), F.lit(False)) for i in range(n_cells)]
    fits = reduce(Column.__or__, inside, F.coalesce(cells[f"c{n_cells}"] == end, F.lit(False)))
    any_cell = F.length(F.coalesce(F.col(f"`{df.columns[0]}`"), F.lit(""))) >= 0  # Spark asks for a column of the file itself
    long_rows = df.where(F.col(_CORRUPT).isNotNull() & any_cell).where(~fits)
    found = long_rows.groupBy(_FILE).agg(F.count(F.lit(1)).alias("n")).orderBy(_FILE).limit(5).collect()
    _refuse({row[_FILE]: row["n"] for row in found})


def _opens_a_quote(line: Column) -> Column:
    """A quoted cell does not end in this line. A quote opens one only at the start of a cell."""
    whole = F.regexp_replace(line, r'(^|,)\s*"[^"]*+(?:""[^"]*+)*+"(?=\s*(?:,|$))', "$1")
    return line.contains('"') & whole.rlike(r'(^|,)\s*"')


def files_with_line_breaks(spark: SparkSession, path: str) -> list[str]:
    """Files in which a line ends inside a quoted cell; as many names as there are such files come to the driver."""
    opened = spark.read.text(path).where(_opens_a_quote(F.col("value")))
    return sorted(row[0] for row in opened.select(F.col("_metadata.file_path")).distinct().collect())


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """True when a quoted cell of any file holds a line break."""
    return bool(files_with_line_breaks(spark, path))


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every text column; a missing cell stays missing."""
    return df.select(
        *[
            (strip(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")).alias(name)
            for name, kind in df.dtypes
        ]
    )


def validate_upload(df: DataFrame, table: str, n_rows: int | None = None) -> DataFrame:
    """Trim names and cells; an upload without rows or without a required column is an error."""
    if n_rows == 0 or (n_rows is None and df.isEmpty()):
        raise ValueError(f"The upload for {table} has no rows.")
    df = df.toDF(*[_plain(name) for name in df.columns])
    required = schemas.REQUIRED_COLUMNS.get(table, [])
    absent = set(required).difference(df.columns)
    if absent:
        raise ValueError(f"The upload for {table} lacks {sorted(absent)}; it must have {required}.")
    return trim_strings(df)


def _plain(name: str) -> str:
    return name.strip(WHITESPACE + BYTE_ORDER_MARK)


def read_upload(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A CSV upload, validated and in the table's declared types."""
    upload = scan(spark, path, _date_columns(table))
    rows = validate_upload(upload.rows, table, upload.n_rows)
    return conform(_with_dates(rows, {_plain(name): found for name, found in upload.readings.items()}), table)


def _date_columns(table: str) -> list[str]:
    return [f.name for f in schemas.SCHEMAS[table] if isinstance(f.dataType, (DateType, TimestampNTZType))]


def parse_dates(df: DataFrame, table: str) -> DataFrame:
    """Bring date columns that are not ISO text into it, by the first of ``DATE_FORMATS`` that fits the whole column.

    Columns that no format fits stay as they are and fail in ``conform``. One pass looks at all date columns.
    """
    names = [name for name in df.columns if name in _date_columns(table)]
    if not names:
        return df
    found = df.agg(*_readings({i: F.col(f"`{name}`") for i, name in enumerate(names)})).first()
    return _with_dates(df, {name: {k: found[f"{i}:{k}"] for k in _READINGS} for i, name in enumerate(names)})


_READINGS = ["not iso", "iso", *DATE_FORMATS]


def _readings(values: dict[int, Column]) -> list[Column]:
    """Aggregates of each column of text; formats are tried on cells that are not ISO text only, which fits no format."""
    counts = []
    for i, cell in values.items():
        text = blank_to_null(cell)
        iso = text.try_cast("timestamp").isNotNull()
        counts.append(F.count_if(text.isNotNull() & ~iso).alias(f"{i}:not iso"))
        counts.append(F.count_if(text.isNotNull() & iso).alias(f"{i}:iso"))
        for pattern in DATE_FORMATS:
            counts.append(F.count_if(text.isNotNull() & ~iso & _parsed(text, pattern).isNull()).alias(f"{i}:{pattern}"))
    return counts


def _parsed(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def _with_dates(df: DataFrame, readings: dict[str, dict[str, int]]) -> DataFrame:
    for name, found in readings.items():
        fit = next((pattern for pattern in DATE_FORMATS if not found[pattern]), None)
        if found["not iso"] and not found["iso"] and fit:
            text = blank_to_null(F.col(f"`{name}`"))
            df = df.withColumn(name, _parsed(text, fit).cast("timestamp_ntz").cast("string"))
    return df
