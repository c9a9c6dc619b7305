"""CSV sources (S1, S2, S3, S14, S15) and header handling.

S1: every column is read as a string with the header's names. A row with more
cells than the header is dropped, also when the surplus cells are empty; a
short row is kept, padded with nulls. The reader keeps the raw line of every
row whose number of cells differs, and a marker appended to that line tells
which of the two it is. Cells may be quoted: commas, doubled quotes and line breaks inside
quotes belong to the cell. The BOM of the first header cell is stripped.
Only the header goes through the driver; the data is read by the CSV data
source in parallel, one task a file, since a line break may be part of a cell.
Pass ``multi_line=False`` for large files without such cells: they are then
split. A file has one kind of line end.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.cleaning import camel_to_snake, hxl_row, tolerant_double, year_from_date_text
from lacuna.session import materialize
from lacuna.sources.workbook import read_workbooks, sheet_table

RAW = "_raw_line"
_END = "\u0001end\u0001"
_QUOTING = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW}


def read_header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    """The cells of the first record, also when they hold quotes or line breaks; empty for an empty file."""
    reader = spark.read.options(**_QUOTING).option("multiLine", multi_line).option("encoding", "UTF-8")
    found = reader.csv(path)
    first = found.first() if found.columns else None
    return [] if first is None else [(c or "").lstrip("\ufeff") if i == 0 else c or "" for i, c in enumerate(first)]


def read_csv_strings(spark: SparkSession, path: str, skip_second_header: bool = False, multi_line: bool = True) -> DataFrame:
    """S1 (+ S2): all-string scan, over-long rows dropped, short rows null-padded."""
    names = read_header(spark, path, multi_line)
    seen: dict[str, int] = {}
    cols = []
    for n in names:
        k = n
        if k in seen:  # duplicate header cells get a suffix
            seen[k] += 1
            k = f"{n}_{seen[n]}"
        else:
            seen[k] = 0
        cols.append(k)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols] + [T.StructField(RAW, T.StringType(), True)])
    df = (
        spark.read.schema(schema)
        .options(**_QUOTING)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("enforceSchema", True)
        .option("encoding", "UTF-8")
        .option("columnPruning", False)  # all cells are counted whatever is selected
        .csv(path)
    )
    return _fitting_rows(df, cols, skip_second_header)


def read_csv_rows(lines: DataFrame, cols: list[str], skip_second_header: bool = False) -> DataFrame:
    """S1 (+ S2) for header-less CSV records (column ``value``, one record a row) with known column names."""
    schema = ", ".join(f"`{c}` string" for c in [*cols, RAW])
    cells = F.from_csv("value", F.lit(schema), _QUOTING)
    return _fitting_rows(lines.select(cells.alias("_cells")).select("_cells.*"), cols, skip_second_header)


def _fitting_rows(df: DataFrame, cols: list[str], skip_second_header: bool) -> DataFrame:
    record = F.regexp_replace(RAW, r"[\r\n]+\z", "")
    marked = F.from_csv(F.concat(record, F.lit(f",{_END}")), F.lit(", ".join(f"`{i}` string" for i in range(len(cols)))), {k: _QUOTING[k] for k in ("quote", "escape", "mode")})
    short = F.exists(F.array(*[marked[str(i)] for i in range(len(cols))]), lambda c: F.coalesce(c == _END, F.lit(False)))
    # always true; a scan that needs the raw record alone (a count) is refused, so a cell is named as well
    named = F.length(F.concat_ws("", F.col(f"`{cols[0]}`"))) >= 0 if cols else F.lit(True)
    df = df.where((F.col(RAW).isNull() | short) & named).drop(RAW)
    if skip_second_header and cols:
        df = df.where(~hxl_row(cols[0]))
    return df


def drop_hxl_rows(df: DataFrame, contains: bool = False) -> DataFrame:
    """Drop HXL tag rows (first column starts with '#'; EDA variant: contains '#')."""
    first = F.col(df.columns[0])
    bad = F.coalesce(first.contains("#"), F.lit(False)) if contains else hxl_row(first)
    return df.where(~bad)


# ------------------------------------------------------------------ P2 headers
def _key_ci(s: str) -> str:
    return s.strip().lower()


def _key_snake(s: str) -> str:
    return s.strip().lower().replace(" ", "_")


def _key_word(s: str) -> str:
    return re.sub(r"[^\w]", "", s.strip().lower().replace(" ", "_"))


KEYS = {"ci": _key_ci, "snake": _key_snake, "word": _key_word}


def resolve_columns(df: DataFrame, candidates: dict[str, list[str]], style: str = "ci") -> DataFrame:
    """For each target, the first candidate present (compared after ``style`` normalising) is renamed.

    Columns that match no target are kept unchanged.
    """
    key = KEYS[style]
    by_key: dict[str, str] = {}
    for c in df.columns:
        by_key.setdefault(key(c), c)
    rename: dict[str, str] = {}
    for target, cands in candidates.items():
        for cand in cands:
            src = by_key.get(key(cand))
            if src is not None and src not in rename:
                rename[src] = target
                break
    out = [F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns]
    return df.select(*out)


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Camel case -> snake case for every column."""
    return df.toDF(*[camel_to_snake(c) for c in df.columns])


def drop_and_rename(df: DataFrame, drop: list[str], rename: dict[str, str]) -> DataFrame:
    """P4."""
    df = df.drop(*[c for c in drop if c in df.columns])
    return df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})


def with_provenance(df: DataFrame, year: int | None = None) -> DataFrame:
    """Year literal and the source file name from the scan metadata."""
    out = df.withColumn("source_file", F.col("_metadata.file_name"))
    if year is not None:
        out = out.withColumn("year", F.lit(year))
    return out


def numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5 on several columns."""
    return df.withColumns({c: tolerant_double(c) for c in cols if c in df.columns})


# ------------------------------------------------------------------ readers
def read_needs_files(spark: SparkSession, files: dict[int, str], candidates: dict[str, list[str]]) -> DataFrame:
    """S1 + P1 + P2 + P5 + P6 per yearly needs file, then U1 (union by name, missing columns null)."""
    frames = []
    for year, path in files.items():
        df = drop_hxl_rows(read_csv_strings(spark, path))
        df = with_provenance(df, year)
        df = resolve_columns(df, candidates, "ci")
        if "country" not in df.columns and "iso3" in df.columns:
            df = df.withColumn("country", F.col("iso3"))
        df = numeric(df, ["population", "in_need", "targeted", "affected"])
        df = df.where(F.col("country").isNotNull()) if "country" in df.columns else df
        frames.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def response_plans(df: DataFrame) -> DataFrame:
    """Plans -> one row per (iso3, year) the plan covers, via ``sequence`` of its years."""
    y0 = year_from_date_text("year_start")
    y1 = F.coalesce(year_from_date_text("year_end"), y0)
    out = df.select(
        "plan_id", "plan_name", F.upper(F.trim("iso3")).alias("iso3"), "status",
        tolerant_double("requirements_usd").alias("requirements_usd"), tolerant_double("funding_usd").alias("funding_usd"),
        y0.alias("year_start"), y1.alias("year_end"),
    ).where(F.col("year_start").isNotNull() & F.col("iso3").isNotNull())
    return out.withColumn("year", F.explode(F.sequence(F.col("year_start"), F.greatest(F.col("year_start"), F.col("year_end")))))


def population_baseline(df: DataFrame, iso3: str = "iso3", year: str = "year", value: str = "population") -> DataFrame:
    """Admin-level population rows -> population per (iso3, year)."""
    return df.groupBy(F.upper(F.trim(F.col(iso3))).alias("iso3"), F.col(year).cast("int").alias("year")).agg(
        F.sum(tolerant_double(value)).cast("bigint").alias("population")
    )


# FIXED VALUES: header names of the severity sheet, and the sheet's own name
SEVERITY_CANDIDATES = {
    "country": ["country", "countryname", "crisis_name", "location"],
    "iso3": ["iso3", "country_code", "countrycode", "iso"],
    "inform_severity": ["inform_severity", "severity", "inform_severity_index", "crisis_severity", "overall_severity", "severity_score"],
    "inform_risk": ["inform_risk", "risk", "inform_risk_index", "risk_score"],
    "year": ["year", "date", "period"],
}
SEVERITY_SHEET = "INFORM Severity - country"


def _severity(df: DataFrame) -> DataFrame:
    return numeric(resolve_columns(df, SEVERITY_CANDIDATES, "word"), ["inform_severity", "inform_risk"])


def severity_sheet(spark: SparkSession, path: str) -> DataFrame:
    """S3: the severity sheet exported as CSV; headers lower/snake-cased with non-word chars stripped."""
    return _severity(read_csv_strings(spark, path)).withColumn("year", F.col("year").try_cast("int"))


def severity_workbook(spark: SparkSession, path: str) -> DataFrame:
    """S3: the severity workbook: the named sheet with its header in the second row, or else the first sheet.

    Severity is clipped to 0..10; rows without country or severity go; without a year column it is the current year.
    """
    cells = materialize(read_workbooks(spark, path), "severity-cells")
    named = not cells.where((F.col("sheet") == SEVERITY_SHEET) & (F.col("row_no") == 1)).isEmpty()
    df = _severity(sheet_table(cells, SEVERITY_SHEET, 1) if named else sheet_table(cells))
    if "inform_severity" not in df.columns:
        return df.where(F.lit(False))
    severity = F.col("inform_severity")
    df = df.withColumn("inform_severity", F.when(severity > 10, 10.0).when(severity < 0, 0.0).otherwise(severity))
    df = df.withColumn("year", F.col("year").try_cast("int") if "year" in df.columns else F.year(F.current_date()))
    return df.dropna(subset=[c for c in ("country", "inform_severity") if c in df.columns])


def composite_severity(base: DataFrame, signals: dict[str, tuple[DataFrame, float]], keys: list[str] | None = None) -> DataFrame:
    """weighted mean of the non-null signals (each a (keys..., value) table) per key."""
    keys = keys or ["iso3", "year"]
    out = base
    num: Column | None = None
    den: Column | None = None
    for name, (sig, weight) in signals.items():
        out = out.join(sig.select(*keys, F.col("value").cast("double").alias(f"_sig_{name}")), keys, "left")
        v = F.col(f"_sig_{name}")
        term = F.coalesce(v * weight, F.lit(0.0))
        w = F.when(v.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
        num = term if num is None else num + term
        den = w if den is None else den + w
    out = out.withColumn("composite_severity", F.when(den > 0, num / den))
    return out.drop(*[f"_sig_{n}" for n in signals])
