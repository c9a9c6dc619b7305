"""S3: spreadsheet workbooks (Office Open XML) as tables, and tables as workbooks.

Files are read by Spark's binary source, so they may lie in any store, and
parsed in the tasks, one workbook at a time: a workbook is a bounded unit (the
format allows 1,048,576 rows a sheet), many workbooks are many tasks. Only the
header row goes through the driver. The parser needs no spreadsheet library: a
workbook is a zip archive of XML parts, read as a stream.

Cells come as text the way a spreadsheet's CSV export gives them: shared and
inline strings, whole numbers without a decimal point, other numbers with
their shortest digits, booleans as TRUE and FALSE, errors by their code,
formulas by their stored value; blanks and empty strings as null. Dates are
stored as day numbers, and stay numbers. Rows and cells that a sheet leaves out
are null rows and null cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import ship_package

# FIXED VALUES: names of the file format
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MOST_ROWS = 1_048_576

CELLS = "path string, sheet_no int, sheet string, row_no int, cells array<string>"
_ROWS_OUT = 2_000


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - ord("A") + 1
    return n - 1


def _column_name(n: int) -> str:
    name, n = "", n + 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(ord("A") + rest) + name
    return name


def _joined(element) -> str:
    """The text of a (rich) string, without phonetic hints."""
    return "".join(t.text or "" for part in element if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _cell(c, shared: list[str]) -> str | None:
    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inline = c.find(f"{_MAIN}is")
        return (_joined(inline) if inline is not None else "") or None
    if v is None or not v.text:
        return None
    if kind == "s":
        return shared[int(v.text)] or None
    if kind == "b":
        return "TRUE" if v.text.strip() == "1" else "FALSE"
    return _number(v.text) if kind == "n" else v.text


def sheet_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """(sheet number, sheet name, row number from 0, cells) of every stored row of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{_MAIN}si":
                        shared.append(_joined(e))
                        e.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            target = targets[sheet.get(_RELATION)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names:
                continue
            with z.open(part) as f:
                row_no = -1
                for _, e in ElementTree.iterparse(f):
                    if e.tag != f"{_MAIN}row":
                        continue
                    row_no = int(e.get("r")) - 1 if e.get("r") else row_no + 1
                    cells: list[str | None] = []
                    for c in e.iter(f"{_MAIN}c"):
                        at = _column_number(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at - len(cells))
                        cells.append(_cell(c, shared))
                    e.clear()
                    yield number, sheet.get("name"), row_no, cells


def read_cells(files: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells) of every stored row of the workbooks in ``files`` (path, content)."""
    ship_package(files.sparkSession)

    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()))
        names = ["path", "sheet_no", "sheet", "row_no", "cells"]
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, held = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), []
                for row in sheet_rows(content):
                    held.append((path, *row))
                    if len(held) == _ROWS_OUT:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, CELLS)


def sheet_table(cells: DataFrame, sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """The rows below a sheet's header row as text columns named by it, with the file's name; all workbooks have that header.

    Without ``sheet`` it is the first sheet. Null header cells are named by their place, repeated ones get a suffix; wholly
    empty rows are left out, as are cells beyond the header. A sheet that no workbook has gives a table without rows or columns.
    """
    of_sheet = cells.where(F.col("sheet") == sheet if sheet is not None else F.col("sheet_no") == 0)
    head = of_sheet.where(F.col("row_no") == header_row).orderBy("path").limit(1).collect()
    names: list[str] = []
    for i, cell in enumerate(head[0].cells if head else []):
        name, n = cell or f"column_{i}", 0
        while name in names:
            n += 1
            name = f"{cell or f'column_{i}'}_{n}"
        names.append(name)
    rows = of_sheet.where((F.col("row_no") > header_row) & F.exists("cells", lambda c: c.isNotNull()))
    file_name = F.element_at(F.split("path", "/"), -1).alias("source_file")
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], file_name)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a workbook, or of all workbooks of a folder or pattern."""
    return read_cells(spark.read.format("binaryFile").load(path).select("path", "content"))


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of some sheets: texts as shared strings, numbers and booleans as such, None as no cell."""
    shared: dict[str, int] = {}

    def cell(r: int, c: int, value) -> str:
        at = f'r="{_column_name(c)}{r + 1}"'
        if isinstance(value, bool):
            return f'<c {at} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c {at}><v>{value!r}</v></c>"
        return f'<c {at} t="s"><v>{shared.setdefault(str(value), len(shared))}</v></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, out = _MAIN[1:-1], io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets.values(), 1):
            if len(rows) > MOST_ROWS:
                raise ValueError(f"a sheet holds {MOST_ROWS} rows at most")
            lines = [f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows)]
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{_DOCUMENT}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        links += f'<Relationship Id="rId0" Type="{_DOCUMENT}/sharedStrings" Target="sharedStrings.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}">{links}</Relationships>')
        texts = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in shared)
        z.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{main}">{texts}</sst>')
        kinds = "".join(f'<Override PartName="/xl/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in
                        [("workbook.xml", "sheet.main"), ("sharedStrings.xml", "sharedStrings"), *[(f"worksheets/sheet{k}.xml", "worksheet") for k in range(1, len(sheets) + 1)]])
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{_DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    return out.getvalue()


def to_workbooks(df: DataFrame, book: str, sheet: str, title_rows: list[list[str]] | None = None) -> DataFrame:
    """(path, content): one workbook per value of column ``book`` with the other columns on a sheet, below the title rows and a header.

    A book's rows are brought together in a task: choose ``book`` so that no value has more rows than a sheet holds.
    """
    ship_package(df.sparkSession)
    columns = [c for c in df.columns if c != book]

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        body = rows[columns].astype(object)
        lines = [*(title_rows or []), columns, *body.where(body.notna(), None).values.tolist()]
        return pd.DataFrame({"path": [f"{rows[book].iloc[0]}.xlsx"], "content": [workbook_bytes({sheet: lines})]})

    return df.groupBy(book).applyInPandas(write, "path string, content binary")
