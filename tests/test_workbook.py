"""Workbooks: written and read, hand-made ones with all kinds of cells, and the severity sheet as a workbook."""

import io
import zipfile

import pytest

from lacuna.sources import csv as CSV
from lacuna.sources import workbook as WB

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _book(sheets, shared=None, absolute=False):
    """sheets: (name, XML of the rows)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if absolute else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared is not None:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
    return out.getvalue()


def test_cells_of_every_kind():
    shared = "<si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh></si><si><t></t></si>"
    rows = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>2</v></c></row>'
        '<row r="4"><c r="A4"><v>12.0</v></c><c r="B4"><v>0.1</v></c><c r="C4"><v>1E+20</v></c><c r="D4" t="b"><v>1</v></c><c r="E4" t="b"><v>0</v></c><c r="F4" t="e"><v>#N/A</v></c>'
        '<c r="G4" t="str"><f>A1</f><v>made</v></c><c r="H4" t="inlineStr"><is><t>in &amp; line</t></is></c><c r="I4"/><c r="AA4"><v>-3</v></c></row>'
        "<row><c><v>7</v></c><c><v>8</v></c></row>"
    )
    for absolute in (False, True):
        got = list(WB.sheet_rows(_book([("First", ""), ("Second", rows)], shared, absolute)))
        assert [(n, s, r) for n, s, r, _ in got] == [(1, "Second", 1), (1, "Second", 3), (1, "Second", 4)]
        assert got[0][3] == ["plain", None, "rich text", None]
        assert got[1][3] == ["12", "0.1", "1e+20", "TRUE", "FALSE", "#N/A", "made", "in & line", None, *[None] * 17, "-3"]
        assert got[2][3] == ["7", "8"]
    assert list(WB.sheet_rows(_book([("Empty", "")]))) == []


def test_written_workbooks_read_back():
    sheets = {'a "b" & <c>': [["x", None, 1, 2.5, True], [], ["  spaced ", "é", "x"]], "second": [["only"]]}
    got = list(WB.sheet_rows(WB.workbook_bytes(sheets)))
    assert got == [(0, 'a "b" & <c>', 0, ["x", None, "1", "2.5", "TRUE"]), (0, 'a "b" & <c>', 1, []), (0, 'a "b" & <c>', 2, ["  spaced ", "é", "x"]), (1, "second", 0, ["only"])]
    assert [WB._column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(WB._column_number(f"{WB._column_name(n)}9") == n for n in range(2000))


def test_a_folder_of_workbooks_is_one_table(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"b{i}.xlsx").write_bytes(WB.workbook_bytes({"notes": [["n"]], "data": [["title"], ["id", "v", None, "v"], [i, f"t{i}", "c", "d", "beyond"], [None, None], [i + 10, None]]}))
    cells = WB.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    got = WB.sheet_table(cells, "data", header_row=1)
    assert got.columns == ["id", "v", "column_2", "v_1", "source_file"]
    want = [r for i in range(3) for r in ((str(i), f"t{i}", "c", "d", f"b{i}.xlsx"), (str(i + 10), None, None, None, f"b{i}.xlsx"))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert WB.sheet_table(cells).columns == ["n", "source_file"]
    missing = WB.sheet_table(cells, "no such sheet")
    assert missing.columns == ["source_file"] and missing.count() == 0


def test_severity_workbook_equals_its_csv(spark, tmp_path):
    """The named sheet with its header in the second row, else the first sheet; numbers read as strings equal the CSV's; out of range is clipped."""
    rows = [["COUNTRY", "ISO3", "INFORM Severity Index", "Inform Risk", "Year"], ["Chad", "TCD", 4.5, "1,200", 2024], ["Mali", "MLI", "n/a", 2, 2024], ["Niger", "NER", 12, None, "x"], [None, "XXX", 3, 1, 2024]]
    (tmp_path / "a.xlsx").write_bytes(WB.workbook_bytes({"notes": [["n"]], "INFORM Severity - country": [["INFORM Severity", None], *rows]}))
    (tmp_path / "b.xlsx").write_bytes(WB.workbook_bytes({"Sheet1": rows}))
    (tmp_path / "c.csv").write_text("\n".join(",".join("" if v is None else f'"{v}"' for v in r) for r in rows))
    a, b = (CSV.severity_workbook(spark, str(tmp_path / n)).drop("source_file") for n in ("a.xlsx", "b.xlsx"))
    want = [("Chad", "TCD", 4.5, 1200.0, 2024), ("Niger", "NER", 10.0, None, None)]
    for df in (a, b):
        assert sorted(map(tuple, df.select("country", "iso3", "inform_severity", "inform_risk", "year").collect())) == want
    plain = CSV.severity_sheet(spark, str(tmp_path / "c.csv")).where("country is not null and inform_severity is not null")
    assert sorted((r.country, min(r.inform_severity, 10.0), r.inform_risk) for r in plain.collect()) == [(w[0], w[2], w[3]) for w in want]


def test_a_sheet_has_a_largest_size():
    with pytest.raises(ValueError):
        WB.workbook_bytes({"big": [[]] * (WB.MOST_ROWS + 1)})
