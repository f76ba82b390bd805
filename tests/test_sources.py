"""Workbooks of many shapes, and rows that do not fit."""

import datetime
import zipfile

import pytest

from corpusloom.sources import excel, readers, writers

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, strings="", styles=None, settings=""):
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{name}" sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(sheets))
        links = "".join(f'<Relationship Id="r{k}" Target="/xl/worksheets/s{k}.xml"/>' for k in range(len(sheets)))
        book.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{OFFICE}">{settings}<sheets>{names}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values()):
            book.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        if styles:
            book.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")


def header(*names):
    return "<row>" + "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in names) + "</row>"


def read(spark, path, schema=None, **options):
    excel.register(spark)
    reader = spark.read.format("xlsx").options(**options)
    return reader.schema(schema).load(str(path)) if schema else reader.load(str(path))


def test_kinds_of_cells(spark, tmp_path):
    strings = "<si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si><si><t>a_x000D_b &amp; _x005F_x0041_</t></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="[$-409]d\\-mmm"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    rows = header("t", "n", "d", "b") + (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>12</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="3"><c r="D3" t="b"><v>0</v></c></row><row r="4"/><row r="5"><c r="A5" t="s"><v>1</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" s="2"><v>45292.75</v></c></row>'
        '<row r="7"><c r="A7" t="s"><v>2</v></c><c r="B7" s="3"><v>1.5</v></c></row><row><c t="str"><v>made</v></c><c t="inlineStr"><is><t>x</t></is></c></row>'
    )
    workbook(tmp_path / "a.xlsx", {"one": rows}, strings, styles)
    got = [tuple(r) for r in read(spark, tmp_path / "a.xlsx", "t string, n long, d string, b boolean, missing int").collect()]
    assert got == [
        ("plain", 12, "2024-01-01", True, None),
        (None, None, None, False, None),
        ("rich text", None, "2024-01-01 18:00:00", None, None),
        ("a\rb & _x0041_", None, None, None, None),
        ("made", None, None, None, None),
    ]
    dates = read(spark, tmp_path / "a.xlsx", "d date, n double, t timestamp_ntz").collect()
    assert dates[0][0] == datetime.date(2024, 1, 1) and dates[3][1] == 1.5 and dates[0][2] is None


def test_sheets_folders_and_the_other_calendar(spark, tmp_path):
    one = header("id", "x") + '<row><c><v>1</v></c><c s="1"><v>0</v></c></row>'
    two = header("x", "id") + '<row><c><v>7.5</v></c><c r="B2"><v>2</v></c></row>'
    style = '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs>'
    workbook(tmp_path / "a.xlsx", {"one": one, "two": two}, styles=style, settings='<workbookPr date1904="1"/>')
    workbook(tmp_path / "b.xlsx", {"two": two})
    workbook(tmp_path / "c.xlsx", {"one": header("id")})
    workbook(tmp_path / "~$b.xlsx", {"two": two})
    read_all = lambda **o: sorted((tuple(r) for r in read(spark, tmp_path, "id long, x string", **o).collect()), key=str)
    assert read_all() == [(1, "1904-01-01"), (2, "7.5")]
    assert read_all(sheet="two") == [(2, "7.5"), (2, "7.5")]
    assert read_all(sheet="*") == [(1, "1904-01-01"), (2, "7.5"), (2, "7.5")]
    assert read(spark, tmp_path, sheet="two").dtypes == [("x", "string"), ("id", "string")]
    assert read(spark, f"file://{tmp_path}", sheet="two").count() == 2


def test_round_trip_over_several_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(excel, "SHEET_ROWS", 7)
    texts = [None, "", " lead and trail ", "<&>\"'", "a\r\nb\tc", "\x0b\x1f_x000D_", "x" * 40_000, "é日😀", "repeated"]
    rows = [(k, texts[k % len(texts)], k / 4, datetime.datetime(2020, 1, 1, 12, k), k % 2 == 0) for k in range(50)]
    schema = "id long, text string, x double, at timestamp_ntz, even boolean"
    table = spark.createDataFrame(rows, schema).repartition(3)
    for _ in range(2):
        writers.write_raw(table, str(tmp_path / "out"), "xlsx")
    assert all(p.name.startswith("part-") for p in (tmp_path / "out").iterdir()) and len(list((tmp_path / "out").iterdir())) == 3
    got = sorted(tuple(r) for r in read(spark, tmp_path / "out", schema, sheet="*").collect())
    assert got == [(k, text or None, *rest) for k, text, *rest in rows]
    assert read(spark, tmp_path / "out", schema).count() == 21
    writers.write_raw(table.limit(0), str(tmp_path / "none"), "xlsx")
    assert read(spark, tmp_path / "none", schema).count() == 0


def test_a_sheet_is_streamed(spark, tmp_path):
    """Reading the first rows of a sheet of 100 MB takes next to no memory."""
    import tracemalloc

    row = "<row><c><v>1</v></c><c t=\"inlineStr\"><is><t>" + "word " * 200 + "</t></is></c></row>"
    strings = "".join(f"<si><t>string {k}</t></si>" for k in range(20_000))
    workbook(tmp_path / "a.xlsx", {"one": header("id", "t") + row * 100_000}, strings)
    tracemalloc.start()
    with excel._Workbook(str(tmp_path), str(tmp_path / "a.xlsx")) as book:
        assert sum(1 for _ in book.rows("one")) == 100_001
        assert excel._SharedStrings(book.zip)[19_999] == "string 19999"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_rows_that_do_not_fit(spark, tmp_path, fmt):
    lines = {
        "json": ['{"doc_id": 1, "headline": "a"}', '{"doc_id": 2, "headl', '{"doc_id": "three", "headline": "c"}', "", "[4", '{"doc_id": 5}'],
        "csv": ["doc_id,headline", "1,a", "three,c", "4,d,e", "5,f"],
    }[fmt]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("\n".join(lines) + "\n")
    checked = readers.read_checked(spark, str(tmp_path / "in"), fmt, readers.T.StructType.fromDDL("doc_id long, headline string"))
    assert sorted(r[0] for r in readers.fitting(checked).collect()) == [1, 5]
    writers.write_quarantine(checked, str(tmp_path / "bad"))
    bad = {r["bad_record"]: r["kind"] for r in spark.read.json(str(tmp_path / "bad")).collect()}
    if fmt == "json":
        assert bad == {lines[1]: "misfit", lines[2]: "misfit", "[4": "broken"} or bad == {lines[1]: "broken", lines[2]: "misfit", "[4": "broken"}
    else:
        assert bad == {"three,c": "misfit", "4,d,e": "misfit"}
    with pytest.raises(ValueError):
        readers.read_checked(spark, "x", "parquet")
