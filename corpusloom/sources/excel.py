"""Excel workbooks as a Spark data source: ``spark.read.format("xlsx")`` and ``df.write.format("xlsx")`` after ``register(spark)``.

A workbook is a zip of XML files. Reading streams them: a sheet is a partition, its XML is inflated and parsed piece by piece, rows
leave in Arrow batches, and shared strings are kept in small compressed blocks. So neither a sheet nor its strings are ever in
memory as a whole. Writing streams the rows of each task into a workbook of its own.

Paths are opened through Arrow's file systems: local and mounted folders, and the stores Arrow knows.
"""

from __future__ import annotations

import datetime
import functools
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that is read, strings of a block of shared strings, and how many such blocks are unpacked at a time.
BATCH_ROWS, BLOCK, UNPACKED = 512, 256, 64
#: Rows of a sheet that is written; the format allows 1,048,576 with the header. Strings of at most ``SHORT`` characters are shared,
#: until there are ``SHARED`` of them.
SHEET_ROWS, SHORT, SHARED = 1_000_000, 40, 20_000

#: Names, number formats of dates and times, and the day numbers count from, as the format has them.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DAY_ZERO, DAY_ZERO_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
NEEDS_ESCAPE = re.compile("_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f￾￿]")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _workbooks(path: str) -> list[str]:
    """``path`` itself, or the workbooks in the folder it names, in order of their names."""
    store, where = _located(path)
    if store.get_file_info(where).type != fs.FileType.Directory:
        return [where]
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    names = (f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".xlsx"))
    return sorted(name for name in names if not re.search(r"(^|/)[._~]", name[len(where) :]))


def _elements(file, *tags: str) -> Iterator[ElementTree.Element]:
    """Elements with one of ``tags`` at any depth, each dropped again once it has been used."""
    names, path = {MAIN + tag for tag in tags}, []
    for event, element in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            path.append(element)
        else:
            path.pop()
            if element.tag in names:
                yield element
            if element.tag in names or not any(e.tag in names for e in path):
                element.clear()
                if path:
                    path[-1].remove(element)


def _unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _string(element: ElementTree.Element) -> str:
    """Text of a string item: its own, or that of its runs; phonetic hints are left out."""
    texts = (t.text or "" for child in element if child.tag != MAIN + "rPh" for t in ([child] if child.tag == MAIN + "t" else child.iter(MAIN + "t")))
    return _unescaped("".join(texts))


class _SharedStrings:
    """Strings by number, held in compressed blocks."""

    def __init__(self, book: zipfile.ZipFile) -> None:
        self.blocks: list[bytes] = []
        self.unpacked = functools.lru_cache(UNPACKED)(lambda k: json.loads(zlib.decompress(self.blocks[k])))
        if "xl/sharedStrings.xml" not in book.namelist():
            return
        held: list[str] = []
        with book.open("xl/sharedStrings.xml") as file:
            for item in _elements(file, "si"):
                held.append(_string(item))
                if len(held) == BLOCK:
                    self._keep(held)
        self._keep(held)

    def _keep(self, held: list[str]) -> None:
        self.blocks.append(zlib.compress(json.dumps(held).encode(), 1))
        held.clear()

    def __getitem__(self, number: int) -> str:
        return self.unpacked(number // BLOCK)[number % BLOCK]


class _Workbook:
    def __init__(self, base: str, path: str) -> None:
        """The workbook that the file system of ``base`` calls ``path``."""
        self.file = _located(base)[0].open_input_file(path)
        self.zip = zipfile.ZipFile(self.file)
        names = self.zip.namelist()
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for relation in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")):
                target = relation.get("Target", "")
                targets[relation.get("Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): targets[s.get(RELATION)] for s in book.iter(MAIN + "sheet") if "worksheets/" in targets.get(s.get(RELATION), "")}
        settings = book.find(MAIN + "workbookPr")
        later = settings is not None and settings.get("date1904") in ("1", "true")
        self.zero = DAY_ZERO_1904 if later else DAY_ZERO
        self.dated = self._dated() if "xl/styles.xml" in names else set()

    def __enter__(self) -> _Workbook:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def _dated(self) -> set[int]:
        """Numbers of the cell styles that show a number as a date or a time."""
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]hms]*\]', "", f.get("formatCode", "")) for f in styles.iter(MAIN + "numFmt")}
        dates = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code, re.IGNORECASE) and "general" not in code.lower()}
        formats = styles.find(MAIN + "cellXfs")
        return {k for k, f in enumerate(formats if formats is not None else ()) if int(f.get("numFmtId", 0)) in dates}

    def rows(self, sheet: str) -> Iterator[dict[int, object]]:
        """Values by column for each row that has any: texts, numbers, truth values, points in time."""
        strings = None
        with self.zip.open(self.sheets[sheet]) as file:
            for row in _elements(file, "row"):
                values, column = {}, -1
                for cell in row.iter(MAIN + "c"):
                    column = _column(cell.get("r")) if cell.get("r") else column + 1
                    kind, value = cell.get("t", "n"), cell.findtext(MAIN + "v")
                    if kind == "inlineStr":
                        item = cell.find(MAIN + "is")
                        found = None if item is None else _string(item)
                    elif value is None or kind == "e":
                        continue
                    elif kind == "s":
                        strings = strings or _SharedStrings(self.zip)
                        found = strings[int(value)]
                    elif kind == "b":
                        found = value.strip() == "1"
                    elif kind == "str":
                        found = _unescaped(value)
                    elif kind == "d":
                        found = datetime.datetime.fromisoformat(value)
                    elif int(cell.get("s", 0)) in self.dated:
                        found = self.zero + datetime.timedelta(milliseconds=round(float(value) * 86_400_000))
                    else:
                        found = float(value) if re.search("[.eE]", value) else int(value)
                    if found is not None and found != "":
                        values[column] = found
                if values:
                    yield values


def _column(place: str) -> int:
    number = 0
    for letter in place:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _letters(column: int) -> str:
    name = ""
    while column >= 0:
        name = chr(65 + column % 26) + name
        column = column // 26 - 1
    return name


def _as(kind: T.DataType, value: object) -> object:
    """A value of a sheet as one of the column's type; None where it is not one."""
    try:
        if isinstance(kind, T.StringType):
            if isinstance(value, datetime.datetime):
                return value.date().isoformat() if value.time() == datetime.time() else value.isoformat(" ", "milliseconds" if value.microsecond else "seconds")
            if isinstance(value, bool):
                return str(value).lower()
            return str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 else str(value)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            when = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))
            return when.date() if isinstance(kind, T.DateType) else when
        if isinstance(value, datetime.datetime):
            return None
        if isinstance(kind, T.BooleanType):
            return bool(value) if isinstance(value, (bool, int, float)) else {"true": True, "false": False}.get(value.strip().lower())
        number = float(value) if isinstance(kind, T.FractionalType) else value if isinstance(value, int) else float(value)
        if isinstance(kind, T.IntegralType):
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
            return int(number) if number == int(number) and -(2 ** (bits - 1)) <= number < 2 ** (bits - 1) else None
        return number
    except (ValueError, OverflowError):
        return None


@dataclass
class _Sheet(InputPartition):
    path: str
    sheet: str


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[_Sheet]:
        wanted, parts = self.options.get("sheet"), []
        for path in _workbooks(self.options["path"]):
            with _Workbook(self.options["path"], path) as book:
                names = list(book.sheets)
            parts += [_Sheet(path, name) for name in (names if wanted == "*" else names[:1] if wanted is None else [wanted] if wanted in names else [])]
        return parts

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        with _Workbook(self.options["path"], partition.path) as book:
            rows = book.rows(partition.sheet)
            header = {str(name): column for column, name in reversed((next(rows, None) or {}).items())}
            places = [header.get(name) for name in self.schema.names]
            held: list[dict[int, object]] = []
            for row in rows:
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield self._batch(held, places, shape)
                    held = []
            if held:
                yield self._batch(held, places, shape)

    def _batch(self, rows: list[dict[int, object]], places: list[int | None], shape: pa.Schema) -> pa.RecordBatch:
        columns = []
        for field, place, kind in zip(self.schema, places, shape, strict=True):
            values = (row.get(place) for row in rows)
            columns.append(pa.array([None if value is None else _as(field.dataType, value) for value in values], kind.type))
        return pa.RecordBatch.from_arrays(columns, schema=shape)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool) -> None:
        self.schema, self.path, self.overwrite, self.job = schema, options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """One workbook; it gets its name only once it is whole, so that a task that ran twice leaves one."""
        store, folder = _located(self.path)
        store.create_dir(folder)
        name = f"{folder.rstrip('/')}/_{self.job}-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
            rows = _fill(book, self.schema, iterator)
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _located(self.path)
        written = [m for m in messages if m is not None]
        store.create_dir(folder)
        if self.overwrite:
            for old in _workbooks(self.path):
                store.delete_file(old)
        for k, message in enumerate(written):
            store.move(message.path, f"{folder.rstrip('/')}/part-{k:05d}-{self.job}.xlsx")
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what tasks left that failed or ran twice."""
        store, folder = _located(self.path)
        for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if found.base_name.startswith(f"_{self.job}"):
                store.delete_file(found.path)


def _fill(book: zipfile.ZipFile, schema: T.StructType, batches: Iterator[pa.RecordBatch]) -> int:
    """Write a workbook: rows as they come, a new sheet where one is full, and the parts that name them at the end."""
    shared: dict[str, int] = {}
    letters = [_letters(k) for k in range(len(schema))]
    sheets, count, total, file = 0, SHEET_ROWS, 0, None

    def text(value: str) -> str:
        return escape(NEEDS_ESCAPE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))

    def cell(place: str, value: object) -> str:
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{place}"><v>{value!r}</v></c>' if value == value and abs(value) != float("inf") else ""
        if isinstance(value, (datetime.datetime, datetime.date)):
            when = value if isinstance(value, datetime.datetime) else datetime.datetime.combine(value, datetime.time())
            return f'<c r="{place}" s="1"><v>{(when.replace(tzinfo=None) - DAY_ZERO) / datetime.timedelta(days=1)!r}</v></c>'
        value = str(value)
        if len(value) <= SHORT and (value in shared or len(shared) < SHARED):
            return f'<c r="{place}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{text(value)}</t></is></c>'

    def row(number: int, values: list[object]) -> bytes:
        cells = (cell(f"{letter}{number}", value) for letter, value in zip(letters, values, strict=True) if value is not None)
        return f'<row r="{number}">{"".join(cells)}</row>'.encode()

    def closed() -> None:
        file.write(b"</sheetData></worksheet>")
        file.close()

    def opened():
        new = book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True)
        new.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode() + row(1, schema.names))
        return new

    for batch in batches:
        for values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if count == SHEET_ROWS:
                if file:
                    closed()
                sheets, count = sheets + 1, 0
                file = opened()
            count, total = count + 1, total + 1
            file.write(row(count + 1, list(values)))
    if file is None:
        sheets = 1
        file = opened()
    closed()
    with book.open("xl/sharedStrings.xml", "w") as strings:
        strings.write(f'<sst xmlns="{MAIN[1:-1]}">'.encode())
        for value in shared:
            strings.write(f'<si><t xml:space="preserve">{text(value)}</t></si>'.encode())
        strings.write(b"</sst>")
    office, package = RELATION[1:-3], "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    parts = [("workbook", "sheet.main"), ("styles", "styles"), ("sharedStrings", "sharedStrings"), *((f"worksheets/sheet{k}", "worksheet") for k in range(1, sheets + 1))]
    types = "".join(f'<Override PartName="/xl/{name}.xml" ContentType="{kind}{type}+xml"/>' for name, type in parts)
    default = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types">{default}{types}</Types>')
    book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    links = [("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, sheets + 1)] + [("styles", "styles.xml"), ("sharedStrings", "sharedStrings.xml")]
    relations = "".join(f'<Relationship Id="rId{k}" Type="{office}/{type}" Target="{target}"/>' for k, (type, target) in enumerate(links, 1))
    book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{relations}</Relationships>')
    named = "".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="rId{k}"/>' for k in range(1, sheets + 1))
    book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{named}</sheets></workbook>')
    plain = "<fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs>"
    book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN[1:-1]}">{plain}<cellXfs><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
    return total


class ExcelSource(DataSource):
    """Format ``xlsx``. The first row of a sheet names its columns; columns of the schema are found by name, and one that a sheet
    lacks is null there. Without a schema, all columns of the first sheet are strings.

    Option ``sheet``: a name, or ``*`` for all sheets; by default the first one. Rows without any value are left out; an empty cell, an
    empty text and an error are null, and so is a value that is not of its column's type. Numbers that are shown as dates become dates
    (in a string column: ``2024-05-06``, with the time where there is one).
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        for path in _workbooks(self.options["path"]):
            with _Workbook(self.options["path"], path) as book:
                wanted = self.options.get("sheet")
                sheet = wanted if wanted in book.sheets else next(iter(book.sheets))
                return T.StructType([T.StructField(str(name), T.StringType()) for _, name in sorted(next(book.rows(sheet), {}).items())])
        raise FileNotFoundError(f"no workbook in {self.options['path']}; name a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExcelSource)
