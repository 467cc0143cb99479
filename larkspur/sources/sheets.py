"""Workbooks (.xlsx) as a data source: spark.read.format("sheet") takes one task a workbook, df.write.format("sheet") writes one workbook or more a task.

Paths go through Arrow's file systems, so they may be local or remote. A workbook is
bounded by its format (1,048,576 rows a sheet); larger tables are many workbooks in
one folder.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the file format: limits, built-in number formats of dates, names of its parts.
MAX_ROWS, MAX_CHARS, EXACT_DIGITS = 1_048_576, 32_767, 15
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
STATIC_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def files_of(path: str) -> tuple[arrow_fs.FileSystem, str, list[str]]:
    """The file system, the place on it, and the workbooks there in the order of their names; hidden ones have no part."""
    system, place = arrow_fs.FileSystem.from_uri(path)
    info = system.get_file_info(place)
    if info.type == arrow_fs.FileType.File:
        return system, place, [place]
    found = system.get_file_info(arrow_fs.FileSelector(place, allow_not_found=True))
    return system, place, sorted(f.path for f in found if f.type == arrow_fs.FileType.File and f.base_name.lower().endswith(".xlsx") and f.base_name[0] not in "._~")


# Reading


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ET.Element) -> str:
    """The runs of a text, without phonetic hints."""
    parts = [x.text or "" for c in e for x in ([c] if _tag(c) == "t" else c if _tag(c) == "r" else []) if _tag(x) == "t"]
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """The rows of one sheet of an open workbook, read as a stream; only shared texts are held."""

    def __init__(self, file: Any, sheet: str | None = None, links: bool = False) -> None:
        self.zip = zipfile.ZipFile(file)
        names = set(self.zip.namelist())
        part = lambda n: ET.fromstring(self.zip.read(n)) if n in names else ET.Element("none")
        book = part("xl/workbook.xml")
        sheets = {s.get("name"): s.get(f"{{{OFFICE}}}id") for s in book.iter() if _tag(s) == "sheet"}
        if not sheets or (sheet and sheet not in sheets):
            raise ValueError(f"no sheet {sheet or ''} in the workbook; it has {sorted(sheets)}")
        target = self._targets(part("xl/_rels/workbook.xml.rels"))[sheets[sheet] if sheet else next(iter(sheets.values()))]
        self.sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.epoch = dt.datetime(1904, 1, 1) if any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book) else dt.datetime(1899, 12, 30)
        self.dates = self._date_styles(part("xl/styles.xml"))
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for e in self._ends("xl/sharedStrings.xml", "si"):
                self.shared.append(_text(e))
        folder, _, name = self.sheet.rpartition("/")
        targets = self._targets(part(f"{folder}/_rels/{name}.rels")) if links else {}
        self.links = {h.get("ref", "").partition(":")[0]: targets.get(h.get(f"{{{OFFICE}}}id"), "") for h in self._ends(self.sheet, "hyperlink")} if targets else {}

    def _ends(self, name: str, tag: str) -> Iterator[ET.Element]:
        with self.zip.open(name) as f:
            parents = []
            for event, e in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    parents.append(e)
                    continue
                parents.pop()
                if _tag(e) == tag:
                    yield e
                    if parents:
                        parents[-1].clear()

    @staticmethod
    def _targets(rels: ET.Element) -> dict[str | None, str]:
        return {r.get("Id"): r.get("Target", "") for r in rels}

    @staticmethod
    def _date_styles(styles: ET.Element) -> set[int]:
        own = {int(f.get("numFmtId", 0)) for f in styles.iter() if _tag(f) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
        cells = next((e for e in styles if _tag(e) == "cellXfs"), ())
        return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def _value(self, c: ET.Element) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return next((_text(x) for x in c if _tag(x) == "is"), None)
        v = next((x.text for x in c if _tag(x) == "v"), None)
        if v is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(v)]
        if kind == "b":
            return "true" if v.strip() == "1" else "false"
        if kind != "n":
            return ESCAPED.sub(lambda m: chr(int(m[1], 16)), v)
        number = float(v)
        if int(c.get("s", 0)) in self.dates:
            t = self.epoch + dt.timedelta(milliseconds=round(number * 86_400_000))
            return t.date().isoformat() if number == int(number) else t.isoformat(" ", "seconds" if not t.microsecond else "milliseconds")
        return str(int(number)) if number == int(number) and abs(number) < 10**EXACT_DIGITS else repr(number)

    def rows(self) -> Iterator[dict[int, str | None]]:
        """Cells by column of each row that has any."""
        for row in self._ends(self.sheet, "row"):
            cells, at = {}, -1
            for c in row:
                at = _column(c.get("r")) if c.get("r") else at + 1
                value, link = self._value(c), self.links.get(c.get("r", ""))
                cells[at] = "\n".join(x for x in (value, link) if x) if link else value
            if any(v is not None for v in cells.values()):
                yield cells


def _headers(cells: dict[int, str | None]) -> dict[str, int]:
    """Columns by their trimmed header; the first of equal ones (in any case) counts."""
    out: dict[str, int] = {}
    for i, v in sorted(cells.items()):
        if v and v.strip() and v.strip().casefold() not in {h.casefold() for h in out}:
            out[v.strip()] = i
    return out


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, links: bool, schema: T.StructType) -> None:
        if any(not isinstance(f.dataType, T.StringType) for f in schema):
            raise ValueError("columns of a sheet are strings; cast them after reading")
        self.path, self.sheet, self.links, self.columns = path, sheet, links, [f.name.casefold() for f in schema]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in files_of(self.path)[2]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        system, _ = arrow_fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.value) as f:
            rows = Workbook(f, self.sheet, self.links).rows()
            places = {h.casefold(): i for h, i in _headers(next(rows, {})).items()}
            where = [places.get(c, -1) for c in self.columns]
            for cells in rows:
                yield tuple(cells.get(i) for i in where)


# Writing


def _cell(v: Any) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.datetime):
        return f'<c s="2"><v>{(v.replace(tzinfo=None) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(v, dt.date):
        return f'<c s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
    if isinstance(v, (int, float, Decimal)):
        digits = len(v.as_tuple().digits) if isinstance(v, Decimal) else len(str(abs(v))) if isinstance(v, int) else 0
        if digits <= EXACT_DIGITS and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>" if not isinstance(v, Decimal) else f"<c><v>{v}</v></c>"
        v = str(v)
    if len(v) > MAX_CHARS:
        raise ValueError(f"a cell holds {MAX_CHARS} characters, not {len(v)}")
    coded = escape(CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", v))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{coded}</t></is></c>'


class SheetWriter(DataSourceWriter):
    """Each task writes workbooks into a hidden folder of the job; the commit moves those of the tasks that count, so a lost or repeated task leaves nothing."""

    def __init__(self, path: str, sheet: str, rows: int, schema: T.StructType, overwrite: bool) -> None:
        plain = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        if bad := [f.name for f in schema if not isinstance(f.dataType, plain)]:
            raise ValueError(f"cells hold texts, numbers, booleans and times, not {', '.join(bad)}")
        if not 2 <= rows <= MAX_ROWS:
            raise ValueError(f"a sheet has 2 to {MAX_ROWS} rows, its header included")
        self.path, self.sheet, self.rows, self.names, self.overwrite, self.job = path, sheet, rows, schema.names, overwrite, uuid.uuid4().hex

    def _workbook(self, system: arrow_fs.FileSystem, place: str, first: tuple | None, more: Iterator) -> bool:
        """Writes a workbook of the first row and as many more as fit; whether it is full."""
        left = self.rows - 1
        with system.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in STATIC_PARTS.items():
                z.writestr(name, text)
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as s:
                row = lambda r: s.write(f"<row>{''.join(map(_cell, r))}</row>".encode())
                s.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                row(self.names)
                if first is not None:
                    row(first)
                    left -= 1
                while left and first is not None and (r := next(more, None)) is not None:
                    row(r)
                    left -= 1
                s.write(b"</sheetData></worksheet>")
        return not left

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, place = arrow_fs.FileSystem.from_uri(self.path)
        folder, task, message = f"{place}/_job-{self.job}", uuid.uuid4().hex, WriterCommitMessage()
        system.create_dir(folder, recursive=True)
        message.files, rows = [], iter(iterator)
        while (first := next(rows, None)) is not None:
            name = f"part-{task}-{len(message.files):05d}.xlsx"
            self._workbook(system, f"{folder}/{name}", first, rows)
            message.files.append(name)
        return message

    def commit(self, messages: list) -> None:
        system, place, old = files_of(self.path)
        folder, files = f"{place}/_job-{self.job}", [f for m in messages if m is not None for f in m.files]
        system.create_dir(folder, recursive=True)
        if not files:
            files = [f"part-{self.job}-00000.xlsx"]
            self._workbook(system, f"{folder}/{files[0]}", None, iter(()))
        for f in files:
            system.move(f"{folder}/{f}", f"{place}/{f}")
        if self.overwrite:
            for f in old:
                system.delete_file(f)
        system.delete_dir(folder)

    def abort(self, messages: list) -> None:
        system, place = arrow_fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{place}/_job-{self.job}").type != arrow_fs.FileType.NotFound:
            system.delete_dir(f"{place}/_job-{self.job}")


class SheetSource(DataSource):
    """Options: path (a workbook or a folder of them, absolute or a URI), sheet (its name; the first), links (true: a cell's hyperlink follows its text on a line of its own), rows (of a workbook that is written).

    The schema is the headers of the first workbook, all strings; other workbooks may
    have them in another order. Missing columns, blank cells and error values are
    null; numbers, dates (ISO, to milliseconds) and booleans are written out; empty
    rows go. Integers of more than 15 digits are written as texts. A folder without
    workbooks needs a schema; an empty table is written as a header.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a sheet needs a path")
        return self.options["path"]

    def schema(self) -> T.StructType:
        system, _, files = files_of(self._path())
        for name in files:
            with system.open_input_file(name) as f:
                if found := _headers(next(Workbook(f, self.options.get("sheet")).rows(), {})):
                    return T.StructType([T.StructField(h, T.StringType()) for h in found])
        raise ValueError(f"no workbook with headers in {self._path()}")

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(self._path(), self.options.get("sheet"), self.options.get("links", "false").lower() == "true", schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self._path(), self.options.get("sheet", "Sheet1"), int(self.options.get("rows", MAX_ROWS)), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
