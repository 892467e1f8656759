"""Excel sheets read by Spark: the file comes as bytes, executors stream the rows of its sheet XML.

Cells are text: shared and inline strings as they are, numbers in their shortest form,
dates (by the number format of the cell) as ``yyyy-MM-dd``, with the time of day where there
is one, booleans as True and False. Empty cells and errors are null.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that leaves a task.
BATCH_ROWS = 2000
# Number formats of dates and times that a file need not spell out.
BUILT_IN_DATES = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node: ET.Element) -> str:
    """The text of a string with its runs; phonetic readings are not part of it."""
    return "".join(t.text or "" for part in node if part.tag != f"{_MAIN}rPh" for t in part.iter(f"{_MAIN}t")) if len(node) else node.text or ""


def _elements(archive: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """Finished elements of one part, freed once they have been used; none if the part is absent."""
    if name not in archive.namelist():
        return
    with archive.open(name) as part:
        above: list[ET.Element] = []
        for event, node in ET.iterparse(part, events=("start", "end")):
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if node.tag == f"{_MAIN}{tag}":
                yield node
                if above:
                    above[-1].clear()


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Styles of cells whose number format is one of dates or times."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ET.parse(archive.open("xl/styles.xml")).getroot()
    own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{_MAIN}numFmt")}

    def is_date(number: int) -> bool:
        if number not in own:
            return number in BUILT_IN_DATES
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own[number])
        return bool(re.search("[ymdhs]", bare, re.IGNORECASE)) and "General" not in bare

    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate([] if formats is None else formats) if is_date(int(x.get("numFmtId", 0)))}


def _sheet_part(archive: zipfile.ZipFile, sheet: str | int) -> tuple[str, bool]:
    """The part of a sheet, by name or place from 0, and whether the book counts days from 1904."""
    book = ET.parse(archive.open("xl/workbook.xml")).getroot()
    sheets = [(n.get("name"), n.get(_RELATED)) for n in book.iter(f"{_MAIN}sheet")]
    wanted = [r for i, (name, r) in enumerate(sheets) if (i == sheet if isinstance(sheet, int) else name == sheet)]
    if not wanted:
        raise KeyError(f"no sheet {sheet!r} among {[name for name, _ in sheets]}")
    links = ET.parse(archive.open("xl/_rels/workbook.xml.rels")).getroot()
    target = next(n.get("Target") for n in links if n.get("Id") == wanted[0])
    settings = book.find(f"{_MAIN}workbookPr")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", settings is not None and settings.get("date1904") in ("1", "true")


def _place(reference: str) -> int:
    """Column of a cell reference, from 0."""
    at = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        at = 26 * at + ord(letter) - 64
    return at - 1


def _date_text(value: float, since_1904: bool) -> str:
    """A serial day as text; before 1 March 1900 serials count a day that never was."""
    first = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30 if value >= 60 else 31)
    moment = first + dt.timedelta(seconds=round(value * 86400))
    return moment.strftime("%Y-%m-%d" if value == int(value) else "%Y-%m-%d %H:%M:%S")


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells) of a sheet in order, one row at a time."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    part, since_1904 = _sheet_part(archive, sheet)
    strings, dates = [_text(n) for n in _elements(archive, "xl/sharedStrings.xml", "si")], _date_styles(archive)

    def cell(node: ET.Element) -> str | None:
        kind, value = node.get("t", "n"), node.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = node.find(f"{_MAIN}is")
            return None if inline is None else _text(inline)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(value)]
        if kind == "b":
            return str(value == "1")
        if kind != "n":
            return value
        number = float(value)
        if int(node.get("s", 0)) in dates:
            return _date_text(number, since_1904)
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)

    before = 0
    for row in _elements(archive, part, "row"):
        before = int(row.get("r", before + 1))
        cells: list[str | None] = []
        for node in row.iter(f"{_MAIN}c"):
            at = _place(node.get("r")) if node.get("r") else len(cells)
            cells += [None] * (at - len(cells))
            cells.append(cell(node))
        if any(c is not None for c in cells):
            yield before - 1, cells


def read_sheet(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """Columns of a sheet as text, named by its first row that holds anything, with row_idx in their order.

    A header cell without text is named ``column_`` and its place; a name that occurs again gets
    ``_`` and a number. The file is read wherever Spark reads; a task holds the packed file and its shared
    strings, and a batch of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, kind = [], pa.list_(pa.string())
                for row in sheet_rows(content.as_buffer().to_pybytes(), 0 if sheet is None else sheet):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), kind))], names=["row_idx", "cells"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), kind))], names=["row_idx", "cells"])

    cells = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_idx long, cells array<string>")
    head = cells.limit(1).head()
    if head is None:
        raise ValueError(f"no rows in {path}")
    names: list[str] = []
    for i, name in enumerate(head.cells):
        plain = (name or "").strip() or f"column_{i}"
        used = [n for n in names if n == plain or n.startswith(f"{plain}_")]
        names.append(plain if plain not in names else f"{plain}_{len(used)}")
    columns = [F.get("cells", i).alias(name) for i, name in enumerate(names)]
    return cells.where(F.col("row_idx") > head.row_idx).select(*columns, "row_idx")


def workbook(rows: Iterator[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet of dates, numbers and strings; None is an empty cell. A sheet has a million rows at most, so this is for small tables."""
    from xml.sax.saxutils import escape

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, dt.date):
            return f'<c s="1"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    base = "http://schemas.openxmlformats.org"
    main, office, package = f"{base}/spreadsheetml/2006/main", f"{base}/officeDocument/2006/relationships", f"{base}/package/2006"
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/>'
        f'<Override PartName="/xl/styles.xml" ContentType="{types}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="r2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return out.getvalue()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file wherever Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(content))
    stream.close()
