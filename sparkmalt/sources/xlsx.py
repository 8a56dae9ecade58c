"""Workbooks as cells, and a small writer for tests and exports.

A workbook can't be split, so a task decodes whole files, one at a time, from
Spark's ``binaryFile`` rows; everything after that works on cells. Sheets and
strings are parsed as they are unpacked, row by row, and cells go out in batches:
what a task holds is the packed file, its shared strings and one batch.
"""

from __future__ import annotations

import io
import itertools
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file_id string, sheet string, row_idx int, col_idx int, value string, hidden boolean, strike boolean, font_rgb string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS_AT_ONCE = 20_000
SKIPPED_SHEETS = ["инструк", "instruction", "readme", "условия", "доставка", "контакт", "contact", "оглавление"]  # fixed values


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ET.Element]:
    """The elements of one kind in a part of a workbook, each gone when the next is asked for."""
    with book.open(part) as f:
        above: list[ET.Element] = []
        for event, e in ET.iterparse(f, events=("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == f"{MAIN}{tag}":
                yield e
                if above:
                    above[-1].clear()


def cells_in(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, int, bool, ET.Element]]:
    """(row, column, hidden, cell) of a sheet; places that the file doesn't name follow on from the ones before."""
    row = -1
    for r in elements(book, part, "row"):
        row = int(r.get("r")) - 1 if r.get("r") else row + 1
        hidden, column = r.get("hidden") in ("1", "true"), -1
        for cell in r.iter(f"{MAIN}c"):
            column = column_number(cell.get("r")) if cell.get("r") else column + 1
            yield row, column, hidden, cell


def parts_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), links[s.get(LINK)]) for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    return [(name, target if target.startswith("xl/") else f"xl/{target}") for name, target in sheets]


def checked(content: bytes) -> zipfile.ZipFile:
    """The opened workbook; raises ValueError for a file that is none, before any cell is given.

    Every sheet must be there and well formed; a first pass that keeps nothing sees to that.
    """
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        fonts_of(book, set(book.namelist()))
        for part in [p for _, p in parts_of(book)] + [p for p in book.namelist() if p == "xl/sharedStrings.xml"]:
            with book.open(part) as f:
                expat.ParserCreate().ParseFile(f)
    except (zipfile.BadZipFile, zlib.error, KeyError, IndexError, AttributeError, ET.ParseError, expat.ExpatError) as e:
        raise ValueError(f"no workbook: {type(e).__name__}") from e
    return book


def decode(file_id: str, content: bytes) -> Iterator[tuple]:
    """Cells of all sheets of a workbook; raises ValueError for a file that is none. A cell whose shared string isn't there is empty."""
    book = checked(content)
    names = set(book.namelist())
    shared = [texts(s) for s in elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
    looks = fonts_of(book, names)
    for sheet, part in parts_of(book):
        for row, column, hidden, cell in cells_in(book, part):
            kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
            if kind == "inlineStr":
                value = texts(cell)
            elif kind == "s" and value:
                value = shared[int(value)] if value.isdecimal() and int(value) < len(shared) else None
            if value is not None and value != "":
                strike, rgb = looks.get(cell.get("s"), (False, None))
                yield file_id, sheet, row, column, value, hidden, strike, rgb


def fonts_of(book: zipfile.ZipFile, names: set[str]) -> dict[str, tuple[bool, str | None]]:
    """(struck out, colour) by cell style."""
    if "xl/styles.xml" not in names:
        return {}
    root = ET.fromstring(book.read("xl/styles.xml"))
    fonts = [(f.find(f"{MAIN}strike") is not None, c.get("rgb") if (c := f.find(f"{MAIN}color")) is not None else None) for f in root.iterfind(f"{MAIN}fonts/{MAIN}font")]
    return {str(i): fonts[int(x.get("fontId", 0))] for i, x in enumerate(root.iterfind(f"{MAIN}cellXfs/{MAIN}xf")) if fonts}


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of workbooks (file_id, content); files that are no workbooks give none (see ``unreadable``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in CELLS.split(", ")]
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    cells = decode(file_id, bytes(content or b""))
                    while part := list(itertools.islice(cells, CELLS_AT_ONCE)):
                        yield pd.DataFrame(part, columns=names)
                except ValueError:
                    continue

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInPandas(run, CELLS)


def unreadable(files: DataFrame) -> DataFrame:
    """(file_id, error) of the files that are no workbooks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    checked(bytes(content or b""))
                except ValueError as e:
                    yield pd.DataFrame([(file_id, str(e))], columns=["file_id", "error"])

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInPandas(run, "file_id string, error string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return cells_of(found.select(F.col("path").alias("file_id"), "content"))


def product_sheets(cells: DataFrame) -> DataFrame:
    """Cells of sheets that aren't instructions, contacts and the like."""
    return cells.where(~F.lower("sheet").rlike("|".join(SKIPPED_SHEETS)))


def active_rows(cells: DataFrame, first_cells: int = 10) -> DataFrame:
    """Rows (file_id, sheet, row_idx, cells: an array of col_idx and value) but those that are hidden, or struck out or grey in one of their first cells.

    Cells are made once, and no list of the rows that go is sent around.
    """
    part = lambda i: F.conv(F.substring("font_rgb", i, 2), 16, 10).cast("int")
    r, g, b = part(-6), part(-4), part(-2)
    grey = (F.greatest(r, g, b) - F.least(r, g, b) < 30) & ((r + g + b) / 3 < 200) & ((r + g + b) > 0)
    off = F.col("hidden") | ((F.col("col_idx") < first_cells) & (F.coalesce("strike", F.lit(False)) | F.coalesce(grey, F.lit(False))))
    rows = cells.groupBy("file_id", "sheet", "row_idx").agg(F.max(off).alias("off"), F.collect_list(F.struct("col_idx", "value")).alias("cells"))
    return rows.where(~F.coalesce("off", F.lit(False))).drop("off")


def cells_of_rows(rows: DataFrame) -> DataFrame:
    """Rows with an array of cells as cells."""
    return rows.select("file_id", "sheet", "row_idx", F.inline("cells"))


def workbook(sheets: dict[str, list[list]], hidden: tuple[int, ...] = ()) -> bytes:
    """A workbook of inline texts and numbers; rows whose index is in ``hidden`` are hidden."""

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def cell(r: int, c: int, v: object) -> str:
        ref = f"{letters(c)}{r + 1}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns, rel = MAIN[1:-1], LINK[1:-3]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i + 1}" Target="worksheets/s{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}"' + ' hidden="1"' * (r in hidden) + ">" + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            book.writestr(f"xl/worksheets/s{i + 1}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
