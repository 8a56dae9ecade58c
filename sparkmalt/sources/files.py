"""Files: kinds by name, archive members, sheets by link, table grids, dumps."""

from __future__ import annotations

import codecs
import csv
import io
import sys
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.sources.shared import small_batches

ENCODINGS = ["utf-8-sig", "cp1251"]  # of price lists, the first that fits; what fits none is read as the last, with marks for what it lacks
CELLS_AT_ONCE = 20_000


def file_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".pdf"), "pdf").when(n.rlike(r"\.xlsx?$"), "excel").when(n.endswith(".zip"), "zip").when(n.contains("docs.google.com/spreadsheets"), "google_sheets")


def export_url(url: Column) -> Column:
    """The CSV address of a shared sheet; null for other addresses."""
    key, gid = F.regexp_extract(url, "/d/([^/]+)", 1), F.regexp_extract(url, "[#&?]gid=([0-9]+)", 1)
    return F.when(key != "", F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), key, F.lit("/export?format=csv"), F.when(gid != "", F.concat(F.lit("&gid="), gid)).otherwise(F.lit(""))))


def one_by_one(rows: DataFrame, make: Callable[[dict], Iterable[tuple]], kinds: pa.Schema) -> DataFrame:
    """What ``make`` gives for each row, of which a task holds one at a time beside the packed batch."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for out in make(batch.slice(i, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.type}" for f in kinds))


CONTENTS = pa.schema([("file_id", pa.string()), ("content", pa.binary())])


def members(archives: DataFrame) -> DataFrame:
    """(archive, file_id, content): the files in zip archives (file_id, content), one file at a time."""

    def inside(row: dict) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
                for m in z.infolist():
                    if not m.is_dir() and "__MACOSX" not in m.filename:
                        yield row["file_id"], m.filename, z.read(m)
        except zipfile.BadZipFile:
            return

    kinds = pa.schema([("archive", pa.string()), *CONTENTS])
    return one_by_one(archives.select(F.col("file_id").cast("string").alias("file_id"), "content"), inside, kinds)


def with_looks(cells: DataFrame) -> DataFrame:
    """Cells of a source without hidden rows and fonts."""
    return cells.withColumns({"hidden": F.lit(False), "strike": F.lit(False), "font_rgb": F.lit(None).cast("string")})


def encoding(content: bytes) -> str:
    """The first of ENCODINGS in which the content can be read, checked piece by piece."""
    for name in ENCODINGS[:-1]:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            for at in range(0, len(content), 1 << 20):
                decoder.decode(content[at : at + (1 << 20)])
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            continue
        return name
    return ENCODINGS[-1]


def csv_records(contents: DataFrame, sheet: str = "csv", sep: str = ",") -> DataFrame:
    """CSV files (file_id, content) as cells; a record is as wide as it is, whatever stands above it.

    ``row_idx`` is the record's number in its file, blank ones counted, so quoted
    line ends make no rows. Cells of spaces alone are left out, as are files
    without content. Files are UTF-8, with or without a mark, or windows-1251. A
    file is read by one task, record by record, and cells go out in batches.
    """
    small_batches(contents.sparkSession)
    kinds = pa.schema([("file_id", pa.string()), ("row_idx", pa.int32()), ("col_idx", pa.int32()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                out: list[tuple] = []
                for r, record in enumerate(csv.reader(io.TextIOWrapper(io.BytesIO(data), encoding(data), errors="replace", newline=""), delimiter=sep)):
                    out += [(file_id, r, c, v) for c, v in enumerate(record) if v.strip()]
                    if len(out) >= CELLS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), names=kinds.names).cast(kinds)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), names=kinds.names).cast(kinds)

    cells = contents.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(run, "file_id string, row_idx int, col_idx int, value string")
    return with_looks(cells.select("file_id", F.lit(sheet).alias("sheet"), "row_idx", "col_idx", "value"))


def csv_cells(spark: SparkSession, path: str, sheet: str = "csv", sep: str = ",") -> DataFrame:
    """The CSV exports of a folder, or one of them, as cells (``csv_records``)."""
    return csv_records(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content"), sheet, sep)


def grid_cells(grid: DataFrame) -> DataFrame:
    """Cells of page tables (file_id, page, table, row, cells array); each table is a sheet."""
    sheet = F.format_string("p%05d-t%03d", F.col("page").cast("int"), F.col("table").cast("int"))
    cells = grid.select("file_id", sheet.alias("sheet"), F.col("row").cast("int").alias("row_idx"), F.posexplode("cells").alias("col_idx", "value"))
    return with_looks(cells.where(F.col("value").isNotNull() & (F.trim("value") != "")))


def text_dump(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, row_idx, text): the cells of a row, in order, joined by spaces."""
    return cells.groupBy("file_id", "sheet", "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "value"))), lambda x: x["value"]), " ").alias("text"))


def replace_files(items: DataFrame, path: str) -> None:
    """Writes items by file; a file that is parsed again replaces its own rows and no others."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)
