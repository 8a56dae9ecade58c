"""Writes beside Spark's own writers: changes by id, order forms as cells, CSV and JSON texts, run logs, metadata.

Tables are folders of Parquet; a change writes a new version beside the old one
and gives its path, so readers of the old one aren't disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean, settled
from sparkmalt.operators import changes
from sparkmalt.operators.headers import SHEET, heading

# Greatest lengths of the text fields of an item: fixed values.
LENGTHS = {"brewery": 200, "beer_name": 200, "style": 100, "ibu": 50, "currency": 10, "format_type": 50, "stock": 100, "supplier_name": 200}
ORDER_HEADINGS = ["наименование пивоварни", "наименование", "стиль", "abv", "цена"]  # fixed values
BOM = "﻿"


def updated_by_id(rows: DataFrame, edits: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``rows`` with the fields of ``edits`` (key and some columns) in place where they aren't null.

    Of several edits of a field the last by the column ``order`` wins; without it, or where it ties, the greatest value.
    """
    fields = [c for c in edits.columns if c not in (key, order)]
    by = lambda c: F.struct(*([order] if order else []), c)
    new = edits.groupBy(key).agg(*[F.max(F.when(F.col(c).isNotNull(), by(c)))[c].alias(f"__{c}") for c in fields])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(F.col(f"__{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def deleted_by_id(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` without those whose key is in ``ids``; null keys stay."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def truncated(items: DataFrame) -> DataFrame:
    """Text fields cut to the lengths that the table allows."""
    return items.withColumns({c: F.substring(F.col(c), 1, n) for c, n in LENGTHS.items() if c in items.columns})


def sheet_in_book(names: Column, original: Column, explicit: Column) -> Column:
    """The name of a sheet as the workbook spells it: as given, the original one first, else without regard to case, else the first sheet."""
    tries = F.filter(F.array(original, explicit), lambda x: clean(x) != "")
    exact = F.get(F.filter(tries, lambda x: F.array_contains(names, x)), F.lit(0))
    loose = F.get(F.flatten(F.transform(tries, lambda t: F.filter(names, lambda n: F.lower(F.trim(n)) == F.lower(F.trim(t))))), F.lit(0))
    return F.coalesce(exact, loose, F.get(names, F.lit(0)))


def order_columns(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, header_row, order_col, last_row) of order forms, counted from 1 as in a workbook.

    The heading row is of rows 2 to 5 the first with 'кол-во' (no packaging
    heading) and two known headings, else with 'заказ' and two, else with two;
    else row 2. The order column is the first with 'заказ' or 'кол-во' in it,
    else a new one on the right.
    """
    h = heading(F.col("value"))
    amount, order = h.contains("кол-во") & ~h.contains("тип фасовки"), h.contains("заказ")
    row, col = F.col("row_idx") + 1, F.col("col_idx") + 1
    near = cells.where(row.between(2, 5) & (col < 15))
    known = F.count_if(h.rlike("|".join(ORDER_HEADINGS)))
    per = near.groupBy(*SHEET, row.alias("row")).agg(F.max(amount).alias("amount"), F.max(order).alias("order"), known.alias("known")).where("known >= 2")
    rank = F.when(F.col("amount"), 0).when(F.col("order"), 1).otherwise(2)
    heads = per.groupBy(*SHEET).agg(F.min(F.struct(rank.alias("rank"), "row"))["row"].alias("found"))
    size = cells.groupBy(*SHEET).agg(F.max(row).alias("last_row"), F.max(col).alias("last_col"))
    placed = size.join(heads, SHEET, "left").withColumn("header_row", F.coalesce("found", F.lit(2)))
    marks = cells.where(amount | order).groupBy(*SHEET, row.alias("header_row")).agg(F.min(col).alias("order_col"))
    out = placed.join(marks, [*SHEET, "header_row"], "left")
    return out.select(*SHEET, "header_row", F.coalesce("order_col", F.col("last_col") + 1).cast("int").alias("order_col"), "last_row")


def column_letters(n: Column) -> Column:
    """A column's letters by its number from 1, up to ZZ."""
    letter = lambda i: F.char(F.lit(64) + i)
    return F.when(n <= 26, letter(n)).otherwise(F.concat(letter(F.floor((n - 1) / 26)), letter((n - 1) % 26 + 1)))


def order_cells(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """(order_id, file_id, sheet, cell, quantity): what an order writes into its forms; ``lines`` have the item's file_id, sheet and row (from 0, under the second row)."""
    placed = lines.join(forms, SHEET).withColumn("excel_row", F.col("row") + 2).where(F.col("excel_row").between(F.col("header_row") + 1, F.col("last_row")))
    return placed.select("order_id", *SHEET, F.concat(column_letters(F.col("order_col")), F.col("excel_row").cast("string")).alias("cell"), "quantity")


def csv_line(columns: list[str]) -> Column:
    """A row as a CSV line: quotes only around commas and line breaks, nothing for null."""

    def cell(c: str) -> Column:
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(t.rlike("[,\n]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)

    return F.concat_ws(",", *[cell(c) for c in columns])


def csv_lines(rows: DataFrame) -> DataFrame:
    """(value): rows as CSV lines; the first of each partition brings the byte order mark and the heading line."""
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    line = csv_line(rows.columns)
    return rows.select(F.when(first, F.concat(F.lit(BOM + ",".join(rows.columns) + "\n"), line)).otherwise(line).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV text files for spreadsheet programs."""
    csv_lines(rows).write.text(path)


def json_line(columns: list[str]) -> Column:
    """A row as a JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def run_log(found: DataFrame, version: str, at: Column) -> DataFrame:
    """A row per file for the log of runs, from validated items: status, counts and a summary as JSON."""
    size = lambda s: F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s)))
    per = found.groupBy("file_id").agg(F.count("*").alias("items_count"), size("warning").alias("warning_count"), size("error").alias("error_count"))
    status = F.when(F.col("items_count") == 0, "failed").when(F.col("error_count") > 0, "partial").otherwise("completed")
    summary = F.to_json(F.struct(F.col("items_count").alias("items"), F.col("warning_count").alias("warnings"), F.col("error_count").alias("errors")))
    return per.select("file_id", F.lit(version).alias("pipeline_version"), status.alias("status"), "items_count", "warning_count", "error_count", summary.alias("summary"), at.alias("created_at"))


def metadata_upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """File metadata with that of parsed files in place of what was there."""
    return changes.upserted(old, new, ["file_id"])


def shadow_report(main: DataFrame, other: DataFrame, fields: list[str]) -> DataFrame:
    """(file_id, report): two parsers' items of each file side by side as JSON: counts, difference, coverage of fields to four places."""
    share = lambda f: F.round(F.avg((clean(F.col(f)) != "").cast("int")), 4)
    side = lambda rows, name: rows.groupBy("file_id").agg(F.count("*").alias(f"{name}_items"), F.to_json(F.struct(*[share(f).alias(f) for f in fields])).alias(f"{name}_coverage"))
    both = side(main, "main").join(side(other, "other"), "file_id", "full").fillna(0, ["main_items", "other_items"])
    both = settled(both, {"delta_items": F.col("other_items") - F.col("main_items")})
    return both.select("file_id", "main_items", "other_items", "delta_items", "main_coverage", "other_coverage")
