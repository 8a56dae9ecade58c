"""Heading rows of sheets, found among cells (file_id, sheet, row_idx, col_idx, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean, settled
from sparkmalt.sources.registry import FIELDS, HEADINGS

SHEET = ["file_id", "sheet"]


def heading(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean(c)), r"\s+", " ")


def with_rows(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """``cells`` with the heading row of their sheet.

    Sizes are estimated from packed files and before cells are exploded, so the cells
    could pass for the small side and be broadcast whole; here the sheets' rows are
    looked up partition by partition.
    """
    return cells.join(header_rows.hint("shuffle_hash"), SHEET)


def hits(h: Column, words: list[str]) -> Column:
    """True if a word is in the normal form ``h`` of a heading, or that in a word."""
    return (h != "") & F.exists(F.array(*map(F.lit, words)), lambda w: h.contains(w) | w.contains(h))


def by_score(cells: DataFrame, rows: int = 8) -> DataFrame:
    """(file_id, sheet, header_row): of the first rows the one of the highest score, the first among equals.

    A cell gives 2 if it matches a field, 0.5 if it has at most 40 characters, and loses 0.8 if it has a digit.
    """
    cells, h = settled(cells.where(F.col("row_idx") < rows), {"__h": heading(F.col("value"))}), F.col("__h")
    words = sorted({w for ws in FIELDS.values() for w in ws})
    score = F.when(hits(h, words), 2.0).otherwise(0.0) + F.when(F.length(h) <= 40, 0.5).otherwise(0.0) - F.when(h.rlike(r"\d"), 0.8).otherwise(0.0)
    scored = cells.where(h != "").groupBy(*SHEET, "row_idx").agg(F.sum(score.cast("decimal(10,2)")).alias("score"))
    return scored.groupBy(*SHEET).agg(F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("header_row"))


def found(cells: DataFrame, rows: int = 8) -> DataFrame:
    """(file_id, sheet, header_row) of every sheet: the row of the highest score if two of its cells match fields, else the older rule's row.

    Without either a first or second row of nothing but short texts over rows
    with digits is the heading; a sheet that has none of these gets -1, so its
    first row counts.
    """
    cells, h = settled(cells.where(F.col("row_idx") < 10), {"__h": heading(F.col("value"))}), F.col("__h")
    words = sorted({w for ws in FIELDS.values() for w in ws})
    hit, digit = hits(h, words), h.rlike(r"\d")
    score = F.when(hit, 2.0).otherwise(0.0) + F.when(F.length(h) <= 40, 0.5).otherwise(0.0) - F.when(digit, 0.8).otherwise(0.0)
    per = cells.where(h != "").groupBy(*SHEET, "row_idx").agg(F.sum(score.cast("decimal(10,2)")).alias("score"), F.count_if(hit & ~digit).alias("hits"), F.count("*").alias("filled"), F.max(digit | (F.length(h) > 40)).alias("data"))
    good = F.when((F.col("hits") >= 2) & (F.col("row_idx") < rows), F.struct("score", -F.col("row_idx"), "row_idx"))
    plain = F.when((F.col("row_idx") < 2) & (F.col("filled") >= 2) & ~F.col("data"), F.col("row_idx"))
    sheets = per.groupBy(*SHEET).agg(F.max(good)["row_idx"].alias("by_score"), F.max(plain).alias("plain"), F.max("data").alias("data"))
    older = by_kinds(cells).withColumnRenamed("header_row", "older")
    row = F.coalesce("by_score", "older", F.when(F.col("data"), F.col("plain")), F.lit(-1))
    return sheets.join(older, SHEET, "left").select(*SHEET, row.cast("int").alias("header_row"))


def by_kinds(cells: DataFrame, rows: int = 10, columns: int = 20) -> DataFrame:
    """The older rule: a row with brewery, name and price headings wins; else three points a match, or two."""
    h = heading(F.col("value"))
    any_of = lambda words: reduce(lambda a, b: a | b, [h.contains(w) for w in words])
    kinds = {"brewery": ["пивоварн", "производител", "brewery"], "name": ["назван", "наименован", "товар", "beer", "name"], "price": ["цена", "price", "стоимость", "cost"]}
    match = any_of([w for w in HEADINGS])
    near = cells.where((F.col("row_idx") < rows) & (F.col("col_idx") < columns) & (h != ""))
    per = near.groupBy(*SHEET, "row_idx").agg(F.count("*").alias("filled"), F.count_if(match).alias("matches"), *[F.max(any_of(w)).cast("int").alias(k) for k, w in kinds.items()])
    three = F.col("brewery") + F.col("name") + F.col("price")
    score = F.when(three == 3, 1_000_000 - F.col("row_idx")).when(three == 2, 3 * F.col("matches") + F.col("filled")).when(F.col("matches") >= 2, 2 * F.col("matches") + F.col("filled"))
    return per.withColumn("score", score).where("score IS NOT NULL").groupBy(*SHEET).agg(F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("header_row"))

