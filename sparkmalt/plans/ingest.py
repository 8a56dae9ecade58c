"""From the cells of price lists to items, metadata and a summary.

Three steps: the rows are written once, each with its cells; from the first rows of
each sheet comes one row per sheet with all that is to be known of it (heading row,
field to column, supplier, price columns), written too; then one pass over the rows,
dealt by sheet and, for what holds for a file, by file, gives fields. Windows stand
for joins with sums by sheet and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmalt.functions import normalize, packaging, style
from sparkmalt.functions.text import null_if_empty, settled
from sparkmalt.operators import classify, extract, headers, mapping, quality, repair, rules, scan
from sparkmalt.operators.headers import SHEET
from sparkmalt.sources import xlsx
from sparkmalt.sources.shared import written

FIRST_ROWS = 130  # of a sheet, from which it is judged: a heading and the rows that show which price columns are in use


def price_columns(m: Column, columns: Column) -> Column:
    """Array of (col_idx, of: format_type and volume): the price columns in use, if there are several and no packaging column."""
    prices = F.filter(columns, lambda c: packaging.is_price_heading(c["header"]) & (c["priced"] >= 3))
    own = rules.at(m, "format_type").isNotNull() & ~F.exists(prices, lambda c: c["col_idx"] == rules.at(m, "format_type"))
    options = F.transform(prices, lambda c: F.struct(c["col_idx"].alias("col_idx"), packaging.heading_format(c["header"]).alias("of")))
    return F.when((F.size(prices) > 1) & ~own, options).otherwise(F.slice(options, 1, 0))


def headed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first rows and the heading rows of sheets, both written: what follows reads them several times."""
    top = written(cells.where(F.col("row_idx") < FIRST_ROWS), "first-rows")
    return top, written(headers.found(top), "heading-rows")


def sheets(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, header_row, mapping, supplier, prices), a row per sheet."""
    top, heads = headed(cells)
    seen = written(rules.proposed(rules.profiles(top, heads)), "proposed")
    ruled = seen.select(*SHEET, F.explode("proposed").alias("field", "col_idx"))
    chosen = mapping.assigned(mapping.candidates(top, heads.where("header_row >= 0")), ruled)
    own = chosen.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("field", "col_idx"))).alias("own"))
    found = rules.completed(seen.join(own, SHEET, "left").join(heads, SHEET), "own")
    return found.select(*SHEET, "header_row", "mapping", "supplier", price_columns(F.col("mapping"), F.col("columns")).alias("prices"))


def placed(rows: DataFrame, known: DataFrame, crowded: bool = False) -> DataFrame:
    """Rows of cells under the headings with a column per field, ``supplier`` and ``options``: the prices of a row with several.

    Both sides are dealt by sheet, so what is known of the sheets is not broadcast; if files are ``crowded``, Spark
    chooses, as one sheet must not be one task's work.
    """
    body = rows.join(known if crowded else known.hint("shuffle_hash"), SHEET)
    body = settled(body.where("row_idx > header_row"), {"at": F.struct(*[rules.at(F.col("mapping"), f).alias(f) for f in extract.WIDE])})
    body = settled(body, {f"__{f}": F.filter("cells", lambda c: c["col_idx"] == F.col("at")[f]) for f in extract.WIDE})  # noqa: B023
    text = lambda cells: null_if_empty(F.get(cells, F.lit(0))["value"])
    # a place that was written twice: its first text
    value = lambda f: F.coalesce(text(F.col(f"__{f}")), F.when(F.size(f"__{f}") > 1, text(F.filter(f"__{f}", lambda c: null_if_empty(c["value"]).isNotNull()))))
    price = lambda c: F.filter("prices", lambda p: p["col_idx"] == c["col_idx"])
    priced = F.filter("cells", lambda c: (F.size(price(c)) > 0) & c["value"].rlike(r"\d"))
    options = F.transform(priced, lambda c: F.struct(c["col_idx"].alias("col_idx"), packaging.first_price(c["value"]).alias("price"), F.get(price(c), F.lit(0))["of"].alias("of")))
    return settled(body, {f: value(f) for f in extract.WIDE} | {"options": F.sort_array(options)}).select(*SHEET, "row_idx", *extract.WIDE, "options", "supplier")


def raw_rows(cells: DataFrame, most: int = scan.MOST) -> DataFrame:
    """Mapped, completed and repaired rows of all product sheets; a sheet of over ``most`` rows is spread over tasks."""
    rows = written(xlsx.active_rows(xlsx.product_sheets(cells)), "rows")
    crowded = bool(rows.where(F.col("row_idx") >= most).take(1))
    rows = extract.split_cells(placed(rows, written(sheets(xlsx.cells_of_rows(rows)), "sheets"), crowded))
    rows = extract.by_options(rows)
    # the brewery of the rows above holds for a distributor's list; a brewery's list has one name
    filled = extract.forward_filled(extract.continued(rows, crowded=crowded).withColumn("own_brewery", F.col("brewery")), crowded=crowded)
    brewery = F.when(F.col("supplier.kind") == "brewery", F.coalesce("own_brewery", "supplier.name", "brewery")).otherwise(F.col("brewery"))
    return repair.repaired(filled.withColumn("brewery", brewery).drop("own_brewery", "supplier"), crowded=crowded)


def finished(rows: DataFrame) -> DataFrame:
    """Items with file_id, sheet, row_idx, normal fields, issues and is_valid, from raw rows."""
    rows = classify.classified(extract.valid_rows(rows))
    out = normalize.normalized(extract.finished(rows.where("is_product")))
    out = out.withColumn("style", style.filled(F.col("style"), F.col("beer_name"), F.col("description")))
    return quality.validated(out.drop("is_product", "row_text"))


def items(cells: DataFrame, most: int = scan.MOST) -> DataFrame:
    """Items of all product sheets; ``most`` rows of a sheet are one task's at most."""
    return finished(raw_rows(cells, most))


def metadata(cells: DataFrame) -> DataFrame:
    """Contacts and service phrases of each file from rows that are no products."""
    lines = cells.groupBy("file_id", "sheet", "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "value"))), lambda x: x["value"]), " ").alias("row_text"))
    products = extract.valid_rows(raw_rows(cells)).select("file_id", "sheet", "row_idx").distinct()
    other = lines.join(products, ["file_id", "sheet", "row_idx"], "left_anti").withColumn("is_product", F.lit(False))
    return classify.metadata(other)


def summary(found: DataFrame) -> DataFrame:
    """Per file: items, valid and invalid ones, errors and warnings."""
    size = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    return found.groupBy("file_id").agg(F.count("*").alias("total_items"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.sum(size("error")).alias("total_errors"), F.sum(size("warning")).alias("total_warnings"))


def numbered(found: DataFrame) -> DataFrame:
    """Items with their number in the file, by sheet and row."""
    w = Window.partitionBy("file_id").orderBy("sheet", "row_idx", "format_type", "price")
    return found.withColumn("item_no", F.row_number().over(w))
