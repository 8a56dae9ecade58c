"""Sheet queries: workbooks and grids to items, heading rows, column mapping, carried context, price columns.

Parts are dealt over price lists of ``ROWS`` rows, so no file grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.functions import normalize, numbers, packaging
from sparkmalt.functions.text import clean_name
from sparkmalt.operators import extract, headers, mapping, repair
from sparkmalt.plans import bound, ingest
from sparkmalt.sources import files, registry, xlsx

ROWS = 200
COLUMNS = {"Пивоварня": "brewery", "Название": "beer_name", "Стиль": "style", "Цена, руб": "price", "Объем": "volume", "Тип тары": "format_type"}

MISSPELT = ["Наименоване", "Пивоварная", "Стилль", "Ценна", "Обьем", "Упаковки"]


def listed(s: SparkSession, d: str) -> DataFrame:
    """Items with file_id (text), sheet and row_idx (1 for the first under the heading)."""
    at = F.col("id")
    rows = bound.items(s, d).withColumns({"file_id": F.format_string("list-%06d", F.floor(at / ROWS)), "sheet": F.lit("Пиво"), "row_idx": (at % ROWS).cast("int") + 1})
    return rows.repartition("file_id")  # a packed table has few splits, and all that its rows become would be those tasks' work


def row_values() -> Column:
    return F.array("brewery", "beer_name", "style", F.col("price").cast("string"), F.concat(F.col("volume").cast("int").cast("string"), F.lit(" л")), "format_type")


def cells(s: SparkSession, d: str) -> DataFrame:
    """Cells of the price lists, heading row included, without a shuffle: the first row of a list brings the headings."""
    body = F.struct(F.col("row_idx"), row_values().alias("values"))
    head = F.struct(F.lit(0).alias("row_idx"), F.array(*map(F.lit, COLUMNS)).alias("values"))
    rows = listed(s, d).select("file_id", "sheet", F.explode(F.when(F.col("row_idx") == 1, F.array(head, body)).otherwise(F.array(body))).alias("r"))
    out = rows.select("file_id", "sheet", F.col("r.row_idx").alias("row_idx"), F.posexplode("r.values").alias("col_idx", "value"))
    return out.withColumns({"hidden": F.lit(False), "strike": F.lit(False), "font_rgb": F.lit(None).cast("string")})


def workbooks(s: SparkSession, d: str) -> DataFrame:
    """(file_id, content): each price list as a workbook, with a sheet of contacts beside it."""
    lists = listed(s, d).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", row_values().alias("values")))).alias("rows"))  # ROWS rows each

    def book(of: dict) -> Iterator[tuple]:
        yield of["file_id"], xlsx.workbook({"Пиво": [list(COLUMNS)] + [r["values"] for r in of["rows"]], "Контакты": [["Телефон +7 495 123-45-67"]]})

    return files.one_by_one(lists, book, files.CONTENTS)


def item_fields(items: DataFrame) -> DataFrame:
    return items.select("file_id", "row_idx", "brewery", "beer_name", "style", F.col("price").cast("double").alias("price"), "currency", "volume", "format_type", "is_valid")


def grid(s: SparkSession, d: str) -> DataFrame:
    """The same lists as page tables: (file_id, page, table, row, cells)."""
    rows = listed(s, d)
    head = F.struct(F.lit(0).alias("row"), F.array(*map(F.lit, COLUMNS)).alias("cells"))
    body = F.struct(F.col("row_idx").alias("row"), row_values().alias("cells"))
    return rows.select("file_id", F.lit(1).alias("page"), F.lit(1).alias("table"), F.explode(F.when(F.col("row_idx") == 1, F.array(head, body)).otherwise(F.array(body))).alias("r")).select("file_id", "page", "table", "r.row", "r.cells")


def grid_ingest(s: SparkSession, d: str) -> DataFrame:
    return ingest.summary(ingest.items(files.grid_cells(grid(s, d))))


def gappy(s: SparkSession, d: str) -> DataFrame:
    """Rows with the brewery on every tenth row only, and packaging-only rows."""
    at = F.col("row_idx")
    rows = listed(s, d).withColumns({"brewery": F.when(at % 10 == 1, F.col("brewery")), "label": F.when(at % 4 == 0, F.lit("кег 30 л"))})
    return rows.withColumns({"beer_name": F.when(F.col("label").isNull(), F.col("beer_name")), "abv": F.lit(None).cast("string"), "ibu": F.lit(None).cast("string"), "description": F.lit(None).cast("string"), "style": F.when(F.col("label").isNull(), F.col("style"))})


def price_columns(s: SparkSession, d: str) -> DataFrame:
    """Rows with a can and a keg price, one of them missing at times, as a row per price."""
    rows = listed(s, d).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.floor("price").cast("string"), F.lit(" / 9000"))).alias("can"), F.when(F.col("id") % 2 > 0, F.floor(F.col("price") * 10).cast("string")).otherwise("XX").alias("keg"))
    return extract.by_price_column(rows, [("can", "Цена банка (0.33)"), ("keg", "Цена Кег 20л")]).select("id", F.col("price").cast("long").alias("price"), "format_type", "volume")


def price_texts(s: SparkSession, d: str) -> DataFrame:
    """Price cells in several spellings, taken apart."""
    c, i = F.col, F.col("id")
    text = F.when(i % 5 == 0, F.lit("нет")).when(i % 4 == 0, F.concat(F.lit("€"), c("volume").cast("int"))).when(i % 3 == 0, F.concat(c("price").cast("string"), F.lit(" usd (500 мл)"))).otherwise(F.concat(F.replace(c("price").cast("string"), F.lit("."), F.lit(",")), F.lit(" руб 0,75 л")))
    return bound.items(s, d).select(i, normalize.price(text).alias("p"), normalize.volume(F.concat(c("volume").cast("int").cast("string"), F.when(i % 2 == 0, F.lit(" ml")).otherwise(" oz"))).alias("measure"), numbers.safe_int(text, -1).alias("whole"), numbers.number_text(F.concat(F.lit("1.2"), i.cast("string"), F.lit(",50"))).alias("number")).select("id", "p.price", "p.currency", "p.volume", "measure", "whole", "number")


def packaging_texts(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    text = F.when(i % 4 == 0, F.lit("ж/б 0.45 / 20")).when(i % 4 == 1, F.lit("кег 30 л")).when(i % 4 == 2, F.lit("Бутылка 500 мл")).otherwise(F.lit("0.33"))
    of, strong = packaging.packed(text), packaging.strength(F.concat((i % 10).cast("string"), F.lit(",5% / 12 / 30")))
    return bound.items(s, d).select("id", of["format_type"].alias("format_type"), of["volume"].alias("volume"), strong["abv"].alias("abv"), strong["ibu"].alias("ibu"))


def names_split(s: SparkSession, d: str) -> DataFrame:
    """'Brewery - Name' parted, city words gone."""
    i = F.col("id")
    sep = F.when(i % 3 == 0, F.lit(" - ")).when(i % 3 == 1, F.lit("|")).otherwise(F.lit(" / "))
    whole = F.concat(F.lit("Brew"), F.when(i % 2 == 0, F.lit("2")).otherwise(""), sep, F.col("beer_name"))
    got = normalize.split_brewery(whole, F.lit(None).cast("string"))
    return bound.items(s, d).select("id", got["brewery"].alias("brewery"), got["beer_name"].alias("beer_name"), normalize.brewery(F.concat("brewery", F.lit(" г. Владимир"))).alias("city_free"), normalize.packaging(F.when(i % 2 == 0, F.lit("Keg")).otherwise(F.lit(" Бут "))).alias("packaging"))


def repaired_rows(s: SparkSession, d: str) -> DataFrame:
    """Names and descriptions that landed in each other's column, put right."""
    long = F.concat(F.col("beer_name"), F.lit(" with a long text, which says what it tastes of and why: much, too much, of it all"))
    swapped = F.col("id") % 3 == 0
    rows = listed(s, d).withColumns({"description": F.when(swapped, F.col("beer_name")).otherwise(long), "beer_name": F.when(swapped, long).otherwise(F.col("beer_name"))})
    return repair.repaired(rows).select("id", "beer_name", F.length("description").alias("description_chars"), "brewery")


def repair_rules(s: SparkSession, d: str) -> DataFrame:
    """One row for each rule of repair, by id; in odd lists the brewery column holds names, and moves."""
    i, n = F.col("id"), F.floor(F.col("id") / ROWS) % 2
    name, none = F.col("beer_name"), F.lit(None).cast("string")
    long = F.concat(F.lit("a long text, which says what it tastes of and why: much, too much, number "), i.cast("string"))
    pick = lambda *v: F.when(n == 1, v[-1]).otherwise(reduce(lambda rest, k: F.when(i % 5 == k, v[k]).otherwise(rest), range(4, -1, -1), none))
    rows = listed(s, d).withColumns(
        {
            "brewery": pick(F.col("brewery"), F.col("brewery"), F.lit("DUSK RED MOON"), F.col("brewery"), long, F.concat(F.lit("lot number "), i.cast("string"), F.lit(" of beer"))),
            "description": pick(name, name, none, F.concat(name, F.lit("\n"), long), none, none),
            "style": pick(F.col("style"), F.upper(name), F.col("style"), F.col("style"), F.col("style"), F.col("style")),
            "beer_name": pick(none, F.lower(name), none, none, name, F.when(i % 3 > 0, name)),
        }
    )
    return repair.repaired(rows).select("id", "brewery", "beer_name", "description")


def cells_parted(s: SparkSession, d: str) -> DataFrame:
    """Names with text or brewery in them, strengths, currencies and stock cells taken apart; labels without their marks; breweries that normalising would empty."""
    i = F.col("id")
    cell = F.when(i % 3 == 0, F.concat("beer_name", F.lit("\n first line \r\nsecond"))).when(i % 3 == 1, F.concat(F.lit('«Dusk» lot '), i.cast("string"))).otherwise(F.concat(F.lit("ALT HAUS (craft brewery) "), i.cast("string")))
    parts = packaging.name_and_text(cell)
    rows = bound.items(s, d).select("id", parts["name"].alias("name"), parts["text"].alias("text"), packaging.brewery_in_name(cell).alias("brewery"), normalize.abv(F.concat((i % 9).cast("string"), F.lit(",5 %"))).alias("abv"), normalize.currency(F.when(i % 2 == 0, " USD ").otherwise("usd 5")).alias("currency"))
    stock = F.when(i % 2 == 0, "Цена за банку").otherwise("12")
    label = clean_name(F.concat(F.lit("- "), F.col("name"), F.lit("  (Limited) ,")))
    return rows.select("*", F.when(~packaging.is_price_heading(stock), stock).alias("stock"), label.alias("label"))


def mapped(s: SparkSession, d: str) -> DataFrame:
    heads = headers.by_score(cells(s, d))
    return mapping.assigned(mapping.candidates(cells(s, d), heads)).select("file_id", "field", "col_idx")


def misspelt(s: SparkSession, d: str) -> DataFrame:
    """The distinct headings of all parts: a misspelling by the key, with the first letters of the part's name after it, from none to all of them."""
    key, name = F.col("p_partkey"), F.coalesce("p_name", F.lit(""))
    word = F.element_at(F.array(*map(F.lit, MISSPELT)), (F.pmod(key, F.lit(len(MISSPELT))) + 1).cast("int"))
    letters = F.pmod(F.floor(key / len(MISSPELT)), F.length(name) + 1).cast("int")
    return bound.table(s, d, "part").select(F.concat(word, F.substring(name, F.lit(1), letters)).alias("header")).distinct()


def file_kinds(s: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    name = F.concat(F.lit("Price-"), i.cast("string"), F.element_at(F.array(*map(F.lit, [".PDF", ".xlsx", ".zip", ".txt"])), (i % 4 + 1).cast("int")))
    link = F.concat(F.lit("https://docs.google.com/spreadsheets/d/k"), i.cast("string"), F.lit("/edit#gid="), (i % 5).cast("string"))
    return bound.table(s, d, "pages").select("page_id", files.file_type(name).alias("kind"), files.export_url(link).alias("csv"), registry.glob_matches(name, F.lit("price-1*.?df")).alias("matched"))


QUERIES = {
    "xlsx_ingest": lambda s, d: item_fields(ingest.items(xlsx.cells_of(workbooks(s, d)))),
    "xlsx_cells": lambda s, d: xlsx.product_sheets(xlsx.cells_of(workbooks(s, d))).groupBy("file_id").agg(F.count("*").alias("cells"), F.max("row_idx").alias("last_row")),
    "sheet_ingest": lambda s, d: item_fields(ingest.items(cells(s, d))),
    "grid_ingest": grid_ingest,
    "column_assignment": mapped,
    "fuzzy_header_scores": lambda s, d: mapping.header_scores(misspelt(s, d)).drop("exact"),
    "text_dump": lambda s, d: files.text_dump(cells(s, d)).select("file_id", "row_idx", "text"),
    "long_sheet_fill": lambda s, d: extract.forward_filled(gappy(s, d).withColumns({"file_id": F.lit("one"), "sheet": F.lit("long"), "row_idx": F.col("id")}), crowded=True).select("id", "brewery"),
    "forward_fill": lambda s, d: extract.forward_filled(gappy(s, d)).select("id", "brewery"),
    "continuation": lambda s, d: extract.continued(gappy(s, d)).select("id", "beer_name", "style"),
    "price_columns": price_columns,
    "price_texts": price_texts,
    "packaging_texts": packaging_texts,
    "names_split": names_split,
    "repaired_rows": repaired_rows,
    "repair_rules": repair_rules,
    "cells_parted": cells_parted,
    "file_kinds": file_kinds,
}
_LISTS = f"WITH {bound.ITEMS}, lists AS (SELECT *, format('list-{{:06d}}', id // {ROWS}) AS fid, (id % {ROWS})::INT + 1 AS row_idx FROM items) "
_GAPPY = _LISTS + ", g AS (SELECT id, fid, row_idx, price, volume, style AS st, beer_name AS bn, CASE WHEN row_idx % 10 = 1 THEN brewery END AS b, CASE WHEN row_idx % 4 <> 0 THEN beer_name END AS n FROM lists) "
_ITEMS = _LISTS + "SELECT fid AS file_id, row_idx, brewery, beer_name, style, price::DECIMAL(10, 2)::DOUBLE AS price, currency, volume, format_type, true AS is_valid FROM lists"
_ASSIGNED = " UNION ALL ".join(f"SELECT '{f}' AS field, {i} AS col_idx" for i, f in enumerate(COLUMNS.values()))
ORACLES = {
    "xlsx_ingest": _ITEMS,
    "sheet_ingest": _ITEMS,
    "xlsx_cells": _LISTS + f"SELECT fid AS file_id, count(*) * {len(COLUMNS)} + {len(COLUMNS)} AS cells, max(row_idx) AS last_row FROM lists GROUP BY 1",
    "grid_ingest": _LISTS + "SELECT fid AS file_id, count(*) AS total_items, count(*) AS valid, 0::BIGINT AS invalid, 0::BIGINT AS total_errors, sum(CASE WHEN price < 50 * volume OR price > 10000 * volume THEN 1 ELSE 0 END)::BIGINT AS total_warnings FROM lists GROUP BY 1",
    "column_assignment": _LISTS + f", a AS ({_ASSIGNED}) SELECT DISTINCT fid AS file_id, field, col_idx FROM lists, a",
    "text_dump": _LISTS + f"SELECT fid AS file_id, row_idx, concat_ws(' ', brewery, beer_name, style, price, volume::INT || ' л', format_type) AS text FROM lists UNION ALL SELECT DISTINCT fid, 0, '{' '.join(COLUMNS)}' FROM lists",
    "long_sheet_fill": _GAPPY + "SELECT id, last_value(b IGNORE NULLS) OVER (ORDER BY id) AS brewery FROM g",
    "forward_fill": _GAPPY + "SELECT id, last_value(b IGNORE NULLS) OVER (PARTITION BY fid ORDER BY row_idx) AS brewery FROM g",
    "continuation": _GAPPY + "SELECT id, last_value(n IGNORE NULLS) OVER w AS beer_name, last_value(CASE WHEN n IS NOT NULL THEN st END IGNORE NULLS) OVER w AS style FROM g WINDOW w AS (PARTITION BY fid ORDER BY row_idx)",
    "price_columns": f"WITH {bound.ITEMS} SELECT id, floor(price)::BIGINT AS price, 'банка' AS format_type, 0.33::DOUBLE AS volume FROM items WHERE id % 3 > 0 UNION ALL SELECT id, floor(price * 10)::BIGINT, 'кег', 20.0 FROM items WHERE id % 2 > 0",
    "price_texts": f"""WITH {bound.ITEMS}, t AS (SELECT id, price AS p, volume AS v, CASE WHEN id % 5 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 WHEN id % 3 = 0 THEN 2 ELSE 3 END AS k FROM items)
      SELECT id, CASE k WHEN 1 THEN v WHEN 0 THEN NULL ELSE p END AS price, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE 'RUB' END AS currency, CASE k WHEN 2 THEN 500 * 0.001::DOUBLE WHEN 3 THEN 0.75::DOUBLE END AS volume,
        CASE WHEN id % 2 = 0 THEN v * 0.001::DOUBLE ELSE v * 0.0295735::DOUBLE END AS measure, -1::BIGINT AS whole, '12' || id || '.50' AS number FROM t""",
    "packaging_texts": f"WITH {bound.ITEMS} SELECT id, CASE id % 4 WHEN 0 THEN 'банка' WHEN 1 THEN 'кега' WHEN 2 THEN 'бутылка' END AS format_type, CASE id % 4 WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 30.0 WHEN 2 THEN 0.5 ELSE 0.33 END AS volume, (id % 10) || '.5' AS abv, '30' AS ibu FROM items",
    "names_split": f"WITH {bound.ITEMS} SELECT id, CASE WHEN id % 2 = 1 THEN 'Brew' END AS brewery, CASE WHEN id % 2 = 1 THEN beer_name ELSE 'Brew2' || CASE id % 3 WHEN 0 THEN ' - ' WHEN 1 THEN '|' ELSE ' / ' END || beer_name END AS beer_name, brewery AS city_free, CASE WHEN id % 2 = 0 THEN 'кега' ELSE 'бутылка' END AS packaging FROM items",
    "repaired_rows": f"WITH {bound.ITEMS} SELECT id, beer_name, (length(beer_name) + 82)::INT AS description_chars, brewery FROM items",
    "repair_rules": _LISTS + """, t AS (SELECT *, (id // 200) % 2 AS odd, 'a long text, which says what it tastes of and why: much, too much, number ' || id AS long FROM lists)
      SELECT id, CASE WHEN odd = 1 THEN CASE WHEN id % 3 > 0 THEN 'lot number ' || id || ' of beer' ELSE '' END ELSE CASE id % 5 WHEN 2 THEN 'DUSK' WHEN 4 THEN '' ELSE brewery END END AS brewery,
        CASE WHEN odd = 1 THEN CASE WHEN id % 3 > 0 THEN beer_name ELSE 'lot number ' || id || ' of beer' END ELSE CASE id % 5 WHEN 2 THEN 'RED MOON' ELSE beer_name END END AS beer_name,
        CASE WHEN odd = 1 THEN '' ELSE CASE id % 5 WHEN 0 THEN beer_name WHEN 1 THEN beer_name WHEN 3 THEN long ELSE '' END END AS description FROM t""",
    "cells_parted": f"""WITH {bound.ITEMS}, n AS (SELECT id, CASE id % 3 WHEN 0 THEN beer_name WHEN 1 THEN '«Dusk» lot ' || id ELSE 'ALT HAUS (craft brewery) ' || id END AS name FROM items)
      SELECT id, name, CASE WHEN id % 3 = 0 THEN 'first line second' ELSE '' END AS text, CASE id % 3 WHEN 1 THEN 'Dusk' WHEN 2 THEN 'ALT HAUS' END AS brewery, (id % 9) + 0.5::DOUBLE AS abv,
        CASE WHEN id % 2 = 0 THEN 'USD' ELSE 'RUB' END AS currency, CASE WHEN id % 2 = 1 THEN '12' END AS stock, name AS label FROM n""",
    "file_kinds": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 2 THEN 'zip' END AS kind, 'https://docs.google.com/spreadsheets/d/k' || page_id || '/export?format=csv&gid=' || (page_id % 5) AS csv, page_id % 4 = 0 AND starts_with(page_id::VARCHAR, '1') AS matched FROM pages",
}
