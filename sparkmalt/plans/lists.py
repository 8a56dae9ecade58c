"""Price lists of many layouts: headings that come late, columns in any order, rows that don't count, several price columns, no headings at all.

Parts are dealt over lists of ``sheets.ROWS`` rows; what a list looks like
hangs on its number, so every expected value does, too.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.functions import packaging
from sparkmalt.operators import extract, headers, mapping, pages, rules
from sparkmalt.plans import bound, ingest, sheets
from sparkmalt.sources import files

FIELDS = list(sheets.COLUMNS.values())
N = len(FIELDS)


def numbered(s: SparkSession, d: str) -> DataFrame:
    """Items with file_id, number of the list, and place in the list from 0."""
    at = F.col("id")
    rows = bound.items(s, d).withColumns({"file_id": F.format_string("list-%06d", F.floor(at / sheets.ROWS)), "sheet": F.lit("Пиво"), "list": F.floor(at / sheets.ROWS).cast("int"), "at": (at % sheets.ROWS).cast("int")})
    return rows.repartition("file_id")  # as in ``sheets.listed``


def spread(rows: DataFrame, heading: Column, top: Column, width: Column) -> DataFrame:
    """Cells of rows (file_id, sheet, list, at, values): ``top`` lines of contacts, the heading (null for none), and the rows, columns moved on by ``list`` modulo ``width``."""
    contact = lambda i: F.struct(i.cast("int").alias("row_idx"), F.array(F.concat(F.lit("Телефон +7 495 123-45-6"), i.cast("string"))).alias("values"))
    body = F.struct((top + F.col("at") + F.when(heading.isNull(), 0).otherwise(1)).cast("int").alias("row_idx"), F.col("values"))
    lines = F.when(top > 0, F.transform(F.sequence(F.lit(0), F.greatest(top - 1, F.lit(0))), contact)).otherwise(F.array().cast("array<struct<row_idx:int,values:array<string>>>"))
    head = F.when(heading.isNull(), F.array().cast("array<struct<row_idx:int,values:array<string>>>")).otherwise(F.array(F.struct(top.cast("int").alias("row_idx"), heading.alias("values"))))
    first = F.concat(lines, head, F.array(body))
    one = rows.select("file_id", "sheet", "list", *[c for c in ("hidden", "strike", "font_rgb") if c in rows.columns], F.explode(F.when(F.col("at") == 0, first).otherwise(F.array(body))).alias("r"))
    looks = {"hidden": F.lit(False), "strike": F.lit(False), "font_rgb": F.lit(None).cast("string")}
    kept = [F.col(c) if c in rows.columns else v.alias(c) for c, v in looks.items()]
    cells = one.select("file_id", "sheet", "list", F.col("r.row_idx").alias("row_idx"), F.posexplode("r.values").alias("i", "value"), *kept)
    moved = F.when(F.col("value").startswith("Телефон"), F.lit(0)).otherwise((F.col("i") + F.col("list")) % width)
    return cells.where("value IS NOT NULL").select("file_id", "sheet", "row_idx", moved.cast("int").alias("col_idx"), "value", "hidden", "strike", "font_rgb")


def varied(s: SparkSession, d: str) -> DataFrame:
    """Cells of lists with 0 to 4 lines above the heading, columns in six orders, two wordings, and rows that don't count: hidden, struck out, grey, register codes, cities alone."""
    at = F.col("at")
    heads = [list(sheets.COLUMNS), ["Производитель", "Название товара", "Стиль", "Стоимость", "Объем", "Упаковка"]]
    heading = F.when(F.col("list") % 2 == 0, F.array(*map(F.lit, heads[0]))).otherwise(F.array(*map(F.lit, heads[1])))
    code, alone = at % 29 == 3, at % 37 == 6
    given = {
        "brewery": F.when(alone, "Москва").when(at % 31 == 4, F.concat("brewery", F.lit(" г. Владимир"))).otherwise(F.col("brewery")),
        "beer_name": F.when(code, F.concat(F.lit("Эль-"), F.col("id").cast("string"))).when(~alone, F.col("beer_name")),
        "style": F.when(~alone, F.col("style")),
        "price": F.when(~alone, F.col("price").cast("string")),
        "volume": F.when(~alone, F.concat(F.col("volume").cast("int").cast("string"), F.lit(" л"))),
        "format_type": F.when(~alone, F.col("format_type")),
    }
    rows = numbered(s, d).withColumns({"values": F.array(*given.values()), "hidden": at % 23 == 5, "strike": at % 23 == 7, "font_rgb": F.when(at % 23 == 9, "FF808080")})
    # the heading comes with the first row, which is none of those that don't count
    return spread(rows, heading, F.col("list") % 5, F.lit(N))


COUNTED = "pos % 23 NOT IN (5, 7, 9) AND pos % 29 <> 3 AND pos % 37 <> 6"


def varied_ingest(s: SparkSession, d: str) -> DataFrame:
    return sheets.item_fields(ingest.items(varied(s, d)))


def varied_columns(s: SparkSession, d: str) -> DataFrame:
    """Which column is which field, by scores, in every list."""
    return mapping.assigned(mapping.candidates(*ingest.headed(varied(s, d)))).select("file_id", "field", "col_idx")


def ranked_columns(s: SparkSession, d: str) -> DataFrame:
    """The best column by heading for each field, and the sheet's confidence."""
    return mapping.top_candidates(mapping.candidates(*ingest.headed(varied(s, d)))).where("rank = 1 AND field IN ('style', 'volume')").select("file_id", "field", "col_idx")


def multi_price(s: SparkSession, d: str) -> DataFrame:
    """Lists with a can and a keg price and no packaging column, as items."""
    at = F.col("at")
    rows = numbered(s, d).withColumn("values", F.array("brewery", "beer_name", F.when(at % 3 > 0, F.concat(F.floor("price").cast("string"), F.lit(" / 9000"))), F.when(at % 2 > 0, F.floor(F.col("price") * 10).cast("string")).otherwise("XX")))
    cells = spread(rows.where("at % 6 > 0 OR at = 0"), F.array(*map(F.lit, ["Пивоварня", "Название", "Цена банка (0.33)", "Цена Кег 20л"])), F.lit(0), F.lit(4))
    return ingest.items(cells).where("price IS NOT NULL").select("file_id", "row_idx", "beer_name", F.col("price").cast("double").alias("price"), "format_type", "volume")


def bare(s: SparkSession, d: str) -> DataFrame:
    """Cells of lists without headings: a long name and a price, in either order."""
    rows = numbered(s, d).withColumn("values", F.array(F.concat("beer_name", F.lit(" number one")), (F.col("id") % 900 + 50).cast("string")))
    return spread(rows, F.lit(None).cast("array<string>"), F.lit(0), F.lit(2))


def ruled(s: SparkSession, d: str) -> DataFrame:
    """(file_id, field, col_idx) by the rules of headings and contents: stock columns that hold prices, packaging, or what they should, and stock beside packaging.

    'мало' has the sign of litres in it, so without a packaging column it stands for both.
    """
    n, at = F.col("list"), F.col("at")
    price = (F.col("id") % 900 + 50).cast("string")
    third = F.when(n % 4 == 0, price).when(n % 4 == 1, F.when(at % 2 == 0, "банка").otherwise("кег")).otherwise(F.when(at % 2 == 0, "много").otherwise("мало"))
    heading = F.array(F.lit("Пивоварня"), F.lit("Наименование товара"), F.lit("Цена"), F.when(n % 4 == 3, "Наличие").otherwise("Остаток"), F.when(n % 4 == 3, "Тип тары").otherwise("Описание"))
    last = F.when(n % 4 == 3, F.when(at % 2 == 0, "банка").otherwise("кег")).otherwise(F.concat(F.lit("вкус и аромат, насыщенный и яркий, номер "), F.col("id").cast("string")))
    rows = numbered(s, d).withColumn("values", F.array(F.upper("brewery"), F.concat(F.lit("lot "), F.col("id").cast("string"), F.lit(" of the year and the day")), price, third, last))
    cells = spread(rows, heading, F.lit(0), F.lit(5))
    found = rules.mapped(rules.profiles(*ingest.headed(cells)))
    return found.select("file_id", F.explode("mapping").alias("field", "col_idx")).where("field IN ('brewery', 'beer_name', 'price', 'stock', 'format_type', 'description')")


def digit_columns(s: SparkSession, d: str) -> DataFrame:
    """(file_id, field, col_idx) by scores and rules together: names that end in digits, beside columns of strengths, bitterness and prices in any order.

    In every third list no heading but the names' says what stands below.
    """
    n, at = F.col("list"), F.col("at")
    heading = F.array(F.when(n % 2 == 0, "Название").otherwise("Товар"), F.when(n % 3 == 1, "Wert A").otherwise("Цена"), F.when(n % 3 == 1, "Wert B").otherwise("Крепость"), F.when(n % 3 == 1, "Wert C").otherwise("Пивоварня"))
    strength = F.concat((F.col("id") % 9 + 3).cast("string"), F.when(at % 2 == 0, ",5%").otherwise("%"))
    rows = numbered(s, d).withColumn("values", F.array(F.concat(F.when(at % 2 == 0, "Kellerbier ").otherwise("Rauch "), (at % 20).cast("string")), (F.col("id") % 900 + 150).cast("string"), strength, F.concat(F.lit("Haus "), F.upper("brewery"))))
    found = ingest.sheets(spread(rows, heading, F.lit(0), F.lit(4)))
    return found.select("file_id", F.explode("mapping").alias("field", "col_idx")).where("field IN ('beer_name', 'price', 'abv')")


def csv_files(s: SparkSession, d: str) -> DataFrame:
    """(file_id, content): lists as CSV files with up to two lines of one cell and a blank one above the heading, rows that are longer than the heading or end early, and quoted cells with commas and line ends."""
    values = F.array("brewery", "beer_name", "style", F.col("price").cast("string"), F.concat(F.col("volume").cast("int").cast("string"), F.lit(" л")), "format_type")
    lists = numbered(s, d).groupBy("file_id", "list").agg(F.sort_array(F.collect_list(F.struct("at", values.alias("values")))).alias("rows"))  # sheets.ROWS rows each

    def file(of: dict) -> Iterator[tuple]:
        n, text = of["list"], io.StringIO()
        write = csv.writer(text, lineterminator="\r\n" if n % 2 else "\n")
        for i in range(n % 3):
            write.writerow([f"Телефон +7 495 123-45-6{i}"])
        if n % 3:
            text.write("\n")
        write.writerow(list(sheets.COLUMNS))
        for r in of["rows"]:
            v = r["values"]
            write.writerow(v[:5] if r["at"] % 7 == 3 else [*v, "first, second\nthird"] if r["at"] % 7 == 5 else v)
        yield of["file_id"], text.getvalue().encode("utf-8-sig" if n % 4 == 1 else "cp1251" if n % 4 == 2 else "utf-8")

    return files.one_by_one(lists, file, files.CONTENTS)


def csv_widths(s: SparkSession, d: str) -> DataFrame:
    """(file_id, row_idx, width, chars): how wide each record of the CSV files is, and how many characters its cells hold."""
    return files.csv_records(csv_files(s, d)).groupBy("file_id", "row_idx").agg((F.max("col_idx") + 1).alias("width"), F.sum(F.length("value")).alias("chars"))


def csv_ingest(s: SparkSession, d: str) -> DataFrame:
    return sheets.item_fields(ingest.items(files.csv_records(csv_files(s, d), sheet="Пиво")))


def guesses(s: SparkSession, d: str) -> DataFrame:
    """(file_id, header_row, field, col_idx) of lists without headings."""
    cells, heads = ingest.headed(bare(s, d))
    found = rules.mapped(rules.profiles(cells, heads)).join(heads, ["file_id", "sheet"])
    return found.select("file_id", "header_row", F.explode("mapping").alias("field", "col_idx"))


def supplier_kinds(s: SparkSession, d: str) -> DataFrame:
    """(file_id, kind, name) of lists with one brewery, with several, with a brewery in the names, and with nothing but a file name."""
    n, at = F.col("list"), F.col("at")
    first = F.when(n % 4 == 0, F.concat(F.lit("House "), n.cast("string"))).when(n % 4 == 1, F.col("brewery")).when(n % 4 == 2, F.concat(F.lit('"Dusk'), F.lit('" lot of the year '), F.col("id").cast("string"))).otherwise(F.concat(F.lit("lot"), at.cast("string"), F.lit(" of the year and day")))
    heading = F.array(F.when(F.col("n") % 4 < 2, "Пивоварня").otherwise("Название"), F.lit("Цена"))
    rows = numbered(s, d).withColumns({"n": n, "file_id": F.concat(F.when(n % 8 == 3, "Прайс ").otherwise("lot "), F.col("file_id"), F.lit(".xlsx")), "values": F.array(first, F.lit("100"))}).withColumn("list", F.lit(0))
    cells = spread(rows, heading, F.lit(0), F.lit(2))
    found = rules.with_supplier(rules.profiles(*ingest.headed(cells)))
    return found.select("file_id", "supplier.kind", "supplier.name")


def page_grid(s: SparkSession, d: str) -> DataFrame:
    """Page tables with a second heading row below two price columns, cells of several spellings, and rows that are no products."""
    i, at = F.col("id"), F.col("at")
    rows = numbered(s, d).withColumn("row", at + 2)
    keg = F.when(i % 3 > 0, F.concat((i % 900 + 5000).cast("string"), F.lit("р")))
    can = F.when(i % 4 == 0, F.concat((i % 300 + 100).cast("string"), F.lit("p/ бажжя"))).when(i % 4 == 1, F.concat((i % 300 + 100).cast("string"), F.lit("р/ банка коробка"))).otherwise(F.concat((i % 300 + 100).cast("string"), F.lit(" руб")))
    name = F.when(at % 11 == 5, "Коробка 20шт").when(at % 11 == 7, "").otherwise(F.concat(F.when(i % 2 == 0, "(NEW) ").otherwise(""), F.lit("Dusk number "), i.cast("string")))
    body = F.struct("row", F.array(name, F.lit("Amber"), F.concat((i % 9 + 3).cast("string"), F.lit(".5%ABV")), keg, can).alias("cells"))
    heads = F.array(*[F.struct(F.lit(k).alias("row"), F.array(*map(F.lit, h)).alias("cells")) for k, h in enumerate((["Название", "Стиль", "ТТХ", "Цена кег", "Цена фасовка"], ["", "", "", "кег 20л", "банка 0.33л"]))])
    out = rows.select("file_id", F.lit(1).alias("page"), F.lit(1).alias("table"), F.explode(F.when(at == 0, F.concat(heads, F.array(body))).otherwise(F.array(body))).alias("r"))
    return out.select("file_id", "page", "table", "r.row", "r.cells")


def page_products(s: SparkSession, d: str) -> DataFrame:
    return pages.products(page_grid(s, d)).select("file_id", "row", "price_column", "beer_name", "abv", "price", "format_type", "volume")


def page_lines(s: SparkSession, d: str) -> DataFrame:
    """Text lines that read 'NAME STYLE 5.5%' among others, with the brewery of a brewery's own list."""
    i = F.col("id")
    text = F.when(i % 3 == 0, F.concat(F.lit("(NEW) Lot"), i.cast("string"), F.lit(" Smoked Porter "), (i % 9 + 1).cast("string"), F.lit(".5%ABV"))).when(i % 3 == 1, F.concat(F.lit("House Red"), i.cast("string"), F.lit(" Session Ale 4%"))).otherwise("just a line of text")
    found = pages.line_products(numbered(s, d).select("file_id", "id", text.alias("text")), F.lit("House"))
    suppliers = numbered(s, d).groupBy("file_id").agg(F.max("list").alias("n")).select("file_id", F.when(F.col("n") % 2 == 0, "brewery").otherwise("distributor").alias("kind"), F.when(F.col("n") % 2 == 0, "Dusk").alias("name"))
    return pages.brewery_filled(found, suppliers).select("id", "beer_name", "style", "abv", F.nullif("brewery", F.lit("")).alias("brewery"))


def card_products(s: SparkSession, d: str) -> DataFrame:
    """Tables of five products side by side; in every third table the rows say what they are, in others their contents do."""
    i, t = F.col("id"), F.floor(F.col("id") / 5)
    cards = numbered(s, d).groupBy("file_id", t.cast("int").alias("table")).agg(F.sort_array(F.collect_list(F.struct("id", F.concat(F.when(i % 2 == 0, "(NEW) ").otherwise(""), F.lit("Dusk card number "), i.cast("string")).alias("name"), F.when(i % 4 == 0, "Baltic Porter").otherwise("Gose").alias("style"), F.concat((i % 9 + 3).cast("string"), F.lit(".5%ABV")).alias("abv")))).alias("c"))
    told = lambda word: F.when(F.col("table") % 3 == 0, F.array(F.lit(word))).otherwise(F.array().cast("array<string>"))
    rows = F.array(*[F.struct(F.lit(k).alias("row"), F.concat(F.col(f"c.{f}"), told(w)).alias("cells")) for k, (f, w) in enumerate((("abv", "ТТХ"), ("name", "Название"), ("style", "Стиль")))])
    grid = cards.select("file_id", F.lit(1).alias("page"), "table", F.explode(rows).alias("r")).select("file_id", "page", "table", "r.row", "r.cells")
    return pages.cards(grid).select("table", "column", "beer_name", "style", "abv")


def formats_in_text(s: SparkSession, d: str) -> DataFrame:
    """Packaging and volume from names and texts where they are missing, and the tab that each product belongs to."""
    i = F.col("id")
    form = F.when(i % 5 == 0, "кег 30 л").when(i % 5 == 1, "коробка").when(i % 5 == 2, "20 л")
    text = F.when(i % 4 == 0, "в бутылка 0,75 л").when(i % 4 == 1, "a can").when(i % 4 == 2, "без тары")
    of = packaging.in_text(form, F.when(i % 5 == 2, 20), F.concat(F.lit("lot "), i.cast("string")), text)
    return bound.items(s, d).select("id", of["format_type"].alias("format_type"), of["volume"].alias("volume"), packaging.bucket(of["format_type"]).alias("tab"))


def doubtful_names(s: SparkSession, d: str) -> DataFrame:
    """Lists in which the name column holds long texts or nothing but styles, and what the last resort makes of them."""
    n, i = F.col("list"), F.col("id")
    long = F.concat(F.lit("вкус и аромат хмеля, насыщенный и сочный, обусловлен использованием солода, номер "), i.cast("string"))
    first = F.when(n % 2 == 0, F.when(i % 2 == 0, "Session Ale").otherwise("Black IPA")).otherwise(long)
    rows = numbered(s, d).withColumn("values", F.array(first, F.concat(F.lit("lot "), F.upper("beer_name")), (i % 900 + 50).cast("string")))
    cells = spread(rows, F.array(*map(F.lit, ["Wert A", "Wert B", "Wert C"])), F.lit(0), F.lit(3))
    seen = rules.profiles(*ingest.headed(cells))
    at = (n % 3).cast("int")
    lists = numbered(s, d).where("at = 0").select("file_id", at.alias("place"))
    told = seen.join(lists, "file_id").withColumn("m", F.create_map(F.lit("beer_name"), F.col("place")))
    moved = rules.names_told_from_texts(F.col("m"), F.col("columns"))
    last = rules.generic(F.col("columns"))
    styles = rules.style_only(rules.column_at(F.col("columns"), F.col("place"))["values"])
    field = lambda m, f: rules.at(m, f)
    return told.select("file_id", styles.alias("style_only"), field(moved, "beer_name").alias("name_at"), field(moved, "description").alias("text_at"), field(last, "price").alias("price_at"))


def merged_by_name(s: SparkSession, d: str) -> DataFrame:
    """Rows of tables and text lines with the same names, merged in each file; the same names stand in several files."""
    i = F.col("id")
    rows = numbered(s, d).select("id", "file_id", F.concat(F.lit("Lot "), (F.col("at") % 40).cast("string")).alias("beer_name"), F.when(i % 2 == 0, F.col("style")).alias("style"), F.when(i % 3 == 0, "5.5").alias("abv"), F.when(i % 5 == 0, F.col("price")).alias("price"), F.lit(None).cast("double").alias("volume"), F.when(i % 7 == 0, F.col("format_type")).alias("format_type"), F.lit("x").alias("brewery"))
    return extract.merged_by_name(rows, "id").select("id", "file_id", "beer_name")


QUERIES = {
    "header_rows": lambda s, d: headers.by_score(varied(s, d)),
    "header_rows_by_kind": lambda s, d: headers.by_kinds(varied(s, d)),
    "varied_headers": lambda s, d: headers.found(varied(s, d)).select("file_id", "header_row"),
    "varied_columns": varied_columns,
    "varied_ingest": varied_ingest,
    "ranked_columns": ranked_columns,
    "multi_price_ingest": multi_price,
    "rule_columns": ruled,
    "guessed_columns": guesses,
    "digit_columns": digit_columns,
    "csv_widths": csv_widths,
    "csv_ingest": csv_ingest,
    "supplier_kinds": supplier_kinds,
    "page_products": page_products,
    "page_lines": page_lines,
    "merged_by_name": merged_by_name,
    "card_products": card_products,
    "formats_in_text": formats_in_text,
    "doubtful_names": doubtful_names,
}
_LISTS = f"WITH {bound.ITEMS}, lists AS (SELECT *, format('list-{{:06d}}', id // {sheets.ROWS}) AS fid, (id // {sheets.ROWS})::INT AS n, (id % {sheets.ROWS})::INT AS pos FROM items) "
_ASSIGNED = " UNION ALL ".join(f"SELECT '{f}' AS field, {i} AS j" for i, f in enumerate(FIELDS))
_STOCK = "CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'format_type' ELSE 'stock' END"
ORACLES = {
    "header_rows": _LISTS + "SELECT DISTINCT fid AS file_id, 'Пиво' AS sheet, (n % 5)::INT AS header_row FROM lists",
    "header_rows_by_kind": _LISTS + "SELECT DISTINCT fid AS file_id, 'Пиво' AS sheet, (n % 5)::INT AS header_row FROM lists",
    "varied_headers": _LISTS + "SELECT DISTINCT fid AS file_id, (n % 5)::INT AS header_row FROM lists",
    "varied_columns": _LISTS + f", a AS ({_ASSIGNED}) SELECT DISTINCT fid AS file_id, field, ((j + n) % {N})::INT AS col_idx FROM lists, a",
    "varied_ingest": _LISTS + f"SELECT fid AS file_id, pos + 1 + n % 5 AS row_idx, brewery, beer_name, style, price::DECIMAL(10, 2)::DOUBLE AS price, currency, volume, format_type, true AS is_valid FROM lists WHERE {COUNTED}",
    "ranked_columns": _LISTS + f", a AS ({_ASSIGNED}) SELECT DISTINCT fid AS file_id, field, ((j + n) % {N})::INT AS col_idx FROM lists, a WHERE field IN ('style', 'volume')",
    "multi_price_ingest": _LISTS + """, p AS (SELECT fid AS file_id, pos + 1 AS row_idx, beer_name, floor(price)::DOUBLE AS price, 'банка' AS format_type, 0.33::DOUBLE AS volume FROM lists WHERE pos % 3 > 0
        UNION ALL SELECT fid, pos + 1, beer_name, floor(price * 10)::DOUBLE, 'кег', 20.0 FROM lists WHERE pos % 2 > 0) SELECT * FROM p""",
    "rule_columns": _LISTS
    + f"""SELECT DISTINCT fid AS file_id, field, ((j + n) % 5)::INT AS col_idx FROM (SELECT fid, n, unnest(['brewery', 'beer_name', 'price', {_STOCK}, CASE WHEN n % 4 = 3 THEN 'format_type' ELSE 'description' END, CASE WHEN n % 4 = 2 THEN 'format_type' END]) AS field, unnest([0, 1, 2, 3, 4, 3]) AS j FROM lists) WHERE field IS NOT NULL""",
    "guessed_columns": _LISTS + "SELECT DISTINCT fid AS file_id, -1 AS header_row, field, ((j + n) % 2)::INT AS col_idx FROM (SELECT fid, n, unnest(['beer_name', 'price']) AS field, unnest([0, 1]) AS j FROM lists)",
    "digit_columns": _LISTS + "SELECT DISTINCT fid AS file_id, field, ((j + n) % 4)::INT AS col_idx FROM lists, (SELECT unnest(['beer_name', 'price', 'abv']) AS field, unnest([0, 1, 2]) AS j)",
    "csv_widths": _LISTS
    + f"""SELECT fid AS file_id, (pos + 1 + n % 3 + (n % 3 > 0)::INT)::INT AS row_idx, CASE pos % 7 WHEN 3 THEN 5 WHEN 5 THEN 7 ELSE 6 END AS width,
            length(brewery) + length(beer_name) + length(style) + length(price::VARCHAR) + length(volume::INT::VARCHAR) + 2 + CASE pos % 7 WHEN 3 THEN 0 WHEN 5 THEN 19 + length(format_type) ELSE length(format_type) END AS chars FROM lists
        UNION ALL SELECT DISTINCT fid, (n % 3 + (n % 3 > 0)::INT)::INT, 6, {sum(map(len, sheets.COLUMNS))} FROM lists
        UNION ALL SELECT DISTINCT fid, i::INT, 1, 24 FROM lists, range(0, 2) r(i) WHERE i < n % 3""",
    "csv_ingest": _LISTS + "SELECT fid AS file_id, pos + 1 + n % 3 + (n % 3 > 0)::INT AS row_idx, brewery, beer_name, style, price::DECIMAL(10, 2)::DOUBLE AS price, currency, volume, CASE WHEN pos % 7 = 3 THEN '' ELSE format_type END AS format_type, true AS is_valid FROM lists",
    "supplier_kinds": _LISTS
    + """, b AS (SELECT n, fid, count(DISTINCT brewery) AS breweries FROM (SELECT * FROM lists WHERE pos < 20) GROUP BY ALL)
        SELECT CASE WHEN n % 8 = 3 THEN 'Прайс ' ELSE 'lot ' END || fid || '.xlsx' AS file_id,
          CASE n % 4 WHEN 0 THEN 'brewery' WHEN 1 THEN CASE WHEN breweries > 1 THEN 'distributor' ELSE 'brewery' END WHEN 2 THEN 'brewery' ELSE CASE WHEN n % 8 = 3 THEN 'distributor' ELSE 'unknown' END END AS kind,
          CASE n % 4 WHEN 0 THEN 'House ' || n WHEN 2 THEN 'Dusk' END AS name FROM b""",
    "page_products": _LISTS
    + """, r AS (SELECT * EXCLUDE (file_id), fid AS file_id, pos + 2 AS row, 'Dusk number ' || id AS nm, (id % 9 + 3) || '.5' AS strength, (id % 300 + 100)::VARCHAR AS can, (id % 900 + 5000)::VARCHAR AS keg FROM lists WHERE pos % 11 NOT IN (5, 7))
        SELECT file_id, row, 4 AS price_column, nm AS beer_name, strength AS abv, can AS price, 'банка' AS format_type, 0.33::DOUBLE AS volume FROM r
        UNION ALL SELECT file_id, row, 3, nm, strength, CASE WHEN id % 3 > 0 THEN keg ELSE can END, 'кег', 20.0 FROM r WHERE id % 12 > 0""",
    "page_lines": _LISTS
    + """SELECT id, CASE id % 3 WHEN 0 THEN 'Lot' || id ELSE 'House Red' || id END AS beer_name, CASE id % 3 WHEN 0 THEN 'Smoked Porter' ELSE 'Session Ale' END AS style,
        CASE id % 3 WHEN 0 THEN (id % 9 + 1) || '.5' ELSE '4' END AS abv, CASE WHEN id % 3 = 1 THEN 'House' WHEN n % 2 = 0 THEN 'Dusk' END AS brewery FROM lists WHERE id % 3 < 2""",
    "card_products": _LISTS + "SELECT (id // 5)::INT AS table, (id % 5)::INT AS column, 'Dusk card number ' || id AS beer_name, CASE WHEN id % 4 = 0 THEN 'Baltic Porter' ELSE 'Gose' END AS style, (id % 9 + 3) || '.5' AS abv FROM lists",
    "formats_in_text": _LISTS
    + """, f AS (SELECT id, CASE id % 5 WHEN 0 THEN 'кег 30 л' WHEN 1 THEN 'коробка' WHEN 2 THEN '20 л' ELSE CASE id % 4 WHEN 0 THEN 'бутылка' WHEN 1 THEN 'банка' END END AS format_type FROM items)
        SELECT id, format_type, CASE WHEN id % 5 = 2 THEN 20.0 WHEN id % 5 > 2 AND id % 4 = 0 THEN 0.75 WHEN format_type = 'банка' THEN 0.45 END::DOUBLE AS volume,
          CASE WHEN format_type IN ('коробка', 'бутылка', 'банка') THEN 'Банки' WHEN format_type IS NULL THEN 'Прочее' ELSE 'Кеги' END AS tab FROM f""",
    "doubtful_names": _LISTS
    + """SELECT DISTINCT fid AS file_id, n % 2 = 0 AS style_only, CASE WHEN n % 2 = 1 THEN (SELECT min((j + n) % 3) FROM range(1, 3) r(j))::INT ELSE (n % 3)::INT END AS name_at, CASE WHEN n % 2 = 1 THEN (n % 3)::INT END AS text_at, ((2 + n) % 3)::INT AS price_at FROM lists""",
    "merged_by_name": _LISTS
    + """SELECT id, fid AS file_id, 'Lot ' || (pos % 40) AS beer_name FROM lists
        QUALIFY row_number() OVER (PARTITION BY fid, pos % 40 ORDER BY (id % 2 = 0)::INT + (id % 3 = 0)::INT + (id % 5 = 0)::INT + (id % 7 = 0)::INT DESC, id) = 1""",
}
