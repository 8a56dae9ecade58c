"""Rows of page tables (file_id, page, table, row, cells) as product rows, and products in text lines.

A table's first rows (a bounded few) say where its heading row is, which column
is which field and which columns hold prices; these facts are joined to all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions import normalize
from sparkmalt.functions.text import clean, settled
from sparkmalt.operators.rules import at, dealt, first_column, has, mentions, named, nothing, put

TABLE = ["file_id", "page", "table"]
HEAD_ROWS, TOP_ROWS = 5, 8
# Words of headings, of rows that are no products, and patterns: fixed values.
HEADINGS = {
    "brewery": ["пивоварня", "производитель", "brewery", "manufacturer", "brand", "бренд", "марка", "пивовар", "произв", "brewer", "producer"],
    "beer_name": ["название", "пиво", "beer", "name", "наименование", "товар", "продукт", "назв", "наим", "product"],
    "style": ["стиль", "style", "тип", "type", "сорт", "с/п/пь", "с/п/п", "с.п.п", "с п п", "category", "вид"],
    "abv": ["abv", "крепость", "алкоголь", "alcohol", "алк", "%", "объемная доля", "ttx", "ттх", "ттx", "alc"],
    "ibu": ["ibu", "горечь", "bitterness", "горьк"],
    "price": ["цена", "price", "стоимость", "cost", "руб", "рублей", "₽", "eur", "usd", "$", "€", "объём/цена", "объем/цена", "объём/цена кег", "объем/цена кег", "объём/цена фасовка", "объем/цена фасовка"],
    "currency": ["валюта", "currency", "curr"],
    "volume": ["объём", "volume", "литр", "литров", "л", "ml", "мл", "литры", "объём/цена", "объем/цена", "объём/цена кег", "объем/цена кег", "объём/цена фасовка", "объем/цена фасовка", "lt", "l."],
    "format_type": ["формат", "format", "упаковка", "packaging", "банка", "бутылка", "кeg", "кег", "бут", "объём/цена фасовка", "объем/цена фасовка", "тара", "фасовка"],
    "stock": ["остаток", "stock", "наличие", "availability", "в наличии", "есть", "доступно", "наличие кег", "наличие фасовка"],
    "description": ["описание", "description", "desc", "коммент"],
}
KNOWN = ["название", "наименование", "name", "beer", "стиль", "style", "тип", "type", "с/п/пь", "цена", "price", "стоимость", "cost", "объём", "объем", "volume", "литр", "abv", "ttx", "ттх", "крепость", "формат", "format", "упаковка", "packaging", "описание", "description", "наличие"]
ROW_HEADINGS = ["название", "наименование", "name", "beer", "стиль", "style", "тип", "type", "цена", "price", "стоимость", "cost", "объём", "объем", "volume", "abv", "ttx", "ттх", "крепость", "формат", "format", "упаковка", "описание", "description", "наличие", "availability"]
FIRST_CELL_HEADINGS = ["название", "наименование", "name", "beer", "стиль", "style", "ttx", "ттх", "цена", "price", "объём", "объем"]
SERVICE = ["дата", "коробка", "шт", "розлива", "наличии", "наличие", "банка", "бутылка", "кег", "keg", "can", "bottle", "руб", "р/", "₽", "литр"]
UNITS = r"(?iu)\d\s*[лl](?!\p{L})"  # the letters alone would bar every name that has them
NOT_NAMES = ["ttx", "ттх", "описание", "description", "название", "наименование", "наличие", "наличии", "traditional", "traditional gose", "копидный", "опис", "desc"]
JOINT = [" x ", " xdieta", "x dieta", "x diеta", "on the bones", "libra"]
JOINT_BREW = r"(?iu)^(ON THE BONES|LIBRA)\s+X\s+DIETA\s+(.+)$"
SLOGAN = r"(?iu)главное\s*[–—\-]\s*участие\s*!?"
PRICED = r"\d+\.?\d*\s*[руб₽]"
LINE = r"(?iu)(.+?)\s+([A-Z][a-z\s]+(?:Porter|Ale|IPA|Lager|Gose|Pilsner|Stout|Sour)[a-z\s]*)\s+(\d+\.?\d*)%"
PACKS = {"банка": ["банка", "can", "б"], "бутылка": ["бутылка", "bottle", "бут"], "кег": ["кег", "keg", "к"]}
# What a text recogniser takes for something else, in the order of mending: fixed values.
MISREAD = [
    ("aer", "кег"),
    ("бажжя|бачка", "банка"),
    ("p/n", "р/л"),
    ("p/", "р/"),
    ("uгr", "шт"),
    (r"(\d+\.?\d*)\s*n\s*([\s\-])", "$1 л$2"),
    (r"(\d+\.?\d*)\s*n\s*$", "$1 л"),
    (r"(\d+\.?\d*)\s*n\s*р", "$1 л р"),
    (r"0\.00s", "0.45л"),
    (r"(\d+)\.(\d+)\s*[il1]", "$1.$2л"),
    (r"(?<!\p{L})кега(?!\p{L})", "кег"),
    (r"(?<!\p{L})банки(?!\p{L})", "банка"),
]


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(clean(c), r"\s+", " "))


def mended(c: Column) -> Column:
    """A cell in small letters on one line, with usual misreadings put right."""
    out = F.lower(one_line(c))
    for pattern, right in MISREAD:
        out = F.regexp_replace(out, pattern, right)
    return out


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern, null if it isn't there."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def litres(c: Column, low: float, high: float) -> Column:
    value = found(c, r"(\d+\.?\d*)\s*л").cast("double")
    return F.when(value.between(low, high), value)


def heading_map(headings: Column) -> Column:
    """Field to column of headings (array of small-letter texts): exact words first, each heading once; then the longest word that a heading holds."""
    cells = F.transform(headings, lambda h, i: F.struct(i.alias("col_idx"), h.alias("header")))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, words)).alias("words")) for f, words in HEADINGS.items()])
    exact = dealt(cells, nothing(), lambda c: F.transform(F.filter(fields, lambda f: F.array_contains(f["words"], c["header"])), lambda f: f["field"]))

    def longest(f: Column, h: Column) -> Column:
        fits = lambda w: h.contains(w) & ((F.length(w) >= 3) | h.startswith(w) | h.endswith(w))
        return F.coalesce(F.array_max(F.transform(F.filter(f["words"], fits), F.length)), F.lit(0))

    def rest(m: Column, f: Column) -> Column:
        there = first_column(cells, lambda c: (c["header"] != "") & (longest(f, c["header"]) > 0), lambda c: longest(f, c["header"]))
        return F.when(has(m, f["field"]), m).otherwise(put(m, f["field"], there))

    return F.aggregate(fields, exact, rest)


def is_heading(headings: Column, mapping: Column) -> Column:
    """Short texts without prices or strengths, with a known word, that name two fields or the beer."""
    data = F.exists(headings, lambda h: h.rlike(r"\d+\s*[руб₽]|\d+\.?\d*\s*%abv") | ((F.length(h) > 50) & ~mentions(h, ["объём", "объем", "цена", "описание"])))
    return ~data & F.exists(headings, lambda h: mentions(h, KNOWN)) & ((F.size(mapping) >= 2) | has(mapping, "beer_name"))


def positional(rows: Column) -> Column:
    """Name and style in the first columns; strength, text, prices and stock where rows two to four show them."""
    cells = F.flatten(F.transform(rows, lambda r: F.filter(F.transform(r["cells"], lambda v, i: F.struct(i.alias("col_idx"), F.lower(one_line(v)).alias("v"))), lambda c: (c["col_idx"] >= 2) & ~c["v"].isin("", "none", "nan"))))

    def wishes(v: Column) -> Column:
        price = v.contains("р/") | v.contains("руб") | (v.contains("банка") & v.contains("л"))
        one = lambda *f: F.array(*map(F.lit, f))
        return F.when(v.contains("%") & v.contains("abv"), one("abv")).when((F.length(v) > 30) & mentions(v, ["untappd", "imperial", "traditional", "традиционный"]), one("description")).when(price, one("price", "volume", "format_type")).when(v.contains("наличии") | v.isin("есть", "наличие"), one("stock")).otherwise(F.array().cast("array<string>"))

    def add(m: Column, c: Column) -> Column:
        return F.aggregate(F.filter(wishes(c["v"]), lambda f: ~has(m, f)), m, lambda m, f: put(m, f, c["col_idx"]))

    return F.aggregate(cells, put(put(nothing(), "beer_name", F.lit(0)), "style", F.lit(1)), add)


def price_of_heading(sub: Column, samples: Column) -> Column:
    """Struct (format, volume) that a price column's second heading or else its first cells speak of."""

    def spoken(t: Column, cans: list[str]) -> Column:
        can = F.coalesce(F.when(found(t, r"\(?\s*(\d+\.?\d*)\s*\)").cast("double").between(0.1, 1.5), found(t, r"\(?\s*(\d+\.?\d*)\s*\)").cast("double")), litres(t, 0.1, 1.5), F.lit(0.45))
        both = lambda f, v: F.struct(F.lit(f).alias("format"), v.cast("double").alias("volume"))
        return F.when(mentions(t, ["кег", "keg"]), both("кег", litres(t, 5, 50))).when(mentions(t, cans), both("банка", can))

    first = F.get(F.filter(F.transform(samples, lambda t: spoken(mended(t), ["банка", "can"])), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(spoken(mended(sub), ["банка", "фасовка", "can"]), first, F.struct(F.lit(None).cast("string").alias("format"), F.lit(None).cast("double").alias("volume")))


def tables(grid: DataFrame) -> DataFrame:
    """A row per table of two rows or more: first_row of data, mapping, and prices: array of (col_idx, format, volume)."""
    top = grid.where(F.col("row") < TOP_ROWS).groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rows")).where(F.size("rows") >= 2)
    headed = F.transform(F.slice("rows", 1, HEAD_ROWS), lambda r: F.struct(r["row"].alias("row"), F.transform(r["cells"], lambda x: F.lower(clean(x))).alias("headings")))
    mapped = settled(top, {"heads": F.transform(headed, lambda r: F.struct(r["row"], r["headings"], heading_map(r["headings"]).alias("mapping")))})
    out = settled(mapped, {"head": F.get(F.filter("heads", lambda r: is_heading(r["headings"], r["mapping"])), F.lit(0))})
    row_at = lambda i: F.get(F.filter("rows", lambda r: r["row"] == i), F.lit(0))["cells"]
    out = settled(out, {"below": row_at(F.col("head.row") + 1)})
    sub = F.coalesce(F.exists("below", lambda x: mentions(F.lower(clean(x)), ["кег", "фасовка", "банка", "keg"])), F.lit(False))
    out = settled(out, {"sub": sub, "first_row": F.coalesce(F.col("head.row") + 1 + sub.cast("int"), F.lit(1))})
    out = settled(out, {"mapping": F.coalesce(F.col("head.mapping"), positional(F.filter("rows", lambda r: r["row"].between(1, 3)))), "data": F.filter("rows", lambda r: r["row"].between(F.col("first_row"), F.col("first_row") + 2))})
    columns = F.filter(F.transform(F.col("head.headings"), lambda h, i: F.struct(i.alias("col_idx"), h.alias("h"))), lambda c: mentions(c["h"], ["объём", "объем", "цена", "price", "вицено"]))

    def price(c: Column) -> Column:
        of = price_of_heading(F.when(F.col("sub"), F.get("below", c["col_idx"])), F.transform("data", lambda r: F.get(r["cells"], c["col_idx"])))
        return named(of, lambda p: F.struct(c["col_idx"], p["format"].alias("format"), p["volume"].alias("volume")))

    prices = F.coalesce(F.transform(columns, price), F.array().cast("array<struct<col_idx:int,format:string,volume:double>>"))
    return settled(out, {"prices": prices}).select(*TABLE, "first_row", "mapping", "prices")


def is_product_row(cells: Column) -> Column:
    """No blank, numbers-only, heading or service row."""
    text = F.array_join(F.filter(F.transform(cells, one_line), lambda x: x != ""), " ")
    first = one_line(F.get(cells, F.lit(0)))
    low, head = F.lower(first), F.lower(F.array_join(F.transform(F.slice(cells, 1, 3), one_line), " "))
    heading = mentions(head, ROW_HEADINGS) & ~text.rlike(PRICED + r"|\d+\.?\d*\s*%")
    marked = low.startswith("(new)") | low.startswith("new") | mentions(low, JOINT)
    service = mentions(low, SERVICE) | low.rlike(UNITS) | (F.length(first) < 3) | first.rlike(r"^\d+\.?\d*\s*[руб₽]|\d+\.\d+\.\d+")
    bare = low.rlike(r"^\d+\.?\d*\s*(%|[руб₽p])\s*$") | low.isin(FIRST_CELL_HEADINGS)
    return (F.length(text) >= 5) & ~text.rlike(r"^[\d\s\-–—]+$") & ~heading & ((first == "") | (~bare & (marked | ~service)))


def price_cell(c: Column, format_: Column, volume: Column) -> Column:
    """Struct (price, format_type, volume) of a price cell, such as '230р/ банка 0.33л коробка 20шт – 4600р'; what the heading says comes first."""

    def parts(t: Column) -> Column:
        price = F.coalesce(found(t, r"(\d+\.?\d*)\s*[руб₽]\s*/"), found(t, r"(\d+\.?\d*)\s*[руб₽]"), found(t, r"^(\d+\.?\d*)"))
        word = found(t, r"(?<!\p{L})(банка|бутылка|кег|keg|can|bottle|бут|б|к)(?!\p{L})")
        spoken = F.when(mentions(t, ["банка", "can"]), "банка").when(mentions(t, ["кег", "keg"]), "кег").otherwise(F.coalesce(*[F.when(word.isin(words), F.lit(name)) for name, words in PACKS.items()]))
        return F.struct(price.alias("price"), F.coalesce(format_, spoken).alias("format_type"), t.alias("t"))

    def whole(p: Column) -> Column:
        bracket, named_ = found(p["t"], r"\(?\s*(\d+\.?\d*)\s*\)").cast("double"), found(p["t"], r"(\d+\.?\d*)\s*л").cast("double")
        own = F.coalesce(F.when(bracket <= 10, bracket), F.when((named_ <= 10) | (p["format_type"] == "кег"), named_), F.when(p["format_type"] == "банка", F.lit(0.45)))
        return F.struct(p["price"].alias("price"), p["format_type"].alias("format_type"), F.coalesce(volume, own).alias("volume"))

    return named(named(mended(c), parts), whole)


def name_parts(c: Column) -> Column:
    """Struct (brewery, name): a brew of two breweries parted, marks gone."""
    t = F.trim(F.regexp_replace(one_line(c), r"(?i)^\(NEW\)\s*", ""))
    joint, rest = F.regexp_extract(t, JOINT_BREW, 1), F.regexp_extract(t, JOINT_BREW, 2)
    slogan = F.trim(F.regexp_extract(t, SLOGAN, 0))
    return F.when(joint != "", F.struct(F.concat(joint, F.lit(" X DIETA")).alias("brewery"), F.when(slogan != "", slogan).otherwise(F.trim(rest)).alias("name"))).otherwise(F.struct(F.lit(None).cast("string").alias("brewery"), t.alias("name")))


def valid_name(c: Column) -> Column:
    low = F.lower(clean(c))
    joint = mentions(low, [*JOINT, "dieta"])
    service = low.isin(NOT_NAMES) | mentions(low, SERVICE) | low.rlike(UNITS) | (F.length(low) < 5)
    data = low.rlike(r"^\d+\.?\d*\s*%|^\d+\.?\d*\s*[руб₽p]|\d+\s*[руб₽]\s*/|\d+\.\d+\.\d+|[,.]$")
    preposition = low.rlike(r"^(и|в|на|с|по|для|о|об|от|из|к|у|за|под|над|про|при|перед|после|между|среди|через|без|ради|согласно)\s+") & ~mentions(low, ["mouth", "glass", "bone", "own", "your", "his", "the"])
    return (F.length(low) >= 3) & ~low.isin("диета", "dieta") & ~data & ~preposition & (joint | ~service)


def products(grid: DataFrame) -> DataFrame:
    """Product rows of page tables: a row per filled price column where a table has several, else one.

    An empty price cell takes the price of a cell beside it, at most two away.
    """
    rows = grid.join(tables(grid), TABLE).where((F.col("row") >= F.col("first_row")) & is_product_row(F.col("cells")))
    value = lambda f: F.when(~F.lower(one_line(F.get("cells", at(F.col("mapping"), f)))).isin("", "-", "—", "–", "nan", "none", "null", "n/a", "na"), one_line(F.get("cells", at(F.col("mapping"), f))))
    first = one_line(F.get("cells", F.lit(0)))
    rows = settled(rows, {"own": name_parts(F.coalesce(value("beer_name"), F.when(F.length(first) >= 5, first)))})
    rows = rows.where(valid_name(F.col("own.name")))
    near = lambda i: F.get(F.filter(F.transform(F.array(*[F.when(i + o >= 0, F.get("cells", F.when(i + o >= 0, i + o).otherwise(0))) for o in (-1, 1, -2, 2)]), lambda x: F.when(F.lower(x).rlike(PRICED), x)), lambda x: x.isNotNull()), F.lit(0))

    def option(p: Column) -> Column:
        cell = F.get("cells", p["col_idx"])
        return F.struct(p["col_idx"].alias("price_column"), price_cell(F.when(clean(cell) != "", cell).otherwise(near(p["col_idx"])), p["format"], p["volume"]).alias("of"))

    single = F.array(F.struct(F.lit(None).cast("int").alias("price_column"), price_cell(value("price"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("of")))
    options = F.when(F.size("prices") > 0, F.filter(F.transform("prices", option), lambda o: o["of"]["price"].isNotNull())).otherwise(single)
    out = settled(rows, {"style_": value("style"), "abv_": value("abv"), "volume_": value("volume"), "format_": value("format_type"), "options": options}).withColumn("o", F.explode("options"))
    style, abv, word = F.col("style_"), F.col("abv_"), found(F.lower("format_"), r"(?<!\p{L})(банка|бутылка|кег|keg|can|bottle|бут|б|к)(?!\p{L})")
    return out.select(
        *TABLE,
        "row",
        F.col("o.price_column").alias("price_column"),
        F.coalesce(F.col("own.brewery"), value("brewery")).alias("brewery"),
        F.trim(F.when(F.col("own.brewery").isNull(), F.regexp_replace(F.col("own.name"), SLOGAN, " ")).otherwise(F.col("own.name"))).alias("beer_name"),
        F.when(~style.rlike(r"(?i)\d+\.?\d*\s*%abv|\d+\s*[руб₽p]"), style).alias("style"),
        F.coalesce(found(abv, r"(\d+\.?\d*)\s*%"), found(abv, r"(\d+\.?\d*)")).alias("abv"),
        value("ibu").alias("ibu"),
        F.col("o.of.price").alias("price"),
        F.when(F.col("o.of.price").isNotNull(), "RUB").alias("currency"),
        F.coalesce(F.col("o.of.volume"), found(F.lower("volume_"), r"(\d+\.?\d*)\s*л").cast("double"), found(F.col("volume_"), r"(\d+\.?\d*)").cast("double")).alias("volume"),
        F.coalesce(F.col("o.of.format_type"), word, F.col("format_")).alias("format_type"),
        value("stock").alias("stock"),
        value("description").alias("description"),
    )


def cards(grid: DataFrame) -> DataFrame:
    """(file_id, page, table, column, beer_name, style, abv) of tables whose columns are products and whose few rows are their fields.

    The last cell of a row may say what the row holds; else the first row with
    long texts has the names, the first with a style's word the styles, the
    first with a percent sign the strengths; else they are the first three.
    """
    top = grid.where(F.col("row") < TOP_ROWS).groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rows")).where(F.size("rows") >= 2)
    label = lambda r: F.lower(one_line(F.element_at(r["cells"], -1)))
    near = lambda r: F.transform(F.slice(r["cells"], 1, 5), one_line)
    said = lambda words: F.get(F.filter("rows", lambda r: label(r).isin(words)), F.lit(0))["row"]
    seen = lambda test, *not_in: F.get(F.filter("rows", lambda r: F.exists(near(r), test) & reduce(lambda a, b: a & b, [~r["row"].eqNullSafe(F.col(x)) for x in not_in], F.lit(True))), F.lit(0))["row"]
    out = settled(top, {"names_at": F.coalesce(said(["название", "наименование", "name"]), seen(lambda x: F.length(x) > 15), F.lit(0))})
    out = settled(out, {"styles_at": F.coalesce(said(["стиль", "style", "с/п/пь"]), seen(lambda x: F.lower(x).rlike("porter|ale|ipa|gose|stout|pilsner|sour"), "names_at"), F.lit(1))})
    out = settled(out, {"abv_at": F.coalesce(said(["ттх", "ttx", "abv", "ттx"]), seen(lambda x: F.lower(x).rlike("%|abv"), "names_at", "styles_at"), F.lit(2))})
    row_at = lambda c: F.get(F.filter("rows", lambda r: r["row"] == F.col(c)), F.lit(0))["cells"]
    out = settled(out, {"n": row_at("names_at"), "s": row_at("styles_at"), "a": row_at("abv_at")})
    one = out.select(*TABLE, F.posexplode("n").alias("column", "name"), "s", "a")
    name = F.trim(F.regexp_replace(one_line(F.col("name")), r"(?i)^\(NEW\)\s*", ""))
    found_ = one.select(*TABLE, "column", name.alias("beer_name"), F.nullif(one_line(F.get("s", "column")), F.lit("")).alias("style"), found(one_line(F.get("a", "column")), r"(\d+\.?\d*)\s*%").alias("abv"))
    return found_.where(valid_name(F.col("beer_name")) & ~F.lower("beer_name").isin(FIRST_CELL_HEADINGS))


def line_products(lines: DataFrame, brewery: Column | None = None) -> DataFrame:
    """``lines`` (with ``text``) that read 'NAME STYLE 5.5%', with beer_name, style, abv, and the brewery if the name holds it."""
    t = F.trim("text")
    name = F.trim(F.regexp_replace(F.regexp_extract(t, LINE, 1), r"(?i)^\(NEW\)\s*", ""))
    own = F.lit(None).cast("string") if brewery is None else F.when(F.upper(name).contains(F.upper(brewery)), brewery)
    out = settled(lines, {"beer_name": F.when(F.length(t) >= 3, F.trim(name)), "style": F.trim(F.regexp_extract(t, LINE, 2)), "abv": F.regexp_extract(t, LINE, 3), "brewery": own})
    return out.where(F.coalesce(F.col("beer_name"), F.lit("")) != "")


def brewery_filled(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Rows of a brewery's own lists get its name where they have none; ``suppliers``: (file_id, kind, name)."""
    own = suppliers.where("kind = 'brewery' AND name IS NOT NULL").select("file_id", F.coalesce(F.nullif(normalize.brewery(F.col("name")), F.lit("")), F.col("name")).alias("__own"))
    return rows.join(own, "file_id", "left").withColumn("brewery", F.coalesce(F.nullif(clean(F.col("brewery")), F.lit("")), F.col("__own"))).drop("__own")
