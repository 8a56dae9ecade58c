"""Rows of fields from mapped cells, with the context that price lists leave out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmalt.functions import normalize, packaging
from sparkmalt.functions.text import DASHES, clean, null_if_empty, present, settled
from sparkmalt.operators import scan
from sparkmalt.operators.headers import SHEET, with_rows

WIDE = ["brewery", "beer_name", "style", "abv", "ibu", "price", "currency", "volume", "format_type", "stock", "supplier_name", "description"]
EMPTY = [*DASHES, "nan", "none", "null", "n/a", "na"]


def empty(c: Column) -> Column:
    return F.lower(clean(c)).isin(EMPTY)


def wide(cells: DataFrame, header_rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """A row per sheet row under the headings, a column per field."""
    body = with_rows(cells, header_rows).where("row_idx > header_row").join(mapping, [*SHEET, "col_idx"])
    return body.groupBy(*SHEET, "row_idx").pivot("field", WIDE).agg(F.first(null_if_empty(F.col("value"))))


def split_cells(rows: DataFrame) -> DataFrame:
    """Cells that hold several fields taken apart: name and text, strength and bitterness, packaging and volume, brewery in a name."""
    name, strong, packed = packaging.name_and_text(F.col("beer_name")), packaging.strength(F.col("abv")), packaging.packed(F.col("format_type"))
    out = settled(rows, {"__n": name, "__s": strong, "__p": packed, "__label": packaging.is_label(F.col("beer_name"))})
    fields = {
        "beer_name": F.nullif(F.col("__n.name"), F.lit("")),
        "description": F.coalesce(F.col("description"), F.nullif(F.col("__n.text"), F.lit(""))),
        "abv": F.col("__s.abv"),
        "ibu": F.coalesce(F.col("ibu"), F.col("__s.ibu")),
        "format_type": F.coalesce(F.col("__p.format_type"), F.when(F.col("__label"), packaging.kind(F.col("beer_name")))),
        "volume": F.coalesce(F.col("volume"), F.col("__p.volume").cast("string"), F.when(F.col("__label"), packaging.litres(F.col("beer_name"))).cast("string")),
        "price": packaging.first_price(F.col("price")),
        "stock": F.when(~packaging.is_price_heading(F.col("stock")), F.col("stock")),
        "brewery": F.coalesce(F.col("brewery"), packaging.brewery_in_name(F.col("__n.name"))),
    }
    return settled(out, fields).drop("__n", "__s", "__p", "__label")


def continued(rows: DataFrame, order: str = "row_idx", crowded: bool | None = False) -> DataFrame:
    """Rows that name a packaging only get name, style, strength, bitterness and text of the product above; ``crowded`` as in ``scan``."""
    own = present(F.col("beer_name")) & ~packaging.is_label(F.col("beer_name"))
    carried = ["beer_name", "style", "abv", "ibu", "description"]
    out = scan.scanned(rows.withColumn("__own", own), SHEET, [order], carry={"__last": F.when(F.col("__own"), F.struct(*carried))}, crowded=crowded)
    filled = {c: F.when(F.col("__own"), F.col(c)).otherwise(F.coalesce(F.nullif(F.when(F.lit(c != "beer_name"), clean(F.col(c))), F.lit("")), F.col(f"__last.{c}"))) for c in carried}
    return out.withColumns(filled).drop("__own", "__last")


def forward_filled(rows: DataFrame, column: str = "brewery", keys: list[str] = SHEET, order: str = "row_idx", crowded: bool | None = False) -> DataFrame:
    """The last filled value above where a value is missing; ``crowded`` as in ``scan``."""
    return scan.scanned(rows, keys, [order], carry={column: F.nullif(clean(F.col(column)), F.lit(""))}, crowded=crowded)


def by_price_column(rows: DataFrame, prices: list[tuple[str, str]]) -> DataFrame:
    """A row per filled price column of ``prices`` (column, heading), with the packaging that the heading speaks of."""
    options = F.array(*[F.struct(F.col(c).alias("price"), packaging.heading_format(F.lit(h)).alias("of")) for c, h in prices])
    out = rows.withColumn("__o", F.explode(F.filter(options, lambda x: x["price"].rlike(r"\d"))))
    return out.withColumns({"price": packaging.first_price(F.col("__o.price")), "format_type": F.col("__o.of.format_type"), "volume": F.col("__o.of.volume")}).drop("__o", *[c for c, _ in prices if c != "price"])


def by_options(rows: DataFrame) -> DataFrame:
    """Rows with ``options`` (price columns: price and of) become a row per option; others keep their own price."""
    out = rows.withColumn("__o", F.explode_outer("options"))
    there = F.col("__o").isNotNull()
    pick = lambda new, old: F.when(there, new.cast("string")).otherwise(F.col(old))
    return out.withColumns({"price": pick(F.col("__o.price"), "price"), "format_type": pick(F.col("__o.of.format_type"), "format_type"), "volume": pick(F.col("__o.of.volume"), "volume")}).drop("__o", "options")


def any_in(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(clean(c)).contains(w) for w in words])


def valid_rows(rows: DataFrame, strict_cities: bool = False) -> DataFrame:
    """Rows that name a product.

    Out go rows without a valid mix of fields, breweries alone with an address
    or service word, register codes, and rows whose brewery has a city: if the
    name is missing or the city won't go; with ``strict_cities`` all of them.
    """
    c = F.col
    name, brewery, style, price, form = (~empty(c(x)) for x in ("beer_name", "brewery", "style", "price", "format_type"))
    mix = (name & (price | brewery | style)) | (brewery & price) | (price & form)
    alone = brewery & ~name & ~price & ~style & (any_in(c("brewery"), packaging.PLACE_WORDS + packaging.SERVICE_WORDS) | (F.length(clean(c("brewery"))) < 3))
    city = any_in(c("brewery"), packaging.CITY_WORDS)
    code = packaging.is_code(c("beer_name"), c("description")) | (F.lower(clean(c("beer_name"))) == "егаис") | (F.lower(clean(c("brewery"))) == "егаис")
    out = settled(rows, {"__good": mix & ~alone & ~code, "__city": city, "__left": F.when(city, normalize.brewery(c("brewery"), boundary=not strict_cities)).otherwise(""), "__named": name})
    stays = (c("__left") == "") | any_in(c("__left"), packaging.CITY_WORDS)
    return out.where(c("__good") & ~(c("__city") & (F.lit(strict_cities) | ~c("__named") | stays))).drop("__good", "__city", "__left", "__named")


def finished(rows: DataFrame) -> DataFrame:
    """Draft sheets are kegs; a row without a volume stays only if it is a can, by default 0.45 l, or a keg."""
    draft = F.lower("sheet").rlike("розлив|draft|keg|кег")
    form = F.coalesce(F.nullif(clean(F.col("format_type")), F.lit("")), F.when(draft, F.lit("кега")), F.lit(""))
    can, keg = F.lower(form).rlike("банка|can"), F.lower(form).rlike("кег|keg")
    volume = F.coalesce(F.col("volume"), F.when(can, F.lit(str(packaging.DEFAULT_CAN_LITRES))))
    return settled(rows, {"format_type": form, "volume": volume, "__keg": keg}).where("volume IS NOT NULL OR __keg").drop("__keg")


def merged_by_name(rows: DataFrame, order: str, keys: tuple[str, ...] = ("file_id",), fields: tuple[str, ...] = ("style", "abv", "price", "volume", "format_type")) -> DataFrame:
    """One row per file and lower-case name: that with most fields filled, the first among equals."""
    filled = reduce(lambda a, b: a + b, [present(F.col(f)).cast("int") for f in fields])
    return rows.groupBy(*keys, F.lower(clean(F.col("beer_name"))).alias("__name")).agg(F.max_by(F.struct(*rows.columns), F.struct(filled, -F.col(order))).alias("row")).select("row.*")


def sessions(lines: DataFrame, starts: Column, keys: list[str], order: str, ends: Column | None = None) -> DataFrame:
    """Lines with ``session``: how many starting lines have come so far.

    Lines before the first start go, and lines from an ending one to the next
    start. A key's lines are numbered in one task, so a key is a text or a page.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines.withColumn("session", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    if ends is None:
        return out.where("session > 0")
    state = F.when(starts, True).when(ends, False)
    return out.withColumn("__open", F.last(state, ignorenulls=True).over(w)).where("session > 0 AND __open").drop("__open")


def lines_of(texts: DataFrame, key: str, text: str, blank: bool = False) -> DataFrame:
    """(key, line, text) for the lines of texts, with or without blank ones."""
    out = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "text"))
    return out if blank else out.where(F.trim("text") != "")
