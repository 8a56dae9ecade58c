"""Display texts and packaging decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean, contains_any

# Packaging words: fixed values.
KEG, PACKED = ["кег", "keg", "draft", "tap", "розлив"], ["бан", "can", "бут", "bottle"]
KEG_LITRES = 15
LITRE_PRICE_BELOW = 2000


def looks_like_keg(format_type: Column, volume: Column) -> Column:
    """By packaging words, else from 15 litres."""
    f = F.lower(clean(format_type))
    return F.when(contains_any(f, KEG), True).when(contains_any(f, PACKED), False).otherwise(F.coalesce(volume >= KEG_LITRES, F.lit(False)))


def short_number(c: Column) -> Column:
    """Six significant digits at most, no trailing zeros."""
    whole = F.round(c) == c
    return F.when(whole, c.cast("long").cast("string")).otherwise(F.regexp_replace(F.round(c, 5).cast("string"), r"\.?0+$", ""))


def volume_price(volume: Column, price: Column, currency: Column, format_type: Column) -> Column:
    """'0.5 л · 150 ₽ · банка', parts that are missing left out."""
    code = F.upper(F.coalesce(F.nullif(clean(currency), F.lit("")), F.lit("RUB")))
    shown = F.when(code == "RUB", F.concat(F.bround(price.cast("double")).cast("long").cast("string"), F.lit(" ₽"))).otherwise(F.concat_ws(" ", short_number(price.cast("double")), code))
    parts = F.array(F.concat(short_number(volume.cast("double")), F.lit(" л")), F.when(price.isNotNull(), shown), F.nullif(clean(format_type), F.lit("")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ")


def abv_text(abv: Column) -> Column:
    return F.coalesce(F.concat(short_number(abv.cast("double")), F.lit(" %")), F.lit(""))


def ibu_text(ibu: Column) -> Column:
    return F.substring(clean(ibu), 1, 64)


def beer_label(brewery: Column, name: Column, price: Column | None = None) -> Column:
    """'Brewery | Name' or what there is of it, with '(price)' after it."""
    text = F.array_join(F.filter(F.array(clean(brewery), clean(name)), lambda x: x != ""), " | ")
    return text if price is None else F.concat(text, F.coalesce(F.concat(F.lit("("), price.cast("string"), F.lit(")")), F.lit("")))


def parse_label(label: Column) -> Column:
    """Struct (brewery, name, price) from 'Brewery | Name(price)'."""
    pattern = r"^\s*(?:([^|]*?)\s*\|\s*)?([^|(]*?)\s*(?:\(([^)]*)\))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(clean(label), pattern, i), F.lit(""))
    return F.struct(part(1).alias("brewery"), part(2).alias("name"), F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double").alias("price"))


def export_format(format_type: Column) -> Column:
    """кег, банка, бут or the first ten characters."""
    f = F.lower(clean(format_type))
    return F.when(f.contains("кег") | f.contains("keg"), "кег").when(f.contains("бан") | f.contains("can"), "банка").when(f.contains("бут") | f.contains("bottle"), "бут").otherwise(F.substring(clean(format_type), 1, 10))


def line_total(price: Column, quantity: Column, volume: Column, keg: Column, unit: Column | None = None) -> Column:
    """Price times quantity; a keg's price is per litre if ``unit`` says so or, without a unit, if it is under 2000."""
    per_litre = price < LITRE_PRICE_BELOW if unit is None else F.when(unit == "liter", True).when(unit == "keg", False).otherwise(price < LITRE_PRICE_BELOW)
    times = F.when(keg & per_litre & (volume > 0), volume).otherwise(F.lit(1.0))
    return F.coalesce(price, F.lit(0.0)) * times * quantity


def default_quantity(keg: Column) -> Column:
    return F.when(keg, 1).otherwise(10)
