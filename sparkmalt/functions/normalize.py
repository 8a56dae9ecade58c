"""Normalisation of item fields: strength, price, currency, volume, packaging, brewery, name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.numbers import NUMBER, first_number, safe_float
from sparkmalt.functions.text import clean, named, null_if_empty, present, settled

# Currency words in the order in which they are looked for: fixed values.
CURRENCIES = [("руб", "RUB"), ("рублей", "RUB"), ("рубль", "RUB"), ("р.", "RUB"), ("р", "RUB"), ("usd", "USD"), ("доллар", "USD"), ("долларов", "USD"), ("eur", "EUR"), ("евро", "EUR"), ("€", "EUR"), ("$", "USD")]
# Units in litres: fixed values.
UNITS = [("мл", 0.001), ("ml", 0.001), ("л", 1.0), ("литр", 1.0), ("литров", 1.0), ("l", 1.0), ("oz", 0.0295735), ("ounce", 0.0295735)]
# Packaging names: fixed values.
PACKAGING = [("can", "банка"), ("банка", "банка"), ("bottle", "бутылка"), ("бутылка", "бутылка"), ("keg", "кега"), ("кега", "кега"), ("бут", "бутылка"), ("б", "бутылка")]
# Names that are a city and nothing else: fixed values.
CITIES = ["владимир", "москва", "санкт-петербург", "спб", "мск", "moscow", "spb"]
# Cities and their forms as they stand in brewery names, in the order in which they go; E is the edge of a word: fixed values.
CITY_PATTERNS = [
    r"\s*Eг\.\s*Санкт-Петербург[а-яё]*",
    r"\s*Eг\s+Санкт-Петербург[а-яё]*",
    r"\s*EСанкт-Петербург[а-яё]*",
    r"\s*EСПб",
    r"\s*Espb",
    r"\s*Eг\.\s*Москв[а-яё]*",
    r"\s*Eг\s+Москв[а-яё]*",
    r"\s*EМоскв[а-яё]*",
    r"\s*Eмск",
    r"\s*Emsk",
    r"\s*Eг\.\s*Владимир[а-яё]*",
    r"\s*Eг\s+Владимир[а-яё]*",
    r"\s*EВладимир[а-яё]*",
    r"\s*Eг\.\s*[А-ЯЁа-яё\s-]+",
    r"\s*Eг\s+[А-ЯЁа-яё\s-]+",
    r"\s*Eгород\s+[А-ЯЁа-яё\s-]+",
    r"\s*Ecity\s+[А-ЯЁа-яёA-Za-z\s-]+",
    r"\s*,\s*Eг\.\s*[А-ЯЁа-яё\s-]+",
    r"\s*,\s*Eг\s+[А-ЯЁа-яё\s-]+",
    r"\s*,\s*Eгород\s+[А-ЯЁа-яё\s-]+",
    r"\s*,\s*Ecity\s+[А-ЯЁа-яёA-Za-z\s-]+",
]
# One of these stands in every text that the patterns above can change, in small letters: fixed values.
CITY_SIGNS = "г|спб|spb|москв|мск|msk|владимир|city"
SEPARATORS = [" - ", " — ", " – ", "|", " / "]  # fixed values


def looked_up(key: Column, pairs: list[tuple], default: Column) -> Column:
    """The value of the first pair whose key is equal."""
    return named(key, lambda k: reduce(lambda rest, p: F.when(k == p[0], F.lit(p[1])).otherwise(rest), reversed(pairs), default))


def abv(c: Column) -> Column:
    t = F.replace(F.trim(F.replace(clean(c), F.lit("%"), F.lit(""))), F.lit(","), F.lit("."))
    return F.regexp_extract(t, r"(\d+\.?\d*)", 1).try_cast("double")


def currency_in(c: Column) -> Column:
    """The first currency word that a text contains, roubles if none."""
    t = F.lower(clean(c))
    return reduce(lambda rest, p: F.when(t.contains(p[0]), F.lit(p[1])).otherwise(rest), reversed(CURRENCIES), F.lit("RUB"))


def currency(c: Column) -> Column:
    """A currency cell: the whole text has to be a currency word."""
    return looked_up(F.lower(clean(c)), CURRENCIES, F.lit("RUB"))


def litres(value: Column, unit: Column) -> Column:
    """Null for unknown units and for 0."""
    known = looked_up(F.lower(unit), UNITS, F.lit(None).cast("double"))
    return F.when(value != 0, value * known)


def volume_in_price(c: Column) -> Column:
    """Litres named in a price cell, in brackets first."""
    t, unit = clean(c), "(мл|л|ml|l|литр|литров)"

    def found(pattern: str) -> Column:
        number = F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        return litres(number, F.regexp_extract(t, pattern, 2))

    # most cells are a bare number
    return F.when(t.rlike("(?iu)[лlмm]"), F.coalesce(found(rf"(?iu)\({NUMBER}\s*{unit}"), found(rf"(?iu){NUMBER}\s*{unit}")))


def price(c: Column) -> Column:
    """Struct of price, currency and volume; all null where a cell has no number."""

    def parts(value: Column) -> Column:
        there = value.isNotNull()
        return F.struct(value.alias("price"), F.when(there, currency_in(c)).alias("currency"), F.when(there, volume_in_price(c)).alias("volume"))

    return named(first_number(c), parts)


def volume(c: Column) -> Column:
    """Litres: a number with a unit (none: litres), else the text as a number."""
    pattern = rf"(?iu){NUMBER}\s*([а-яa-z]+)?"

    def told(t: Column) -> Column:
        number = F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        unit = F.coalesce(F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")), F.lit("л"))
        return F.coalesce(litres(number, unit), safe_float(t))

    return named(clean(c), told)


def packaging(c: Column) -> Column:
    t = F.lower(clean(c))
    return looked_up(t, PACKAGING, t)


def is_city(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^(" + "|".join(CITIES) + r")$|^г[. ]")


def brewery(c: Column, boundary: bool = False, passes: int = 5) -> Column:
    """A brewery name without its city.

    City words go wherever they stand, inside other words too, as existing data
    was made that way; with ``boundary`` only where a word begins.
    """
    edge = r"(?<![\p{L}])" if boundary else ""
    pattern = "(?iu)" + "|".join(p.replace("E", edge, 1) for p in CITY_PATTERNS)

    def free(whole: Column) -> Column:
        t = whole
        # one alternation per pass keeps the plan small; the order inside is that of the list
        for _ in range(passes):
            t = F.regexp_replace(t, pattern, "")
        return F.when(F.lower(whole).rlike(CITY_SIGNS), t).otherwise(whole)

    def told(whole: Column) -> Column:
        t = F.regexp_replace(F.trim(F.regexp_replace(F.trim(free(whole)), ",+$", "")), r"\s+", " ")
        kept = F.trim(F.regexp_replace(F.regexp_replace(whole, r"(?iu)\s*г\.\s*[А-ЯЁа-яё]+\s*$", ""), r"(?iu)\s*г\s+[А-ЯЁа-яё]+\s*$", ""))
        return named(t, lambda t: F.when(F.length(t) < 2, kept).otherwise(t))

    return named(named(clean(c), told), lambda t: F.when(is_city(t), F.lit("")).otherwise(t))


def split_brewery(name: Column, brewery_: Column) -> Column:
    """Struct (brewery, beer_name): "Brewery - Name" parted at the first separator that fits, if there is no brewery yet."""

    def parts(t: Column) -> Column:
        found = F.lit(None).cast("array<string>")
        for sep in reversed(SEPARATORS):
            at = F.instr(t, sep)
            left, right = F.trim(F.substring(t, F.lit(1), at - 1)), F.trim(F.substr(t, at + len(sep)))
            found = F.when((at > 0) & (left != "") & (right != ""), F.array(left, right)).otherwise(found)
        return found

    def told(p: Column) -> Column:
        fits = ~present(brewery_) & (F.length(p[0]).between(2, 80)) & (F.length(p[1]) >= 2) & ~p[0].rlike(r"\d")
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(p[0].alias("brewery"), p[1].alias("beer_name"))).otherwise(F.struct(brewery_.alias("brewery"), name.alias("beer_name")))

    return named(named(clean(name), parts), told)


def normalized(items: DataFrame) -> DataFrame:
    """Raw text fields (beer_name, brewery, abv, price, currency?, volume, format_type) in their normal form."""
    have = set(items.columns)
    out = settled(items, {"__b": split_brewery(F.col("beer_name"), F.col("brewery"))})
    out = settled(out.withColumn("beer_name", F.col("__b.beer_name")), {"__raw": F.col("__b.brewery"), "__p": price(null_if_empty(F.col("price"))), "__free": brewery(F.col("__b.brewery"))})
    city_free = F.nullif(F.col("__free"), F.lit(""))
    fields = {
        "brewery": F.coalesce(city_free, clean(F.col("__raw"))),
        "abv": abv(null_if_empty(F.col("abv"))),
        "price": F.col("__p.price").try_cast("decimal(10,2)"),
        "currency": F.coalesce(F.col("__p.currency"), currency(F.col("currency")) if "currency" in have else F.lit("RUB")),
        "volume": F.coalesce(volume(null_if_empty(F.col("volume"))), F.col("__p.volume")),
        "format_type": packaging(F.col("format_type")),
    }
    return settled(out, fields).drop("__b", "__raw", "__p", "__free")
