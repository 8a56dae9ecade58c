"""Packaging cells, combined cells and price headings of price lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean

LABEL = r"(?iu)(банка|бутылк|кег|can|keg|шт/кор|не\s*дробим|тара)"  # fixed value
DEFAULT_CAN_LITRES = 0.45
# Signs of a row that names no beer: fixed values.
CITY_WORDS = ["г.", "г ", "город", "city", "владимир", "москва", "санкт-петербург", "spb", "мск", "петербург", "питер", "санкт петербург", "санктпетербург"]
PLACE_WORDS = ["г.", "г ", "город", "city", "ул.", "улица", "street", "владимир", "москва", "санкт-петербург", "spb", "мск", "проспект", "пр.", "переулок", "пер.", "площадь", "пл."]
SERVICE_WORDS = ["прайс", "price list", "каталог", "менеджер", "контакт", "телефон", "email", "адрес"]
CODE = r"(?iu)(эль[-\s]\d+|эль\s*\d+|ale[-\s]\d+)"
COMMON_WORDS = ["IPA", "ALE", "LAGER", "STOUT", "PORTER", "PILSNER", "WHEAT", "SOUR", "ML", "Л"]


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def is_label(c: Column) -> Column:
    """A cell that names a packaging, not a beer."""
    t = clean(c)
    return t.rlike(LABEL) & ((F.length(t) < 160) | t.rlike(r"\d"))


def litres(c: Column) -> Column:
    """Litres in a packaging text: a decimal under ten, else whole litres, else a number under one that counts no pieces."""
    t = clean(c)
    decimal = number(F.regexp_extract(t, r"(\d+[.,]\d+)", 1))
    whole = F.regexp_extract(t, r"(?iu)(\d+)\s*л(?!\p{L})", 1).try_cast("double")
    around = F.regexp_extract_all(t, F.lit(r"(?iu).{0,6}?\d+[.,]?\d*.{0,12}"), F.lit(0))
    small = F.filter(F.transform(F.filter(around, lambda x: ~F.lower(x).rlike("шт|кор")), lambda x: number(F.regexp_extract(x, r"(\d+[.,]?\d*)", 1))), lambda v: v < 1)
    return F.when(t.rlike(r"\d"), F.coalesce(F.when(decimal < 10, decimal), whole, F.get(small, F.lit(0))))


def kind(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("ж/б") | t.contains("банка") | t.contains("can"), "банка").when(t.contains("кег") | t.contains("keg"), "кега").when(t.contains("бут") | t.contains("bottle"), "бутылка")


def packed(c: Column) -> Column:
    """Struct (format_type, volume) of a packaging cell such as 'ж/б 0.45 / 20' or 'кег 20 л'; a bare number is no packaging."""
    t = clean(c)
    # what stands before the last slash that isn't inside a word
    front = F.trim(F.regexp_replace(t, r"\s*/[^/]*$", ""))
    slashed = t.rlike(r"[^/]/[^/]*$") & ~F.lower(t).rlike(r"^ж/б[^/]*$")
    part = F.when(slashed, front).otherwise(t)
    unit = F.regexp_extract(t, r"(?iu)(\d+[.,]?\d*)\s*(л|мл|ml)(?!\p{L})", 2)
    amount = number(F.regexp_extract(t, r"(?iu)(\d+[.,]?\d*)\s*(л|мл|ml)(?!\p{L})", 1))
    named = F.when(F.lower(unit) == "л", amount).when(unit != "", amount / 1000)
    rest = F.trim(F.regexp_replace(part, r"(?iu)\s*\d+[.,]?\d*\s*(л|ml|мл|l)(?!\p{L})", ""))
    bare = r"^\d+[.,]?\d*$"
    format_type = F.when(t.rlike(bare), None).otherwise(F.coalesce(kind(part), F.when((rest != "") & ~rest.rlike(bare), rest)))
    return F.struct(format_type.alias("format_type"), F.when(slashed, litres(part)).otherwise(F.coalesce(named, litres(t))).alias("volume"))


def strength(c: Column) -> Column:
    """Struct (abv, ibu) of 'ABV', 'ABV / IBU' or 'ABV / OG / IBU'."""
    parts = F.transform(F.split(clean(c), "/"), lambda x: F.trim(x))
    first = F.replace(F.replace(parts[0], F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    n = F.size(parts)
    return F.struct(F.nullif(F.trim(first), F.lit("")).alias("abv"), F.when(n >= 3, F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(1))).alias("ibu"))


def name_and_text(c: Column) -> Column:
    """Struct (name, text): the first line, and the others joined."""
    lines = F.filter(F.transform(F.split(clean(c), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("name"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " ").alias("text"))


def brewery_in_name(c: Column) -> Column:
    """A brewery in quotes, or capitals before brackets that speak of brewing; else null."""
    t = clean(c)
    quoted = F.trim(F.regexp_extract(t, r'["“”«»]([A-ZА-ЯЁ][A-ZА-ЯЁa-zа-яё\s]{1,30}?)["“”«»]', 1))
    ahead = F.trim(F.regexp_extract(t, r"^([A-ZА-ЯЁ][A-ZА-ЯЁ\s]+?)\s*\(", 1))
    hint = F.lower(F.regexp_extract(t, r"\(([^)]{0,60})\)", 1))
    return F.when((F.length(quoted) >= 2) & ~F.upper(quoted).isin(COMMON_WORDS), quoted).when((ahead != "") & (F.length(ahead) <= 50) & hint.rlike("brew|пивовар"), ahead)


def first_price(c: Column) -> Column:
    """The first part of '330 / 6600'."""
    return F.trim(F.split(clean(c), "/")[0])


def is_price_heading(c: Column) -> Column:
    return F.lower(clean(c)).rlike("цена|price|стоимость|cost")


def heading_format(c: Column) -> Column:
    """Struct (format_type, volume) that a price heading speaks of; a can has 0.45 l unless it says otherwise."""
    t = F.lower(clean(c))
    can, keg = t.rlike("коробка|банка|can"), t.rlike("кег|keg")
    bracket = number(F.regexp_extract(t, r"\((\d+[.,]?\d*)\)", 1))
    named = number(F.regexp_extract(t, r"(\d+[.,]?\d*)\s*л", 1))
    keg_litres = F.regexp_extract(t, r"(\d+)\s*л", 1).try_cast("double")
    return F.struct(F.when(can, "банка").when(keg, "кег").alias("format_type"), F.when(can, F.coalesce(F.when(bracket < 1, bracket), named, F.lit(DEFAULT_CAN_LITRES))).when(keg, keg_litres).alias("volume"))


def is_code(name: Column, description: Column) -> Column:
    """A register code for a name, without a real name in the description."""
    real = clean(description).contains(":") & clean(description).rlike("[a-zA-Z]{3,}")
    return clean(name).rlike(CODE) & ~real


def in_text(format_type: Column, volume: Column, name: Column, description: Column) -> Column:
    """Struct (format_type, volume): what is missing, from a product's name and text; a can has its usual volume."""
    t = F.lower(F.concat(clean(name), F.lit(" "), clean(description)))
    spoken = F.when(t.contains("банка") | t.contains("can"), "банка").when(t.contains("бутылка") | t.contains("bottle"), "бутылка")
    bare = clean(format_type) == ""
    form = F.when(bare, spoken).otherwise(clean(format_type))
    named = number(F.regexp_extract(t, r"(\d+[.,]?\d*)\s*л", 1))
    litres_ = F.coalesce(F.when(bare & (named > 0), named), volume.cast("double"), F.when(F.lower(form).rlike("банка|can"), F.lit(DEFAULT_CAN_LITRES)))
    return F.struct(form.alias("format_type"), litres_.alias("volume"))


def bucket(format_type: Column) -> Column:
    """The tab of a brewery's list that a packaging belongs to: cans and bottles, kegs, or the rest."""
    f = F.lower(clean(format_type))
    return F.when(f.rlike("банка|банки|бутылка|bottle|can|коробка"), "Банки").when(f.rlike("кег|keg|разлив") | (f.rlike(r"\d+\s*л") & ~f.contains("шт")), "Кеги").otherwise("Прочее")
