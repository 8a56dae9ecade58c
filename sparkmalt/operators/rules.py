"""Column rules beside the scores: which column is which field, by headings in order of trust and by what stands below.

A sheet is one row with its columns as an array of profiles (heading, first
values and figures of these); its mapping is a map from field to column. Rules
give a column the fields that it wishes to be, in order, and a fold over the
columns deals each its first free wish; all of it is Column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean, named, settled
from sparkmalt.operators.headers import SHEET, with_rows
from sparkmalt.sources.registry import FIELDS

PROFILE_ROWS, PRICE_ROWS, GUESSED_COLUMNS = 20, 120, 10
CELLS = 1 << 17  # about so many cells are one task's work at most
# Words and patterns of the rules: fixed values.
CODE_HEADINGS = ["егаис", "егаис код", "код егаис", "код товара", "артикул"]
BREWERY_HEADINGS = ["пивоварня", "brewery", "производитель", "manufacturer", "бренд", "brand"]
CODE = r"(?iu)эль[-\s]?\d+|крепкий\s+эль[-\s]?\d+|берлинер\s+вайссе\s+\d+|гозэ\s+\d+"
REAL_NAME = [":", " - ", "|", " & ", " of ", " with ", "Master", "Chocolate", "Pastries", "Dubai", "Eternal", "Nightmare", "Magic", "Messiah", "Croissant", "Adept", "Fracture", "Lemonade", "Shake", "Bus"]
BEER_WORDS = ["ipa", "lager", "ale", "stout", "porter", "pilsner", "wheat", "sour", "пиво", "beer", "пивоварня", "brewery", "gose", "neipa", "hazy", "томатный", "клубничный", "базилик", "чеснок", "перцы", "безалкогольный", "non-alcoholic", "new england", "grapefruit", "alisperi", "back to balance", "berry forward", "bitter joy"]
BREWERY_WORDS = ["brewery", "пивоварня", "brewing", "company", "компания"]
STYLE_WORDS = ["ipa", "lager", "ale", "stout", "porter", "pilsner", "wheat", "sour", "gose", "neipa", "hazy", "imperial", "double", "triple", "стиль", "style", "томатный", "tomato", "georgian", "new england", "grapefruit", "strawberry", "sour ale"]
NOT_STOCK_STYLES = ["ipa", "lager", "ale", "stout", "porter", "pilsner", "wheat", "sour", "gose", "neipa", "hazy", "imperial", "double", "triple", "weisse", "weizen", "hopfen", "belgian", "witbier", "saison", "томатный", "tomato", "georgian", "new england", "grapefruit", "strawberry", "sour ale", "barrel", "aged", "wild"]
SHORT_STYLES = ["ipa", "lager", "ale", "stout", "gose", "sour", "style", "стиль", "tomato", "georgian", "new england", "grapefruit", "strawberry"]
FORMAT_WORDS = ["банка", "can", "кега", "keg", "кег", "бутылка", "bottle", "ж/б", "бут", "л", "ml", "мл", "формат", "format", "упаковка", "packaging", "тара", "фасовка", "фасовки", "тип фасовки"]
STOCK_FORMATS = ["банка", "can", "кега", "keg", "кег", "бутылка", "bottle", "ж/б", "бут", "формат", "format", "упаковка", "packaging", "тара", "фасовка", "фасовки", "тип фасовки"]
STOCK_WORDS = ["много", "мало", "достаточно", "нет", "есть", "в наличии", "many", "few", "enough", "available", "stock", "остаток", "наличие", "склад", "количество", "кол-во", "шт", "штук"]
PRICE_WORDS = ["цена", "price", "стоимость", "cost", "руб", "банку", "ящик", "коробка", "кег"]
TASTE_WORDS = ["вкус", "аромат", "вкусовые", "характеристики", "описание", "taste", "aroma", "flavor", "description", "характер", "насыщенный", "сочный", "яркий", "кислый", "сладкий"]
FILL_ORDER = ["beer_name", "price", "style", "abv", "ibu", "brewery", "volume", "format_type", "description", "stock"]
DISTRIBUTOR_NAMES = ["дистрибьютор", "distributor", "каталог", "catalog", "прайс", "price", "поставщик", "supplier", "оптовый", "wholesale", "импортер", "importer", "дистриб", "distrib"]
BREWERY_NAMES = ["brewery", "пивоварня", "brewing", "пивоварение", "paradox", "alisperi", "back to balance", "two peaks", "otherlab", "incider"]
NO_BREWERY = ["ipa", "ale", "lager", "stout", "porter", "pilsner", "wheat", "sour", "ml", "л"]
QUOTED = r'["“”«»]([A-ZА-ЯЁ][A-ZА-ЯЁa-zа-яё\s]{1,30}?)["“”«»]'
CAPITALS = [r"^([A-ZА-ЯЁ][A-ZА-ЯЁ\s]+?)\s*\(", r"^([A-ZА-ЯЁ][A-ZА-ЯЁ\s]{2,50}?)(?:\s+[a-zа-яё]|\s*\(|\s*$)", r"^([A-ZА-ЯЁ][A-ZА-ЯЁ]{2,30})\s+"]

STYLE_ENDINGS = r"(?iu)\b(ipa|ale|lager|stout|porter|pilsner|altbier|sour|gose|weisse?|wheat)\s*$|\b(imperial\s+|double\s+ipa|pale\s+ale|amber\s+ale|blonde\s+ale|red\s+ale|brown\s+ale|black\s+ipa|white\s+ipa|new\s+england\s+ipa|berliner\s+weisse)|(?<!\p{L})(витбир|лагер|эль|стаут|портер)\s*$"
LONG_TEXT_WORDS = ["вкус", "аромат", "насыщенный", "сочный", "обусловлен", "использованием", "taste", "aroma", "flavor", "due to", "combination with"]


def pattern(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


def mentions(c: Column, words: list[str]) -> Column:
    """One of the words is in the text; a pattern, so that the expression stays small."""
    return c.rlike(pattern(words))


def number(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")).try_cast("double")


def mean_of(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def mean_length(values: Column) -> Column:
    """Mean length of texts, 0 for none."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.length(x)) / F.greatest(F.size(values), F.lit(1))


def profiles(cells: DataFrame, header_rows: DataFrame, rows: int = PROFILE_ROWS) -> DataFrame:
    """A row per sheet with ``columns``: its columns in order, each with heading and what its first rows hold.

    A sheet without a heading row has header_row -1 in ``header_rows``. Tasks hold
    their cells while they group them, and Spark deals by packed bytes, which say
    little about the number of cells; so the cells are counted, and more than
    ``CELLS`` are dealt by sheet to as many parts as that makes, or the session's.
    """
    if (parts := cells.count() // CELLS + 1) > 1:
        cells, header_rows = cells.repartition(parts, *SHEET), header_rows.repartition(parts, *SHEET)
    near = with_rows(cells, header_rows).where(F.col("row_idx").between(F.col("header_row"), F.col("header_row") + PRICE_ROWS))
    at, v = F.col("at"), F.col("v")
    row = F.col("row_idx") - F.col("header_row")
    # below the first rows no text is needed, only whether it has a digit
    near = near.select(*SHEET, "col_idx", row.alias("at"), F.when(row <= rows, F.trim("value")).alias("v"), ((row >= 1) & F.col("value").rlike(r"\d")).alias("digit"))
    one = near.groupBy(*SHEET, "col_idx").agg(
        F.coalesce(F.max(F.when(at == 0, F.lower(v))), F.lit("")).alias("header"),
        F.sort_array(F.collect_list(F.when(at.between(1, rows) & ~F.lower(v).isin("", "nan"), F.struct("at", "v")))).alias("cells"),
        F.count_if("digit").alias("priced"),
    )
    texts = lambda most: F.transform(F.filter("cells", lambda x: x["at"] <= most), lambda x: x["v"])
    one = settled(one, {"values": texts(10), "all_values": texts(rows)})
    one = settled(one, {"five": F.slice("values", 1, 5), "numbers": F.filter(F.transform("values", number), lambda x: x.isNotNull())})
    n, five = F.size("values"), F.col("five")
    one = settled(
        one,
        {
            "n": n,
            "share": F.when(n > 0, F.size("numbers") / n).otherwise(0.0),
            "mean": mean_of(F.col("numbers")),
            "top": F.array_max("numbers"),
            "length": mean_length(F.col("values")),
            "text": F.lower(F.array_join("values", " ")),
            "five_length": mean_length(five),
            "five_text": F.lower(F.array_join(five, " ")),
            "five_mean": mean_of(F.filter(F.transform(five, number), lambda x: x.isNotNull())),
            "codes": (F.size(five) > 0) & (F.size(F.filter(five, lambda x: x.rlike(CODE))) >= 0.6 * F.size(five)),
        },
    )
    one = settled(one, {"wants": F.when(n > 0, content_wishes()).otherwise(F.array().cast("array<string>")), "names": F.when(n > 0, name_rank()).otherwise(F.lit(0))})
    fields = ["col_idx", "header", "priced", "n", "share", "mean", "top", "length", "text", "five", "five_length", "five_text", "five_mean", "codes", "wants", "names", "values", "all_values"]
    return one.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("columns"))


def kept(options: list[tuple[str, Column]]) -> Column:
    """The fields whose condition holds, in order, each once."""
    return F.array_distinct(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(f)) for f, c in options]), lambda x: x.isNotNull()))


def content_wishes() -> Column:
    """The fields that a column's values look like, in order."""
    c = F.col
    numeric, mean, length, text = c("share") > 0.7, c("mean"), c("length"), c("text")
    has = lambda words: mentions(text, words)
    price, volume, abv = mean.between(50, 10_000) & (c("top") < 50_000), mean.between(0.1, 50), mean.between(0, 15)
    long, beer, codes = length > 15, has(BEER_WORDS), c("codes")
    stock_text = has(STOCK_WORDS) & ~has(PRICE_WORDS)
    packed = (c("share") < 0.7) | mean.between(0.1, 50) | (mean.between(50, 10_000) & has(["банка", "can", "бутылка", "bottle"]))
    counted = numeric & (length <= 10) & ~mean.between(50, 10_000) & ~mean.between(0.1, 50) & mean.between(0, 10_000)
    return kept(
        [
            ("brewery", ~long & length.between(5, 30) & has(BREWERY_WORDS)),
            ("beer_name", long & (beer | ((length <= 150) & ~codes))),
            ("style", (length >= 3) & (length < 50) & has(STYLE_WORDS)),
            ("abv", numeric & ~price & ~volume & abv),
            ("ibu", numeric & ~price & ~volume & ~abv & mean.between(0, 120)),
            ("price", numeric & price),
            ("volume", numeric & ~price & volume),
            ("format_type", (length <= 15) & has(FORMAT_WORDS) & packed),
            ("stock", ~has(NOT_STOCK_STYLES) & ((stock_text & (length <= 50)) | counted)),
            ("description", (long & ~beer & (length > 150)) | (~stock_text & (((length > 50) & has(TASTE_WORDS)) | (length > 150)))),
        ]
    )


def name_rank() -> Column:
    """How much a column looks like one of real names: 20, 15, 10, or 0 for not at all."""
    five, header = F.col("five"), F.col("header")
    colon = F.exists(five, lambda x: x.contains(":"))
    named = colon | F.exists(five, lambda x: x.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+") | mentions(x, REAL_NAME))
    fits = named & ~F.col("codes") & ~mentions(header, ["описан", "description", "комментар", "примечан", "стиль", "style"])
    return F.when(~fits, 0).when(header.contains("название"), 20).when(colon, 15).otherwise(10)


def heading_wishes(h: Column) -> Column:
    """The fields that a heading speaks of, the most trusted first."""
    any_of = lambda *words: mentions(h, list(words))
    name = F.when(h.isin("название", "название товара"), "beer_name")
    name = name.when(h.contains("наименование") & ~h.contains("пивоварни") & ~h.contains("егаис"), "beer_name").when(any_of(*BREWERY_HEADINGS), "brewery")
    name = name.when(any_of("название", "beer", "name") & ~any_of("егаис", "крепость", "эль", "код"), "beer_name")
    wishes = kept(
        [
            ("brewery", h.contains("наименование") & h.contains("пивоварни")),
            ("beer_name", name == "beer_name"),
            ("brewery", name == "brewery"),
            ("format_type", h.contains("тип фасовки") | (h.contains("фасовки") & h.contains("кол-во"))),
            ("volume", h.contains("литраж") | (any_of("объём", "volume", "литр", "литров") & ~h.contains("стиль"))),
            ("price", any_of("цена", "price", "стоимость", "cost")),
            ("style", any_of("стиль", "style") & ~h.contains("литраж")),
            ("description", any_of("описание", "description")),
            ("abv", any_of("abv", "крепость")),
            ("ibu", any_of("ibu", "горечь")),
        ]
    )
    return F.when(h.isin(["", *CODE_HEADINGS]), F.array().cast("array<string>")).otherwise(wishes)


def wider_wish(h: Column) -> Column:
    """The last resort for a heading: parts of words."""
    name = mentions(h, ["назв", "наимен", "товар"]) & ~mentions(h, ["пивоварни", "егаис"])
    return kept([("beer_name", name), ("brewery", mentions(h, ["произв", "бренд", "марка"])), ("price", mentions(h, ["цена", "стоим", "руб"])), ("format_type", mentions(h, ["фасов", "формат", "упаковка"]))])


def nothing() -> Column:
    return F.create_map().cast("map<string,int>")


def has(m: Column, field: object) -> Column:
    return F.array_contains(F.map_keys(m), field)


def put(m: Column, field: object, column: Column) -> Column:
    """The mapping with ``field`` at ``column``, unchanged for a null column."""
    key = F.lit(field) if isinstance(field, str) else field
    return F.when(column.isNotNull(), F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, column.cast("int")))).otherwise(m)


def without(m: Column, field: str) -> Column:
    return F.map_filter(m, lambda k, v: k != field)


def over(low: Column, high: Column) -> Column:
    """Both mappings, ``high`` wins."""
    return F.map_concat(F.map_filter(low, lambda k, v: ~has(high, k)), high)


def dealt(columns: Column, m: Column, wishes: object, joint: tuple[str, ...] = ()) -> Column:
    """Each column in turn gets its first free wish; a field of ``joint`` may be given beside another one."""

    def give(m: Column, c: Column, free: Column) -> Column:
        first = put(m, F.get(free, F.lit(0)), F.when(F.size(free) > 0, c["col_idx"]))
        if not joint:
            return first
        both = (F.get(free, F.lit(0)) == joint[0]) & F.array_contains(free, joint[1])
        return F.when(both, put(put(m, joint[0], c["col_idx"]), joint[1], c["col_idx"])).otherwise(first)

    def one(m: Column, c: Column) -> Column:
        return named(F.filter(wishes(c), lambda f: ~has(m, f)), lambda free: give(m, c, free))

    return F.aggregate(columns, m, one)


def first_column(columns: Column, fits: object, best: object = None) -> Column:
    """Number of the first column that fits, or of the best one by ``best`` (the first among equals); null if none does."""
    rank = best or (lambda c: F.lit(0))
    return F.array_min(F.transform(F.filter(columns, fits), lambda c: F.struct((-rank(c)).alias("r"), c["col_idx"].alias("i"))))["i"]


def column_at(columns: Column, index: Column) -> Column:
    return F.get(F.filter(columns, lambda c: c["col_idx"] == index), F.lit(0))


def at(m: Column, field: str) -> Column:
    return F.try_element_at(m, F.lit(field))


def used(m: Column, c: Column) -> Column:
    return F.array_contains(F.map_values(m), c["col_idx"])


def by_pattern(columns: Column, m: Column) -> Column:
    """Fields that are still free, in order, at the first column whose heading has one of their words; a style column is no volume."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(pattern(words)).alias("words"), F.lit(pattern(["стиль", "style"]) if f == "volume" else "^$").alias("barred")) for f, words in FIELDS.items()])

    def one(m: Column, f: Column) -> Column:
        found = first_column(columns, lambda c: (c["header"] != "") & F.regexp_like(c["header"], f["words"]) & ~F.regexp_like(c["header"], f["barred"]))
        return F.when(has(m, f["field"]), m).otherwise(put(m, f["field"], found))

    return F.aggregate(fields, m, one)


def with_header_map(sheets: DataFrame, out: str = "by_header") -> DataFrame:
    """``out``: exact heading first, headings in order, columns of real names, contents, then patterns and parts of words."""
    cols, m = F.col("columns"), F.col("__m")
    rows = settled(sheets, {"__m": put(nothing(), "beer_name", first_column(cols, lambda c: c["header"] == "название"))})
    rows = settled(rows, {"__m": dealt(cols, m, lambda c: heading_wishes(c["header"]), ("abv", "ibu"))})
    coded = F.coalesce(column_at(cols, at(m, "beer_name"))["codes"], F.lit(False))
    rows = settled(rows, {"__m": F.when(coded, without(m, "beer_name")).otherwise(m)})
    rows = settled(rows, {"__m": put(m, "beer_name", first_column(cols, lambda c: c["names"] > 0, lambda c: c["names"]))})
    rows = settled(rows, {"__m": dealt(cols, m, lambda c: c["wants"])})
    rows = settled(rows, {"__m": by_pattern(cols, m)})
    rows = settled(rows, {"__m": dealt(cols, m, lambda c: wider_wish(c["header"]))})
    return rows.withColumnRenamed("__m", out)


def guessed(columns: Column) -> Column:
    """A mapping by position and kind: text columns are brewery or name, then numbers are price or strength."""
    near = F.filter(columns, lambda c: c["col_idx"] < GUESSED_COLUMNS)
    wordy = lambda x: (F.length(x) > 2) & ~x.rlike(r"^[\d.\- ]+$")
    texts = F.filter(near, lambda c: F.size(F.filter(c["values"], wordy)) > 0.5 * F.size(c["values"]))

    def name(m: Column, c: Column) -> Column:
        brew = F.exists(F.slice(F.filter(c["values"], wordy), 1, 5), lambda x: F.lower(x).rlike("brewery|пивоварня"))
        return F.when(brew & ~has(m, "brewery"), put(m, "brewery", c["col_idx"])).when(~has(m, "beer_name"), put(m, "beer_name", c["col_idx"])).otherwise(m)

    def amount(m: Column, c: Column) -> Column:
        positive = F.filter(F.transform(c["values"], number), lambda x: x > 0)
        most = F.when(F.size(positive) > 0.5 * F.size(c["values"]), F.array_max(positive))
        return F.when((most < 10_000) & ~has(m, "price"), put(m, "price", c["col_idx"])).when((most <= 100) & ~has(m, "abv"), put(m, "abv", c["col_idx"])).otherwise(m)

    return F.aggregate(near, F.aggregate(texts, nothing(), name), amount)


def guessed_by_content(columns: Column) -> Column:
    """A mapping from the first five rows: brewery words, then numbers, then long texts."""

    def one(m: Column, c: Column) -> Column:
        v, put_ = c["five"], lambda f: put(m, f, c["col_idx"])
        brew = F.exists(v, lambda x: F.lower(x).rlike("brewery|пивоварня"))
        numeric = F.size(F.filter(v, lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("")).rlike(r"^\d+$"))) > 0.6 * F.size(v)
        first, length = number(F.get(v, F.lit(0))), mean_length(F.slice(v, 1, 3))
        out = F.when(brew & ~has(m, "brewery"), put_("brewery"))
        out = out.when(numeric & ~has(m, "price"), F.when((first > 10) & (first < 10_000), put_("price")).otherwise(m))
        out = out.when((length > 10) & ~has(m, "beer_name") & ~brew, put_("beer_name"))
        return F.when(F.size(v) == 0, m).otherwise(out.when((length > 5) & ~has(m, "brewery") & ~has(m, "beer_name"), put_("beer_name")).otherwise(m))

    return F.aggregate(F.filter(columns, lambda c: c["col_idx"] < GUESSED_COLUMNS), nothing(), one)


def stock_settled(m: Column, columns: Column) -> Column:
    """A stock column that holds packaging, the prices, the volumes, styles or descriptions is no stock column."""
    far = lambda field, c, least: F.coalesce(F.abs(c["stock"]["five_mean"] - c[field]) / F.greatest(c[field], F.lit(least)) >= 0.01, F.lit(True))
    mean_at = lambda field: column_at(columns, at(m, field))["five_mean"].alias(field)

    def settle(c: Column) -> Column:
        s, bare = c["stock"], c["bare"]
        text, length = s["five_text"], s["five_length"]
        moved = lambda field: F.when(has(bare, field), bare).otherwise(put(bare, field, s["col_idx"]))
        priced = ~has(bare, "price") & s["five_mean"].between(50, 10_000) & mentions(s["header"], ["цена", "price", "стоимость", "cost", "руб"]) & ~mentions(s["header"], ["остаток", "stock", "наличие", "availability", "склад", "количество"])
        out = F.when(s.isNull() | (F.size(s["five"]) <= 0), m).when(mentions(text, STOCK_FORMATS) & (length <= 15), moved("format_type"))
        out = out.when(~far("price", c, 1.0) | ~far("volume", c, 0.01), bare).when(F.coalesce(priced, F.lit(False)), moved("price"))
        return out.when(mentions(text, NOT_STOCK_STYLES) & length.between(3, 50), moved("style")).when((length > 50) & mentions(text, TASTE_WORDS), moved("description")).otherwise(m)

    return named(F.struct(column_at(columns, at(m, "stock")).alias("stock"), mean_at("price"), mean_at("volume"), without(m, "stock").alias("bare")), settle)


def filled(m: Column, columns: Column) -> Column:
    """Missing fields from unused columns whose contents fit, the important fields first; then a long text as name, a short one as style."""

    def fill(m: Column, field: Column) -> Column:
        better = lambda c: (((field == "beer_name") & (c["five_length"] > 20)) | ((field == "price") & (c["share"] > 0.7))).cast("int")
        found = first_column(columns, lambda c: ~used(m, c) & F.array_contains(c["wants"], field), better)
        return F.when(has(m, field), m).otherwise(put(m, field, found))

    def last(m: Column) -> Column:
        name = F.coalesce(
            first_column(columns, lambda c: (c["col_idx"] == 0) & ~used(m, c) & ~c["header"].contains("егаис") & (c["five_length"] > 10) & ~c["codes"]),
            first_column(columns, lambda c: ~used(m, c) & (c["five_length"] > 15)),
        )
        return F.when(has(m, "beer_name"), m).otherwise(put(m, "beer_name", name))

    def style(m: Column) -> Column:
        fits = lambda c: ~used(m, c) & c["five_length"].between(3, 50) & mentions(c["five_text"], SHORT_STYLES)
        return F.when(has(m, "style"), m).otherwise(put(m, "style", first_column(columns, fits, lambda c: (c["col_idx"] == 1).cast("int"))))

    return named(named(F.aggregate(F.array(*map(F.lit, FILL_ORDER)), m, fill), last), style)


def format_repaired(m: Column, columns: Column) -> Column:
    """A packaging field at a stock heading moves to the packaging heading, and stock to the stock heading."""
    at_ = first_column(columns, lambda c: mentions(c["header"], ["тип тары", "тара", "формат", "фасов"]))
    stock = first_column(columns, lambda c: mentions(c["header"], ["налич", "остат", "stock"]))
    wrong = mentions(column_at(columns, at(m, "format_type"))["header"], ["налич", "остат", "stock"]) & at_.isNotNull()
    return F.when(F.coalesce(wrong, F.lit(False)), put(put(m, "format_type", at_), "stock", stock)).otherwise(m)


def breweries_named(names: Column) -> Column:
    """Distinct breweries that names begin with or quote: in quotes, capitals before a bracket, several or one word in capitals."""

    def one(x: Column) -> Column:
        quoted = F.trim(F.regexp_extract(x, QUOTED, 1))
        ahead, several, single = (F.trim(F.regexp_extract(x, p, 1)) for p in CAPITALS)
        out = F.when((F.length(quoted) >= 2) & ~F.lower(quoted).isin(NO_BREWERY), quoted)
        out = out.when(F.length(ahead).between(2, 50), ahead).when(F.length(several).between(2, 50) & (F.size(F.split(several, r"\s+")) <= 5), several)
        return out.when((single != "") & ~single.isin([w.upper() for w in NO_BREWERY[:6]]), single)

    return F.array_distinct(F.filter(F.transform(F.filter(names, lambda x: F.length(x) >= 3), one), lambda x: x.isNotNull()))


def name_hint(file: Column, sheet: Column) -> Column:
    """distributor or brewery by words in the names of file and sheet, else null."""
    t = F.lower(F.concat(F.regexp_replace(F.regexp_extract(clean(file), r"([^/\\]*)$", 1), r"\.[^.]*$", ""), F.lit(" "), clean(sheet)))
    return F.when(mentions(t, BREWERY_NAMES), "brewery").when(mentions(t, DISTRIBUTOR_NAMES), "distributor")


def with_supplier(sheets: DataFrame) -> DataFrame:
    """``sheets`` with ``supplier``: kind (distributor, brewery, unknown), the brewery's name if there is one, and whether a heading names breweries.

    Several breweries in the names decide, then the values of a brewery column,
    then one brewery in the names, last the names of file and sheet.
    """
    cols = F.col("columns")
    named = F.exists(cols, lambda c: (c["col_idx"] < 5) & mentions(c["header"], ["пивоварня", "brewery", "производитель", "manufacturer"]))
    long = F.get(F.filter(cols, lambda c: (c["col_idx"] < 3) & (c["five_length"] > 15)), F.lit(0))["values"]
    own = F.get(F.filter(cols, lambda c: (F.size(c["all_values"]) > 0) & ((c["col_idx"] == 0) | mentions(c["header"], BREWERY_HEADINGS))), F.lit(0))["all_values"]
    distinct = F.array_distinct(F.filter(own, lambda x: ~F.lower(x).isin("-", "—", "nan", "none", "", "null")))
    rows = settled(sheets, {"__found": F.coalesce(breweries_named(long), F.array().cast("array<string>")), "__first": F.array_distinct(F.transform(F.filter(long, lambda x: F.length(x) > 3), lambda x: F.upper(F.split(x, r"\s+")[0]))), "__distinct": distinct, "__named": named})
    found, n = F.col("__found"), F.size("__found")
    single = F.when(F.col("__named"), F.when(F.size("__distinct") == 1, F.col("__distinct")[0])).when(n == 1, found[0]).when((n == 0) & (F.size("__first") == 1), F.col("__first")[0])
    varied = F.when(F.size("__distinct") > 1, "distributor").when(F.size("__distinct") == 1, "brewery").otherwise("unknown")
    hint = name_hint(F.col("file_id"), F.col("sheet"))
    kind = F.when(n > 1, "distributor").when(F.col("__named"), varied).when(single.isNotNull(), "brewery").otherwise(F.coalesce(hint, F.lit("unknown")))
    return settled(rows, {"supplier": F.struct(kind.alias("kind"), single.alias("name"), F.col("__named").alias("has_column"), (n > 0).alias("in_names"))}).drop("__found", "__first", "__distinct", "__named")


def profile_map(supplier: Column, columns: Column) -> Column:
    """What the kind of supplier says: a distributor's brewery column or long names, a brewery's first long text and the style beside it."""
    brewery = F.when(supplier["has_column"], first_column(columns, lambda c: mentions(c["header"], ["пивоварня", "brewery", "производитель"])))
    long = first_column(columns, lambda c: c["five_length"] > 20)
    many = F.when(brewery.isNotNull(), put(nothing(), "brewery", brewery)).when(supplier["in_names"], put(nothing(), "beer_name", long)).otherwise(nothing())
    near = F.filter(columns, lambda c: c["col_idx"] < 5)
    name = put(nothing(), "beer_name", first_column(near, lambda c: c["five_length"] > 15))
    style = named(name, lambda m: put(m, "style", first_column(near, lambda c: ~used(m, c) & c["five_length"].between(3, 50) & mentions(c["five_text"], SHORT_STYLES[:8]))))
    return F.when(supplier["kind"] == "distributor", many).when((supplier["kind"] == "brewery") & supplier["name"].isNotNull(), style).otherwise(nothing())


def proposed(sheets: DataFrame) -> DataFrame:
    """``sheets`` (of profiles) with ``supplier`` and ``proposed``: the fields that the supplier's profile and, above it, the headings give to columns."""
    cols = F.col("columns")
    rows = with_header_map(with_supplier(sheets))
    headed = F.exists(cols, lambda c: c["header"] != "")
    return settled(rows, {"proposed": over(profile_map(F.col("supplier"), cols), F.when(headed, F.col("by_header")).otherwise(nothing()))}).drop("by_header")


def completed(sheets: DataFrame, own: str | None = None) -> DataFrame:
    """``sheets`` of ``proposed`` with ``mapping`` instead: the choice ``own`` first, then what is proposed for other fields and columns.

    A sheet without any gets a guess by position, then by content. Then the stock
    column is checked, missing names and prices are filled from contents, and a
    packaging field at a stock heading is put right.
    """
    cols, m = F.col("columns"), F.col("mapping")
    mine = F.coalesce(F.col(own), nothing()) if own else nothing()
    # a column that is chosen for a field stands for nothing else
    below = F.map_filter("proposed", lambda f, c: ~F.array_contains(F.map_values(mine), c))
    rows = settled(sheets, {"mapping": over(below, mine)}).drop("proposed")
    rows = settled(rows, {"mapping": F.when(F.size(m) == 0, guessed(cols)).otherwise(m)})
    rows = settled(rows, {"mapping": F.when(F.size(m) == 0, guessed_by_content(cols)).otherwise(m)})
    rows = settled(rows, {"mapping": stock_settled(m, cols)})
    rows = settled(rows, {"mapping": F.when(has(m, "beer_name") & has(m, "price"), m).otherwise(filled(m, cols))})
    return settled(rows, {"mapping": format_repaired(m, cols)})


def mapped(sheets: DataFrame, own: str | None = None) -> DataFrame:
    """``sheets`` (of profiles, with an optional column ``own``: a mapping that wins) with ``supplier`` and ``mapping``."""
    return completed(proposed(sheets), own)


def style_only(values: Column) -> Column:
    """Texts that are styles and no names: short ones without colons, half of them with a style's ending."""
    n = F.size(values)
    short = F.size(F.filter(values, lambda x: F.length(x) <= 55))
    colons = F.size(F.filter(values, lambda x: x.contains(":")))
    styles = F.size(F.filter(values, lambda x: x.rlike(STYLE_ENDINGS)))
    return (n >= 2) & (short >= 0.5 * n) & (colons < 0.4 * n) & (styles >= 0.5 * n)


def names_told_from_texts(m: Column, columns: Column) -> Column:
    """A name column of long texts becomes the description, and an unused column of short texts the name; a column headed as the name stays."""
    c = column_at(columns, at(m, "beer_name"))
    headed = (c["header"] == "название") | (c["header"].contains("наименование") & ~c["header"].contains("пивоварни"))
    text = (c["length"] > 100) | ((c["length"] > 60) & mentions(c["five_text"], LONG_TEXT_WORDS))
    barred = lambda h: h.contains("описание") | h.contains("стиль") | h.isin("description", "style")
    other = first_column(columns, lambda o: (o["col_idx"] < 12) & ~used(m, o) & ~barred(o["header"]) & (F.size(o["values"]) >= 2) & o["length"].between(3, 100))
    moved = put(put(m, "description", at(m, "beer_name")), "beer_name", other)
    return F.when(F.coalesce(text & ~headed, F.lit(False)), moved).otherwise(m)


def generic(columns: Column) -> Column:
    """The last resort: the first column of prices, of texts, and of long texts."""

    def one(m: Column, c: Column) -> Column:
        numbers = F.filter(F.transform(c["all_values"], number), lambda x: (x > 0) & (x < 1e7))
        n = F.size(c["all_values"])
        numeric = F.size(numbers) >= 0.4 * n
        price = numeric & F.array_max(numbers).between(1, 100_000) & ((mean_of(numbers) > 30) | (F.array_max(numbers) > 100))
        field = F.when(F.coalesce(price, F.lit(False)), "price").when(~numeric & (c["length"] >= 120), "description").when(~numeric & (c["length"] >= 5), "beer_name")
        return F.when((n >= 2) & field.isNotNull() & ~has(m, field), put(m, field, c["col_idx"])).otherwise(m)

    return F.aggregate(columns, nothing(), one)
