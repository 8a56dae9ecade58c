"""Item queries: filters, search, sorts and pages, counts and groups, coverage, validation, deduplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmalt.functions import display, style
from sparkmalt.functions.text import clean, contains_ci, matches, present, truthy
from sparkmalt.operators import dedup, quality
from sparkmalt.plans import bound
from sparkmalt.plans.bound import half_up, half_up_sql, money
from sparkmalt.sources.registry import keyword_list

UNNAMED = "Не указано"
COVERED = ["brewery", "beer_name", "style", "abv", "price", "volume", "format_type", "stock"]


@dataclass(frozen=True)
class ItemFilter:
    """What an item query asks for; None asks for nothing. Texts are substrings without regard to case, ranges include their ends."""

    file_id: int | None = None
    sheet: str | None = None
    brewery: str | None = None
    beer_name: str | None = None
    style: str | None = None
    price: tuple[float | None, float | None] = (None, None)
    volume: tuple[float | None, float | None] = (None, None)
    abv: tuple[float | None, float | None] = (None, None)

    def __call__(self, items: DataFrame) -> DataFrame:
        out = items
        for field in ("file_id", "sheet"):
            if (value := getattr(self, field)) is not None:
                out = out.where(F.col(field) == value)
        for field in ("brewery", "beer_name", "style"):
            if (value := getattr(self, field)) is not None:
                out = out.where(contains_ci(F.col(field), value))
        for field in ("price", "volume", "abv"):
            low, high = getattr(self, field)
            out = out if low is None else out.where(F.col(field) >= low)
            out = out if high is None else out.where(F.col(field) <= high)
        return out


def listed(items: DataFrame, limit: int = 1000) -> DataFrame:
    """The first items in the usual order."""
    return items.orderBy("file_id", "brewery", "beer_name", "id").limit(limit)


def page(items: DataFrame, number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 1) in the usual order."""
    return items.orderBy("file_id", "brewery", "beer_name", "id").offset((number - 1) * size).limit(size)


def table_order(field: str, descending: bool = False) -> list[Column]:
    """Numbers as numbers, then texts without regard to case; what is missing comes last both ways."""
    number, text = F.col(field).cast("string").try_cast("double"), F.lower(F.nullif(clean(F.col(field)), F.lit("")))
    return [number.desc_nulls_last(), text.desc_nulls_last()] if descending else [number.asc_nulls_last(), text.asc_nulls_last()]


def ranked(items: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their place from 1; only ``n`` rows per task meet."""
    top = items.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def admin_search(items: DataFrame, text: str, fields: list[str]) -> DataFrame:
    found = F.lit(False)
    for f in fields:
        found = found | contains_ci(F.col(f).cast("string"), text)
    return items.where(found)


def suggestions(items: DataFrame, text: str, n: int = 5) -> DataFrame:
    """The first distinct breweries, names and styles that contain a text."""
    values = items.select(F.explode(F.array("brewery", "beer_name", "style")).alias("suggestion"))
    return values.where(present(F.col("suggestion")) & contains_ci(F.col("suggestion"), text)).distinct().orderBy("suggestion").limit(n)


def with_gaps(items: DataFrame) -> DataFrame:
    """Items without volume, currency or price."""
    return items.where(~truthy(F.col("volume")) | ~present(F.col("currency")) | ~truthy(F.col("price")))


def value_counts(items: DataFrame, field: str, n: int, missing: str | None = UNNAMED, by_count: bool = True) -> DataFrame:
    """How often each value occurs; missing ones under a name of their own, or left out."""
    value = F.nullif(clean(F.col(field)), F.lit(""))
    rows = items.where(value.isNotNull()) if missing is None else items
    counts = rows.groupBy((value if missing is None else F.coalesce(value, F.lit(missing))).alias(field)).agg(F.count("*").alias("count"))
    return counts.orderBy(*([F.desc("count"), field] if by_count else [field])).limit(n)


def price_summary(items: DataFrame) -> DataFrame:
    """One row: items, average of the prices above 0, and how many have price, volume, style."""
    priced = F.when(F.col("price_cents") > 0, F.col("price_cents"))
    return items.agg(
        F.count("*").alias("items"),
        half_up(F.sum(priced) / F.count(priced) / 100, 2).alias("average_price"),
        F.count(priced).alias("with_price"),
        F.count_if(truthy(F.col("volume"))).alias("with_volume"),
        F.count_if(present(F.col("style"))).alias("with_style"),
    )


def brewery_stats(items: DataFrame) -> DataFrame:
    """Per brewery: items, items with a price, their sum and average."""
    priced = F.when(F.col("price_cents") > 0, F.col("price_cents"))
    per = items.groupBy(F.coalesce(F.nullif(clean(F.col("brewery")), F.lit("")), F.lit(UNNAMED)).alias("brewery")).agg(F.count("*").alias("count"), F.count(priced).alias("with_price"), F.coalesce(F.sum(priced), F.lit(0)).alias("cents"))
    average = F.when(F.col("with_price") > 0, half_up(F.col("cents") / F.col("with_price") / 100, 2)).otherwise(0.0)
    return per.select("brewery", "count", "with_price", money(F.col("cents")).alias("total"), average.alias("average"))


def grouped(items: DataFrame, field: str) -> DataFrame:
    """Per value of a field its items; no value and '-' mean ungrouped. Sizes and the span of ids stand for the rows, so no group is collected."""
    value = F.when(present(F.col(field)) & (clean(F.col(field)) != "-"), clean(F.col(field))).otherwise("ungrouped")
    return items.groupBy(value.alias("group")).agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def coverage(items: DataFrame, fields: list[str] = COVERED) -> DataFrame:
    """(field, coverage): the share of rows with a value, for all fields in one pass."""
    shares = [F.struct(F.lit(f).alias("field"), half_up(F.coalesce(F.count_if(present(F.col(f))) / F.count("*"), F.lit(0.0)), 4).alias("coverage")) for f in fields]
    return items.agg(F.array(*shares).alias("c")).select(F.inline("c"))


def existing_keys(new: DataFrame, old: DataFrame) -> DataFrame:
    """Items of ``new`` whose five-part key ``old`` has."""
    keys = [c for c in ("k_brewery", "k_name", "k_style", "k_format", "k_price")]
    return new.select("*", *dedup.key()).join(old.select(*dedup.key()).distinct(), keys, "left_semi").drop(*keys)


def form_errors(brewery: Column, name: Column, price: Column, volume: Column) -> Column:
    """Codes of what is wrong in an item form."""
    checks = [(F.length(clean(name)) == 0, "name_required"), (F.length(clean(name)) > 200, "name_long"), (F.length(clean(brewery)) > 200, "brewery_long"), (price < 0, "price_negative"), (price > 100000, "price_high"), (volume <= 0, "volume_low"), (volume > 100, "volume_high")]
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda x: x.isNotNull())


def raw_items(items: DataFrame) -> DataFrame:
    """Items with faults put in by rule, as input of the validation queries."""
    i = F.col("id")
    return items.withColumns(
        {
            "price": F.when(i % 11 == 0, F.lit(0.0)).when(i % 13 == 0, -F.col("price")).when(i % 17 == 0, F.col("price") * 1000).otherwise(F.col("price")).cast("string"),
            "volume": F.when(i % 19 == 0, F.lit("many")).when(i % 7 == 0, F.lit("0")).otherwise(F.col("volume").cast("int").cast("string")),
            "beer_name": F.when(i % 23 == 0, F.lit("")).otherwise(F.col("beer_name")),
            "brewery": F.when(i % 5 == 0, F.lit(None)).otherwise(F.col("brewery")),
        }
    )


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validated(raw_items(bound.items(spark, sf_dir))).select("id", F.inline("issues"))


def with_strength(items: DataFrame) -> DataFrame:
    """Items with a strength and a stock by rule, some of them missing."""
    return items.withColumns({"abv": F.when(F.col("id") % 3 > 0, "5.5"), "stock": F.when(F.col("id") % 5 == 0, "-4").when(F.col("id") % 5 == 1, "12")})


def strength_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of strength and stock."""
    strange = F.when(F.col("id") % 3 == 0, "strong").when(F.col("id") % 7 == 0, "25").when(F.col("id") % 7 == 1, "0").when(F.col("id") % 7 == 2, "-1").otherwise("5")
    rows = with_strength(bound.items(spark, sf_dir)).withColumn("abv", strange)
    return quality.validated(rows).select("id", F.inline("issues")).where("field IN ('abv', 'stock')")


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.totals(quality.validated(raw_items(bound.items(spark, sf_dir))))


def dedup_source(items: DataFrame) -> DataFrame:
    """Items whose descriptions and marks differ, prices coarse, so that keys repeat."""
    note = F.concat(F.col("beer_name"), F.lit(": "), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")))
    marked = F.when(F.col("id") % 3 == 0, F.concat(F.col("beer_name"), F.lit(" (Fresh brewed)"))).otherwise(F.col("beer_name"))
    return items.withColumns({"description": note, "price": F.floor(F.col("price") / 50) * 50.0}).withColumn("beer_name", marked)


def dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(dedup_source(bound.items(spark, sf_dir)), "id").select("id", "beer_name", "copies")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_per_key(bound.items(spark, sf_dir), ["brewery", "beer_name", "style"], "id").select("id", "brewery", "beer_name", "style")


def item_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    keg = display.looks_like_keg(c("format_type"), c("volume"))
    label = display.beer_label(c("brewery"), c("beer_name"), c("price_cents"))
    back = display.parse_label(label)
    return bound.items(spark, sf_dir).select(
        "id",
        keg.alias("is_keg"),
        display.export_format(c("format_type")).alias("short_format"),
        display.default_quantity(keg).alias("default_quantity"),
        label.alias("label"),
        back["brewery"].alias("label_brewery"),
        back["name"].alias("label_name"),
        back["price"].alias("label_price"),
        display.volume_price(c("volume"), (c("price_cents") / 100).cast("long"), c("currency"), c("format_type")).alias("volume_price"),
        display.abv_text(c("volume") / 2).alias("abv_text"),
    )


def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("; ", "brewery", "beer_name", F.lit(""), "style")
    return bound.items(spark, sf_dir).select("id", F.posexplode(keyword_list(text)).alias("pos", "keyword"))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ItemFilter(sheet="ECONOMY", brewery="BRAND#1", price=(900.0, 1500.0), volume=(1, 30))
    return listed(wanted(bound.items(spark, sf_dir))).select("id", "brewery", "beer_name", "price", "volume")


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("beer_name", "contains", "Ring"), ("brewery", "equals", "brand#7"), ("beer_name", "starts_with", "RED"), ("beer_name", "ends_with", "gear")]
    return bound.items(spark, sf_dir).agg(*[F.count_if(matches(F.col(f), mode, q)).alias(mode) for f, mode, q in asked])


def _sorted(field: str, descending: bool, n: int = 100):
    return lambda s, d: ranked(bound.items(s, d), [*table_order(field, descending), F.col("id").asc()], n).select("id", field, "place")


RUSSIAN = ["ель", "Абрикос", "яблоко", "ёж", "Еда"]


def _russian(s: SparkSession, d: str) -> DataFrame:
    """Items with Russian names in small and capital letters, in the order of the alphabet, ё beside е."""
    named = bound.items(s, d).withColumn("beer_name", F.element_at(F.array(*map(F.lit, RUSSIAN)), (F.col("id") % 5 + 1).cast("int")))
    order = [F.collate("beer_name", "ru_CI").asc(), F.col("price_cents").desc(), F.col("id").asc()]
    return ranked(named.where("id % 40 < 5"), order, 50).select("id", "beer_name", "place")


def _selected(s: SparkSession, d: str) -> DataFrame:
    """Sheets that have selected items, and how many."""
    items = bound.items(s, d)
    chosen = bound.table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id")).distinct()
    return items.join(chosen, "id", "left_semi").groupBy("sheet").agg(F.count("*").alias("selected"))


def _forms(s: SparkSession, d: str) -> DataFrame:
    rows = raw_items(bound.items(s, d)).withColumns({c: F.col(c).try_cast("double") for c in ("price", "volume")})
    return rows.select("id", F.explode(form_errors(F.col("brewery"), F.col("beer_name"), F.col("price"), F.col("volume"))).alias("code"))


def _existing(s: SparkSession, d: str) -> DataFrame:
    items = bound.items(s, d)
    coarse = items.withColumns({"price": F.floor(F.col("price") / 100) * 100.0, "brewery": F.lit("house")})
    return existing_keys(coarse.where("file_id < 10"), coarse.where("file_id >= 10")).select("id")


QUERIES = {
    "item_filter": _filtered,
    "item_search_modes": _searches,
    "item_page": lambda s, d: page(bound.items(s, d), 2).select("id", "file_id", "brewery", "beer_name"),
    "item_sort_price": _sorted("price", True),
    "item_sort_brewery": _sorted("brewery", False),
    "item_sort_russian": _russian,
    "admin_search": lambda s, d: admin_search(bound.items(s, d), "bolt", ["id", "brewery", "beer_name", "style"]).select("id", "beer_name"),
    "suggestions": lambda s, d: suggestions(bound.items(s, d), "ring"),
    "items_with_gaps": lambda s, d: with_gaps(raw_items(bound.items(s, d)).withColumns({c: F.col(c).try_cast("double") for c in ("price", "volume")})).select("id"),
    "sheet_counts": lambda s, d: value_counts(bound.items(s, d), "sheet", 100, None, False),
    "brand_counts": lambda s, d: value_counts(raw_items(bound.items(s, d)), "brewery", 10),
    "style_counts": lambda s, d: value_counts(bound.items(s, d), "style", 8),
    "format_counts": lambda s, d: value_counts(bound.items(s, d), "format_type", 6),
    "price_summary": lambda s, d: price_summary(bound.items(s, d)),
    "brand_stats": lambda s, d: brewery_stats(bound.items(s, d)),
    "item_groups": lambda s, d: grouped(raw_items(bound.items(s, d)), "brewery"),
    "field_coverage": lambda s, d: coverage(with_strength(raw_items(bound.items(s, d)))),
    "strength_issues": strength_issues,
    "validation_issues": validation_issues,
    "validation_summary": validation_summary,
    "form_errors": _forms,
    "dedup_items": dedup_items,
    "dedup_first": dedup_first,
    "existing_keys": _existing,
    "item_display": item_display,
    "keyword_lists": keyword_lists,
    "selected_sheets": _selected,
    "style_inferred": lambda s, d: bound.table(s, d, "documents").groupBy(style.inferred(F.col("text"), F.col("source")).alias("style")).agg(F.count("*").alias("documents")),
    "style_guessed": lambda s, d: bound.table(s, d, "documents").groupBy(style.guessed(F.col("text")).alias("style")).agg(F.count("*").alias("documents")),
}
_WITH = f"WITH {bound.ITEMS} "
_RAW = f"""WITH {bound.ITEMS}, raw AS (SELECT id, file_id, sheet, style, currency, format_type,
    CASE WHEN id % 11 = 0 THEN 0.0 WHEN id % 13 = 0 THEN -price WHEN id % 17 = 0 THEN price * 1000 ELSE price END AS price,
    CASE WHEN id % 19 = 0 THEN 'many' WHEN id % 7 = 0 THEN '0' ELSE volume::INT::VARCHAR END AS volume,
    CASE WHEN id % 23 = 0 THEN '' ELSE beer_name END AS beer_name, CASE WHEN id % 5 = 0 THEN NULL ELSE brewery END AS brewery FROM items),
  num AS (SELECT *, try_cast(volume AS DOUBLE) AS v, coalesce(beer_name, '') <> '' AS n, coalesce(brewery, '') <> '' AS b FROM raw) """
_ISSUES = _RAW + """, found AS (
    SELECT id, 'price_negative' AS code, 'error' AS severity, 'price' AS field FROM num WHERE price < 0
    UNION ALL SELECT id, 'price_high', 'warning', 'price' FROM num WHERE price > 100000
    UNION ALL SELECT id, 'price_zero', 'warning', 'price' FROM num WHERE price = 0
    UNION ALL SELECT id, 'volume_invalid', 'error', 'volume' FROM num WHERE v IS NULL
    UNION ALL SELECT id, 'volume_zero', 'warning', 'volume' FROM num WHERE v = 0
    UNION ALL SELECT id, 'volume_high', 'warning', 'volume' FROM num WHERE v > 100
    UNION ALL SELECT id, 'name_and_brewery_missing', 'warning', 'beer_name' FROM num WHERE NOT n AND NOT b
    UNION ALL SELECT id, 'name_missing', 'warning', 'beer_name' FROM num WHERE NOT n AND b
    UNION ALL SELECT id, 'brewery_missing', 'warning', 'brewery' FROM num WHERE n AND NOT b
    UNION ALL SELECT id, 'per_litre_low', 'warning', 'price' FROM num WHERE price <> 0 AND v > 0 AND price < 50 * v
    UNION ALL SELECT id, 'per_litre_high', 'warning', 'price' FROM num WHERE price <> 0 AND v > 0 AND price > 10000 * v) """
_DEDUP = f"""WITH {bound.ITEMS}, d AS (SELECT id, brewery, style, format_type, floor(price / 50) * 50 AS price, beer_name AS base,
    CASE WHEN id % 3 = 0 THEN beer_name || ' (Fresh brewed)' ELSE beer_name END AS beer_name,
    CASE WHEN id % 3 <> 0 THEN id % 7 WHEN id % 7 = 0 THEN length(beer_name) + 1 ELSE length(beer_name) + 2 + id % 7 END AS own, id % 3 <> 0 AS begins FROM items) """
_COVER = " UNION ALL ".join(f"SELECT '{f}' AS field, {half_up_sql(f'count(nullif(CAST({f} AS VARCHAR), {chr(39)}{chr(39)})) / count(*)', 4)} AS coverage FROM (SELECT *, CASE WHEN id % 3 > 0 THEN '5.5' END AS abv, CASE id % 5 WHEN 0 THEN '-4' WHEN 1 THEN '12' END AS stock FROM raw)" for f in COVERED)


def _kinds(rules: list, text: str, finer: dict) -> str:
    out = "NULL"
    for name, words in reversed(rules):
        hit = " OR ".join(f"contains({text}, '{w}')" for w in words)
        value = f"'{name}'"
        if name in finer:
            value = f"CASE WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in finer[name][1])} THEN '{finer[name][0]}' ELSE '{name}' END"
        out = f"CASE WHEN {hit} THEN {value} ELSE {out} END"
    return out


ORACLES = {
    "item_filter": _WITH + "SELECT id, brewery, beer_name, price, volume FROM items WHERE sheet = 'ECONOMY' AND contains(lower(brewery), 'brand#1') AND price BETWEEN 900 AND 1500 AND volume BETWEEN 1 AND 30 ORDER BY file_id, brewery, beer_name, id LIMIT 1000",
    "item_search_modes": _WITH + "SELECT count(*) FILTER (contains(lower(beer_name), 'ring')) AS contains, count(*) FILTER (lower(brewery) = 'brand#7') AS equals, count(*) FILTER (starts_with(lower(beer_name), 'red')) AS starts_with, count(*) FILTER (suffix(lower(beer_name), 'gear')) AS ends_with FROM items",
    "item_page": _WITH + "SELECT id, file_id, brewery, beer_name FROM items ORDER BY file_id, brewery, beer_name, id LIMIT 100 OFFSET 100",
    "item_sort_price": _WITH + "SELECT id, price, row_number() OVER (ORDER BY price DESC, id)::INT AS place FROM items ORDER BY place LIMIT 100",
    "item_sort_brewery": _WITH + "SELECT id, brewery, row_number() OVER (ORDER BY lower(brewery), id)::INT AS place FROM items ORDER BY place LIMIT 100",
    "item_sort_russian": _WITH + "SELECT id, ['ель', 'Абрикос', 'яблоко', 'ёж', 'Еда'][id % 5 + 1] AS beer_name, row_number() OVER (ORDER BY [3, 0, 4, 2, 1][id % 5 + 1], price_cents DESC, id)::INT AS place FROM items WHERE id % 40 < 5 ORDER BY place LIMIT 50",
    "admin_search": _WITH + "SELECT id, beer_name FROM items WHERE contains(lower(concat_ws('|', id, brewery, beer_name, style)), 'bolt')",
    "suggestions": _WITH + "SELECT DISTINCT x AS suggestion FROM (SELECT unnest([brewery, beer_name, style]) AS x FROM items) WHERE contains(lower(x), 'ring') ORDER BY 1 LIMIT 5",
    "items_with_gaps": _RAW + "SELECT id FROM num WHERE coalesce(v, 0) = 0 OR coalesce(price, 0) = 0",
    "sheet_counts": _WITH + "SELECT sheet, count(*) AS count FROM items GROUP BY 1 ORDER BY 1 LIMIT 100",
    "brand_counts": _RAW + "SELECT coalesce(brewery, 'Не указано') AS brewery, count(*) AS count FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "style_counts": _WITH + "SELECT style, count(*) AS count FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "format_counts": _WITH + "SELECT format_type, count(*) AS count FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
    "price_summary": _WITH + f"SELECT count(*) AS items, {half_up_sql('sum(price_cents) / count(*) / 100', 2)} AS average_price, count(*) AS with_price, count(*) AS with_volume, count(*) AS with_style FROM items",
    "brand_stats": _WITH + f"SELECT brewery, count(*) AS count, count(*) AS with_price, sum(price_cents) / 100.0 AS total, {half_up_sql('sum(price_cents) / count(*) / 100', 2)} AS average FROM items GROUP BY 1",
    "item_groups": _RAW + "SELECT coalesce(brewery, 'ungrouped') AS \"group\", count(*) AS size, min(id) AS first_id, max(id) AS last_id FROM raw GROUP BY 1",
    "field_coverage": _RAW + _COVER,
    "validation_issues": _ISSUES + "SELECT * FROM found",
    "validation_summary": _ISSUES + "SELECT (SELECT count(*) FROM raw) AS total, (SELECT count(*) FROM raw) - count(DISTINCT CASE WHEN severity = 'error' THEN id END) AS valid, count(DISTINCT CASE WHEN severity = 'error' THEN id END) AS invalid, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM found",
    "strength_issues": _WITH + """, x AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'abv_invalid' WHEN id % 7 = 0 THEN 'abv_high' WHEN id % 7 = 1 THEN 'abv_zero' WHEN id % 7 = 2 THEN 'abv_negative' END AS code FROM items)
      SELECT id, code, CASE WHEN code IN ('abv_high', 'abv_zero') THEN 'warning' ELSE 'error' END AS severity, 'abv' AS field FROM x WHERE code IS NOT NULL UNION ALL SELECT id, 'stock_negative', 'error', 'stock' FROM items WHERE id % 5 = 0""",
    "form_errors": _RAW + "SELECT id, 'name_required' AS code FROM num WHERE NOT n UNION ALL SELECT id, 'price_negative' FROM num WHERE price < 0 UNION ALL SELECT id, 'price_high' FROM num WHERE price > 100000 UNION ALL SELECT id, 'volume_low' FROM num WHERE v <= 0 UNION ALL SELECT id, 'volume_high' FROM num WHERE v > 100",
    "dedup_items": _DEDUP + "SELECT id, beer_name, copies FROM (SELECT *, count(*) OVER w AS copies, row_number() OVER (w ORDER BY id % 3 = 0, own DESC, begins, id) AS r FROM d WINDOW w AS (PARTITION BY lower(brewery), base, lower(style), format_type, price)) WHERE r = 1",
    "dedup_first": _WITH + "SELECT min(id) AS id, brewery, beer_name, style FROM items GROUP BY ALL",
    "existing_keys": _WITH + ", c AS (SELECT *, floor(price / 100) AS p FROM items) SELECT id FROM c WHERE file_id < 10 AND EXISTS (FROM c AS o WHERE o.file_id >= 10 AND (o.beer_name, o.style, o.format_type, o.p) = (c.beer_name, c.style, c.format_type, c.p))",
    "item_display": _WITH + """SELECT id, format_type = 'кега' AS is_keg, CASE format_type WHEN 'кега' THEN 'кег' WHEN 'бутылка' THEN 'бут' ELSE 'банка' END AS short_format,
        CASE WHEN format_type = 'кега' THEN 1 ELSE 10 END AS default_quantity, brewery || ' | ' || beer_name || '(' || price_cents || ')' AS label, brewery AS label_brewery, beer_name AS label_name,
        price_cents::DOUBLE AS label_price, volume::INT || ' л · ' || price_cents // 100 || ' ₽ · ' || format_type AS volume_price,
        CASE WHEN volume::INT % 2 = 0 THEN (volume::INT // 2)::VARCHAR ELSE (volume / 2)::VARCHAR END || ' %' AS abv_text FROM items""",
    "keyword_lists": _WITH + "SELECT id, pos - 1 AS pos, k[pos] AS keyword FROM (SELECT id, [brewery, beer_name, style] AS k, unnest([1, 2, 3]) AS pos FROM items)",
    "selected_sheets": _WITH + "SELECT sheet, count(*) AS selected FROM items WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) GROUP BY 1",
    "style_inferred": f"SELECT {_kinds(style.BY_NAME, 't', style.FINER)} AS style, count(*) AS documents FROM (SELECT lower(text) AS t FROM documents) GROUP BY 1",
    "style_guessed": f"SELECT {_kinds(style.GROUPS, 't', {})} AS style, count(*) AS documents FROM (SELECT lower(text) AS t FROM documents) GROUP BY 1",
}
