"""Order analytics: statistics, rankings, price trends, totals by day, sheet and packaging, export rows.

Lines have order_id, line_no, item_id, quantity and price_cents; items have id
and their fields. Aggregates run before joins wherever the join adds only
names, so what is shuffled is one row per item and task, not per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.functions.display import default_quantity, export_format, looks_like_keg
from sparkmalt.plans import bound
from sparkmalt.plans.bound import half_up, half_up_sql, money

ORDER = ["day", "order_id", "line_no", "price_cents"]


def between_days(orders: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Orders whose local day lies in the range, both ends included."""
    out = orders if first is None else orders.where(F.col("day") >= F.lit(first).cast("date"))
    return out if last is None else out.where(F.col("day") <= F.lit(last).cast("date"))


def resolved(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with item_name and price_cents; what a line lacks comes from its item, a name at last from the id. A line keeps its place if its item is gone."""
    looked = items.select(F.col("id").alias("item_id"), F.col("beer_name").alias("__name"), F.col("price_cents").alias("__cents"))
    out = lines.join(looked, "item_id", "left")
    own = F.col("item_name") if "item_name" in lines.columns else F.lit(None).cast("string")
    named = F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.col("__name"), F.lit("")), F.concat(F.lit("ID "), F.col("item_id").cast("string")))
    return out.withColumns({"item_name": named, "price_cents": F.coalesce("price_cents", "__cents", F.lit(0))}).drop("__name", "__cents")


def line_cents() -> Column:
    return F.when(F.col("price_cents") > 0, F.col("price_cents") * F.col("quantity")).otherwise(F.lit(0).cast("long"))


def statistics(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: total_orders (those without lines too), total_sum, total_positions, average."""
    count = orders.agg(F.count("*").alias("total_orders"))
    sums = lines.agg(F.coalesce(F.sum(line_cents()), F.lit(0)).alias("cents"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_positions"))
    average = F.when(F.col("total_orders") > 0, half_up(F.col("cents") / F.col("total_orders") / 100, 2)).otherwise(0.0)
    return count.crossJoin(sums).select("total_orders", money(F.col("cents")).alias("total_sum"), "total_positions", average.alias("average"))


def per_item(lines: DataFrame) -> DataFrame:
    return lines.groupBy("item_id").agg(F.sum("quantity").alias("quantity"), F.sum(line_cents()).alias("cents"))


def ranking(lines: DataFrame, items: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` items ordered most often, with names."""
    top = per_item(lines).orderBy(F.desc("quantity"), "item_id").limit(n)
    named = top.join(items.select(F.col("id").alias("item_id"), "beer_name"), "item_id", "left")
    return named.select("item_id", F.coalesce("beer_name", F.concat(F.lit("ID "), F.col("item_id").cast("string"))).alias("beer_name"), "quantity", money(F.col("cents")).alias("total"))


def ranking_by_day(lines: DataFrame, n: int = 100) -> DataFrame:
    """Quantities and sums by day of the ``n`` items of the ranking."""
    top = per_item(lines).orderBy(F.desc("quantity"), "item_id").limit(n).select("item_id")
    days = lines.join(top, "item_id", "left_semi").groupBy("item_id", "day").agg(F.sum("quantity").alias("quantity"), F.sum(line_cents()).alias("cents"))
    return days.select("item_id", "day", "quantity", money(F.col("cents")).alias("total"))


def price_trend(lines: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` items whose price moved most between their first and their last line; partial minima, no window."""
    when = F.struct(*ORDER)
    per = lines.groupBy("item_id").agg(F.count("*").alias("points"), F.min_by("price_cents", when).alias("first"), F.max_by("price_cents", when).alias("last"))
    per = per.where("points >= 2 AND first > 0").withColumn("change_pct", half_up((F.col("last") - F.col("first")) * F.lit(100.0) / F.col("first"), 1))
    top = per.orderBy(F.desc(F.abs("change_pct")), "item_id").limit(n)
    return top.select("item_id", "points", money(F.col("first")).alias("first_price"), money(F.col("last")).alias("last_price"), "change_pct")


def by_day(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders, quantity and sum by day; negative prices count here."""
    per_order = lines.groupBy("order_id").agg(F.sum("quantity").alias("quantity"), F.sum(F.col("price_cents") * F.col("quantity")).alias("cents"))
    days = orders.join(per_order, "order_id", "left").groupBy("day").agg(F.count("*").alias("orders"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    return days.select("day", "orders", "quantity", money(F.col("cents")).alias("total"))


def by_item_field(lines: DataFrame, items: DataFrame, field: str, missing: str = "—") -> DataFrame:
    """Lines, quantity and sum by a field of the items; summed per item before the join."""
    per = lines.groupBy("item_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"), F.sum(line_cents()).alias("cents"))
    found = per.join(items.select(F.col("id").alias("item_id"), field), "item_id", "left")
    out = found.groupBy(F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit(missing)).alias(field)).agg(F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents"))
    return out.select(field, "lines", "quantity", money(F.col("cents")).alias("total"))


def top_by_sum(lines: DataFrame, items: DataFrame, field: str, n: int) -> DataFrame:
    return by_item_field(lines, items, field).orderBy(F.desc("total"), field).limit(n)


def export_rows(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of an order form: lines whose item is still there, packaging in short."""
    looked = items.select(F.col("id").alias("item_id"), "brewery", "beer_name", "format_type", "volume")
    rows = lines.join(looked, "item_id")
    return rows.select("order_id", "line_no", "item_id", "brewery", "beer_name", export_format(F.col("format_type")).alias("format"), "quantity", money(F.col("price_cents")).alias("price"), money(F.col("price_cents") * F.col("quantity")).alias("total"))


def export_totals(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Sums per order and, with a null order, over all (a rollup)."""
    rows = lines.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    out = rows.rollup("order_id").agg(F.sum("quantity").alias("quantity"), F.sum(F.col("price_cents") * F.col("quantity")).alias("cents"))
    return out.select("order_id", "quantity", money(F.col("cents")).alias("total"))


def keg_totals(lines: DataFrame, items: DataFrame, below_cents: int = 200_000) -> DataFrame:
    """Per order: quantity and the sum in which a keg's price under the limit is one per litre."""
    keg = looks_like_keg(F.col("format_type"), F.col("volume"))
    looked = items.select(F.col("id").alias("item_id"), F.when(keg & (F.col("volume") > 0), F.col("volume").cast("long")).otherwise(F.lit(1).cast("long")).alias("litres"))
    times = F.when(F.col("price_cents") < below_cents, F.coalesce("litres", F.lit(1))).otherwise(F.lit(1))
    out = lines.join(looked, "item_id", "left").groupBy("order_id").agg(F.sum("quantity").alias("quantity"), F.sum(F.col("price_cents") * F.col("quantity") * times).alias("cents"))
    return out.select("order_id", "quantity", money(F.col("cents")).alias("total"))


def eligible_kegs(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct kegs of each order, with the quantity that a new order would begin with."""
    keg = looks_like_keg(F.col("format_type"), F.col("volume"))
    kegs = items.where(keg).select(F.col("id").alias("item_id"), "beer_name", default_quantity(F.lit(True)).alias("default_quantity"))
    return lines.where("quantity > 0").select("order_id", "item_id").distinct().join(kegs, "item_id")


def source_file(lines: DataFrame, items: DataFrame) -> DataFrame:
    """The file of an order: that of its smallest item that is still there."""
    looked = items.select(F.col("id").alias("item_id"), "file_id")
    return lines.join(looked, "item_id").groupBy("order_id").agg(F.min_by("file_id", "item_id").alias("file_id"), F.count_distinct("item_id").alias("items"))


def reformed(lines: DataFrame, items: DataFrame) -> DataFrame:
    """An old order as a new one: items that are still there, quantities summed."""
    return lines.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").groupBy("order_id", "item_id").agg(F.sum("quantity").alias("quantity"))


def missing_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Items of orders that are no longer in the table."""
    return lines.join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti").groupBy("item_id").agg(F.count("*").alias("lines"))


def found_by_text(orders: DataFrame, text: str) -> DataFrame:
    """Orders whose id or day, written dd.mm.yyyy, contains a text."""
    return orders.where(F.col("order_id").cast("string").contains(text) | F.date_format("day", "dd.MM.yyyy").contains(text))


def templates(lines: DataFrame) -> DataFrame:
    """Order lines kept as a template: one row per order with its lines as a sorted array."""
    return lines.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "quantity"))).alias("lines"))


def from_template(saved: DataFrame) -> DataFrame:
    return saved.select("order_id", F.inline("lines"))


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return bound.orders(spark, sf_dir), bound.order_lines(spark, sf_dir), bound.items(spark, sf_dir)


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, lines, _ = _lines(spark, sf_dir)
    return lines.join(o.select("order_id", "day"), "order_id")


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, lines, it = _lines(spark, sf_dir)
    return statistics(o, resolved(lines, it))


def order_statistics_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, lines, _ = _lines(spark, sf_dir)
    o = between_days(o, "1996-01-01", "1998-12-31")
    return statistics(o, lines.join(o.select("order_id"), "order_id", "left_semi"))


def reordered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = templates(_lines(spark, sf_dir)[1])
    return from_template(saved).groupBy("item_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


QUERIES = {
    "order_statistics": order_statistics,
    "order_statistics_in_range": order_statistics_in_range,
    "item_ranking": lambda s, d: ranking(_lines(s, d)[1], _lines(s, d)[2]),
    "item_ranking_by_day": lambda s, d: ranking_by_day(_dated(s, d)),
    "price_trend": lambda s, d: price_trend(_dated(s, d)),
    "orders_by_day": lambda s, d: by_day(*_lines(s, d)[:2]),
    "by_format": lambda s, d: by_item_field(*_lines(s, d)[1:], "format_type"),
    "by_sheet": lambda s, d: by_item_field(*_lines(s, d)[1:], "sheet"),
    "top_brands": lambda s, d: top_by_sum(*_lines(s, d)[1:], "brewery", 10),
    "top_items": lambda s, d: top_by_sum(*_lines(s, d)[1:], "beer_name", 15),
    "order_export_rows": lambda s, d: export_rows(*_lines(s, d)[1:]),
    "order_export_totals": lambda s, d: export_totals(*_lines(s, d)[1:]),
    "keg_totals": lambda s, d: keg_totals(*_lines(s, d)[1:]),
    "eligible_kegs": lambda s, d: eligible_kegs(*_lines(s, d)[1:]),
    "order_source_file": lambda s, d: source_file(*_lines(s, d)[1:]),
    "order_reform": lambda s, d: reformed(_lines(s, d)[1], _lines(s, d)[2].where("file_id = 3")),
    "missing_items": lambda s, d: missing_items(_lines(s, d)[1], _lines(s, d)[2].where("file_id <> 3")),
    "order_search": lambda s, d: found_by_text(_lines(s, d)[0], "12.1997").select("order_id", "day"),
    "order_templates": reordered_templates,
}
_WITH = f"WITH {bound.ITEMS}, {bound.ORDERS}, {bound.LINES} "
_DATED = f"WITH {bound.ITEMS}, {bound.ORDERS}, {bound.LINES}, dated AS (SELECT l.*, o.day FROM lines l JOIN ords o USING (order_id)) "
_STATS = "SELECT n AS total_orders, c / 100.0 AS total_sum, q AS total_positions, CASE WHEN n > 0 THEN " + half_up_sql("c / n / 100", 2) + " ELSE 0.0 END AS average"
_FIELD = "SELECT {0}, count(*) AS lines, sum(quantity)::BIGINT AS quantity, sum(lines.price_cents * quantity) / 100.0 AS total FROM lines JOIN items ON id = item_id GROUP BY {0}"
ORACLES = {
    "order_statistics": _WITH + f"{_STATS} FROM (SELECT count(*) AS n FROM ords), (SELECT sum(price_cents * quantity)::BIGINT AS c, sum(quantity)::BIGINT AS q FROM lines)",
    "order_statistics_in_range": _WITH + f", o AS (SELECT * FROM ords WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') {_STATS} FROM (SELECT count(*) AS n FROM o), (SELECT sum(price_cents * quantity)::BIGINT AS c, sum(quantity)::BIGINT AS q FROM lines WHERE order_id IN (SELECT order_id FROM o))",
    "item_ranking": _WITH + "SELECT item_id, any_value(beer_name) AS beer_name, sum(quantity)::BIGINT AS quantity, sum(lines.price_cents * quantity) / 100.0 AS total FROM lines JOIN items ON id = item_id GROUP BY item_id ORDER BY 3 DESC, 1 LIMIT 100",
    "item_ranking_by_day": _DATED + "SELECT item_id, day, sum(quantity)::BIGINT AS quantity, sum(price_cents * quantity) / 100.0 AS total FROM dated WHERE item_id IN (SELECT item_id FROM lines GROUP BY 1 ORDER BY sum(quantity) DESC, 1 LIMIT 100) GROUP BY 1, 2",
    "price_trend": _DATED + f", p AS (SELECT item_id, count(*) AS points, arg_min(price_cents, (day, order_id, line_no, price_cents)) AS f, arg_max(price_cents, (day, order_id, line_no, price_cents)) AS l FROM dated GROUP BY 1), t AS (SELECT item_id, points, f / 100.0 AS first_price, l / 100.0 AS last_price, {half_up_sql('(l - f) * 100.0 / f', 1)} AS change_pct FROM p WHERE points >= 2 AND f > 0) SELECT * FROM t ORDER BY abs(change_pct) DESC, item_id LIMIT 50",
    "orders_by_day": _WITH + "SELECT day, count(DISTINCT o.order_id) AS orders, coalesce(sum(quantity), 0)::BIGINT AS quantity, coalesce(sum(price_cents * quantity), 0) / 100.0 AS total FROM ords o LEFT JOIN lines USING (order_id) GROUP BY day",
    "by_format": _WITH + _FIELD.format("format_type"),
    "by_sheet": _WITH + _FIELD.format("sheet"),
    "top_brands": _WITH + _FIELD.format("brewery") + " ORDER BY total DESC, brewery LIMIT 10",
    "top_items": _WITH + _FIELD.format("beer_name") + " ORDER BY total DESC, beer_name LIMIT 15",
    "order_export_rows": _WITH + "SELECT order_id, line_no, item_id, brewery, beer_name, CASE format_type WHEN 'кега' THEN 'кег' WHEN 'бутылка' THEN 'бут' ELSE 'банка' END AS format, quantity, lines.price_cents / 100.0 AS price, lines.price_cents * quantity / 100.0 AS total FROM lines JOIN items ON id = item_id",
    "order_export_totals": _WITH + "SELECT order_id, sum(quantity)::BIGINT AS quantity, sum(lines.price_cents * quantity) / 100.0 AS total FROM lines JOIN items ON id = item_id GROUP BY ROLLUP (order_id)",
    "keg_totals": _WITH + "SELECT order_id, sum(quantity)::BIGINT AS quantity, sum(lines.price_cents * quantity * CASE WHEN lines.price_cents < 200000 AND format_type = 'кега' THEN volume::BIGINT ELSE 1 END) / 100.0 AS total FROM lines LEFT JOIN items ON id = item_id GROUP BY order_id",
    "eligible_kegs": _WITH + "SELECT DISTINCT item_id, order_id, beer_name, 1 AS default_quantity FROM lines JOIN items ON id = item_id WHERE format_type = 'кега'",
    "order_source_file": _WITH + "SELECT order_id, arg_min(file_id, item_id) AS file_id, count(DISTINCT item_id) AS items FROM lines JOIN items ON id = item_id GROUP BY order_id",
    "order_reform": _WITH + "SELECT order_id, item_id, sum(quantity)::BIGINT AS quantity FROM lines JOIN items ON id = item_id AND file_id = 3 GROUP BY 1, 2",
    "missing_items": _WITH + "SELECT item_id, count(*) AS lines FROM lines WHERE item_id NOT IN (SELECT id FROM items WHERE file_id <> 3) GROUP BY 1",
    "order_search": _WITH + "SELECT order_id, day FROM ords WHERE contains(order_id::VARCHAR, '12.1997') OR contains(strftime(day, '%d.%m.%Y'), '12.1997')",
    "order_templates": _WITH + "SELECT item_id, count(*) AS lines, sum(quantity)::BIGINT AS quantity FROM lines GROUP BY 1",
}
