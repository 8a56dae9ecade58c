"""Queries over sinks and product pages: changes by id, order forms, CSV and JSON texts, run logs, reports, page styles and labels, forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.functions import display, style
from sparkmalt.operators import classify, quality
from sparkmalt.plans import boards, bound, catalogue
from sparkmalt.sources import sinks


def edited(s: SparkSession, d: str) -> DataFrame:
    """Items after an edit by id and a deletion by id."""
    items = bound.items(s, d).select("id", "brewery", "style", "price_cents")
    edits = items.where("id % 10 = 3").select("id", F.lit("edited").alias("style"), F.when(F.col("id") % 20 == 3, F.lit(1)).alias("price_cents"))
    return sinks.deleted_by_id(sinks.updated_by_id(items, edits), items.where("id % 10 = 7"))


def cut_items(s: SparkSession, d: str) -> DataFrame:
    long = F.repeat(F.concat("beer_name", F.lit(" ")), (F.col("id") % 20).cast("int"))
    return sinks.truncated(bound.items(s, d).select("id", long.alias("beer_name"), F.repeat("format_type", 9).alias("format_type"))).select("id", F.length("beer_name").alias("name_chars"), "format_type")


def order_form(s: SparkSession, d: str) -> DataFrame:
    """Cells that orders write into the price lists that their items come from; the heading row and the order column differ by list."""
    items = bound.items(s, d)
    lists = items.select("file_id").distinct()
    n = F.col("file_id")
    head = F.when(n % 3 == 0, F.array(*map(F.lit, ["Наименование", "Стиль", "Цена", "Кол-во"]))).when(n % 3 == 1, F.array(*map(F.lit, ["Наименование", "Тип фасовки / кол-во в уп", "Цена", "Стиль", "Заказ"]))).otherwise(F.array(*map(F.lit, ["Наименование", "ABV", "Цена"])))
    rows = F.array(F.struct(F.lit(0).alias("row_idx"), F.array(F.lit("Прайс, заказ по телефону")).alias("v")), F.struct((1 + n % 3).cast("int").alias("row_idx"), head.alias("v")), F.struct(F.lit(500).alias("row_idx"), F.array(F.lit("end")).alias("v")))
    cells = lists.select("file_id", F.lit("Пиво").alias("sheet"), F.explode(rows).alias("r")).select("file_id", "sheet", "r.row_idx", F.posexplode("r.v").alias("col_idx", "value"))
    looked = items.select(F.col("id").alias("item_id"), "file_id", F.array(F.lit("Титул"), F.lit("Пиво")).alias("names"), F.floor(F.col("id") / bound.FILES).alias("row"))
    lines = bound.order_lines(s, d).where("quantity >= 45").join(looked, "item_id").withColumn("sheet", sinks.sheet_in_book(F.col("names"), F.lit(None).cast("string"), F.lit(" пиво"))).select("order_id", "line_no", "file_id", "sheet", "row", "quantity")
    return sinks.order_cells(lines, sinks.order_columns(cells))


def csv_texts(s: SparkSession, d: str) -> DataFrame:
    """Items as CSV lines; some texts have commas, quotes and breaks."""
    text = F.when(F.col("id") % 3 == 0, F.concat("beer_name", F.lit(', a "fine" one'))).when(F.col("id") % 3 == 1, F.concat(F.lit('"'), "beer_name")).otherwise(F.concat("beer_name", F.lit("\nsecond")))
    rows = bound.items(s, d).select("id", text.alias("beer_name"), F.when(F.col("id") % 4 > 0, F.col("price_cents")).alias("price_cents"))
    return rows.select("id", sinks.csv_line(rows.columns).alias("line"))


def json_texts(s: SparkSession, d: str) -> DataFrame:
    rows = bound.items(s, d).select("id", "brewery", F.when(F.col("id") % 4 > 0, F.col("price_cents")).alias("price_cents"))
    return rows.select("id", sinks.json_line(rows.columns).alias("line"))


def runs_logged(s: SparkSession, d: str) -> DataFrame:
    found = quality.validated(catalogue.raw_items(bound.items(s, d)))
    return sinks.run_log(found, "v2", F.lit("2024-01-01").cast("timestamp")).select("file_id", "status", "items_count", "warning_count", "error_count", "summary")


def metadata_kept(s: SparkSession, d: str) -> DataFrame:
    """Metadata of files after some were parsed again: contacts come from the rows that are no products."""
    i = F.col("p_partkey")
    said = F.when(i % 10 == 1, F.concat(F.lit("Менеджер a"), i.cast("string"), F.lit("@beer.example, самовывоз"))).when(i % 10 == 2, "Самовывоз")
    rows = bound.table(s, d, "part").select((i % 50).alias("file_id"), i.alias("row_idx"), F.coalesce(said, F.col("p_name")).alias("row_text"), said.isNull().alias("is_product"))
    new = classify.metadata(rows.where("file_id % 10 IN (1, 2)")).select("file_id", F.array_join("emails", " ").alias("emails"), "skipped_rows")
    old = s.range(30).select(F.col("id").alias("file_id"), F.lit("old").alias("emails"), F.lit(0).cast("long").alias("skipped_rows"))
    return sinks.metadata_upserted(old, new)


def reports(s: SparkSession, d: str) -> DataFrame:
    items = catalogue.raw_items(bound.items(s, d))
    out = sinks.shadow_report(items.where("id % 3 > 0"), items.where("id % 4 > 0"), ["brewery", "beer_name"])
    share = lambda c, f: F.get_json_object(c, f"$.{f}").cast("double")
    return out.select("file_id", "main_items", "other_items", "delta_items", share("main_coverage", "brewery").alias("main_brewery"), share("other_coverage", "beer_name").alias("other_name"))


def _paged(s: SparkSession, d: str) -> DataFrame:
    """Pages with meta fields, JSON data and images put in by number."""
    i = F.col("page_id")
    head = F.when(i % 4 == 0, F.lit('<meta property="og:description" content="Style: Baltic Porter">')).when(i % 4 == 1, F.lit('<script type="application/ld+json">{"category": "Wheat Beer"}</script>')).otherwise("")
    path = F.concat(F.lit("https://assets.pics.example/site/beer_logos"), F.when(i % 3 == 0, F.lit("_hd/")).otherwise(F.lit("/beer-")), i.cast("string"))
    images = F.concat(F.lit('<img alt="" src="https://assets.pics.example/temp/x.png"><img src="/local.png"><img src="https://assets.pics.example/a'), i.cast("string"), F.lit('.png?w=1">'), F.when(i % 5 > 0, F.concat(F.lit('<source src="'), path, F.when(i % 2 == 0, F.lit("_hd.jpeg")).otherwise(F.lit("_sm.png")), F.lit('#top">'))).otherwise(""))
    return bound.table(s, d, "pages").select("page_id", F.concat(head, "html", images).alias("html"))


def page_styles(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("(NEW) "), F.when(F.col("page_id") % 2 == 0, "Table Talk").otherwise("Plain"))
    return _paged(s, d).select("page_id", style.scraped_name(name).alias("beer_name"), style.page_style(F.col("html"), style.scraped_name(name)).alias("style"))


def page_labels(s: SparkSession, d: str) -> DataFrame:
    urls = style.label_candidates(F.col("html"))
    return _paged(s, d).select("page_id", F.size(urls).alias("candidates"), style.best_label(urls).alias("label"))


def form_texts(s: SparkSession, d: str) -> DataFrame:
    """What is wrong with the texts of item forms."""
    i = F.col("id")
    rows = bound.items(s, d).select("id", F.when(i % 5 > 0, F.col("brewery")).alias("brewery"), F.repeat("beer_name", (i % 25).cast("int")).alias("beer_name"), F.when(i % 7 == 0, "5,5.1").otherwise("5,5").alias("abv"), F.when(i % 3 == 0, "RUBL").otherwise("RUB").alias("currency"))
    return rows.select("id", F.explode(quality.form_text_errors(rows.columns)).alias("code"))


def orders_checked(s: SparkSession, d: str) -> DataFrame:
    """How many orders have a good payload: lines with an item and a whole quantity above 0."""
    lines = bound.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_partkey") % 50 > 0, F.col("l_partkey")).alias("item_id"), (F.col("l_quantity").cast("int") - 2).alias("quantity"))).alias("lines"))
    return lines.groupBy(quality.order_lines_valid(F.col("lines")).alias("valid")).agg(F.count("*").alias("orders"))


def waiting_beers(s: SparkSession, d: str) -> DataFrame:
    """Beers that wait at one location, in order, without those that have no name."""
    beers = boards.taps(s, d).select((F.col("tap_id") % 7).alias("location_id"), "tap_id", F.when(F.col("tap_id") % 3 > 0, F.col("beer_name")).alias("beer_name"))
    return boards.waiting(beers, 4).select("tap_id", "beer_name")


def location_boards(s: SparkSession, d: str) -> DataFrame:
    """Each location with the names of its taps, in order."""
    return boards.with_taps(boards.locations(s, d), boards.taps(s, d)).select("location_id", F.array_join(F.transform("taps", lambda t: t["beer_name"]), ",").alias("beers"))


def runs_with_files(s: SparkSession, d: str) -> DataFrame:
    """Runs with their customer's name and segment, as their file and supplier."""
    files = bound.table(s, d, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("supplier"))
    return bound.runs(s, d).join(files, "file_id", "left").groupBy("supplier").agg(F.count("*").alias("runs"), F.count_distinct("file_name").alias("files"))


def line_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of order lines by unit: a keg's price per litre or per keg, or by its size where the unit isn't said."""
    i = F.col("id")
    unit = F.when(i % 3 == 0, "keg").when(i % 3 == 1, "liter")
    keg = display.looks_like_keg(F.col("format_type"), F.col("volume"))
    return bound.items(s, d).select("id", display.line_total(F.floor("price"), F.lit(2), F.col("volume"), keg, unit).alias("total"), display.ibu_text(F.repeat(F.lit(" 45"), (i % 30).cast("int"))).alias("ibu"))


QUERIES = {
    "items_edited": edited,
    "items_truncated": cut_items,
    "order_form_cells": order_form,
    "csv_texts": csv_texts,
    "json_texts": json_texts,
    "run_log": runs_logged,
    "metadata_upsert": metadata_kept,
    "shadow_reports": reports,
    "page_styles": page_styles,
    "page_labels": page_labels,
    "form_texts": form_texts,
    "order_payloads": orders_checked,
    "waiting_beers": waiting_beers,
    "location_boards": location_boards,
    "runs_with_files": runs_with_files,
    "line_totals": line_totals,
}
_WITH = f"WITH {bound.ITEMS} "
_RAW = catalogue._RAW
_TEXT = r"regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
_FOUND = ", ".join(f"regexp_extract(t, '({g})', 1, 'i') AS g{n}" for n, g in enumerate(style.PAGE_STYLES))
_PICK = ", ".join(f"CASE WHEN length(g{n}) > 2 AND NOT contains(lower(beer_name), lower(g{n})) THEN g{n} END" for n in range(len(style.PAGE_STYLES)))
ORACLES = {
    "items_edited": _WITH + "SELECT id, brewery, CASE WHEN id % 10 = 3 THEN 'edited' ELSE style END AS style, CASE WHEN id % 20 = 3 THEN 1 ELSE price_cents END AS price_cents FROM items WHERE id % 10 <> 7",
    "items_truncated": _WITH + "SELECT id, least(200, (length(beer_name) + 1) * (id % 20))::INT AS name_chars, substr(repeat(format_type, 9), 1, 50) AS format_type FROM items",
    "order_form_cells": f"""WITH {bound.ITEMS}, {bound.LINES}, f AS (SELECT id AS item_id, file_id, id // 20 AS row, 2 + file_id % 3 AS head, ['D', 'E', 'D'][file_id % 3 + 1] AS col FROM items)
        SELECT order_id, file_id, 'Пиво' AS sheet, col || (row + 2) AS cell, quantity FROM lines JOIN f USING (item_id) WHERE quantity >= 45 AND row + 2 BETWEEN head + 1 AND 501""",
    "csv_texts": _WITH
    + """SELECT id, id || ',' || CASE id % 3 WHEN 0 THEN '"' || beer_name || ', a ""fine"" one"' WHEN 1 THEN '"' || beer_name ELSE '"' || beer_name || chr(10) || 'second"' END || ',' || CASE WHEN id % 4 > 0 THEN price_cents::VARCHAR ELSE '' END AS line FROM items""",
    "json_texts": _WITH + """SELECT id, '{"id":' || id || ',"brewery":"' || brewery || '","price_cents":' || CASE WHEN id % 4 > 0 THEN price_cents::VARCHAR ELSE 'null' END || '}' AS line FROM items""",
    "run_log": catalogue._ISSUES
    + """, per AS (SELECT file_id, count(DISTINCT raw.id) AS items_count, count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (severity = 'error') AS error_count FROM raw LEFT JOIN found ON found.id = raw.id GROUP BY 1)
        SELECT *, CASE WHEN error_count > 0 THEN 'partial' ELSE 'completed' END AS status, '{"items":' || items_count || ',"warnings":' || warning_count || ',"errors":' || error_count || '}' AS summary FROM per""",
    "metadata_upsert": """WITH n AS (SELECT p_partkey % 50 AS file_id, string_agg('a' || p_partkey || '@beer.example', ' ' ORDER BY p_partkey) FILTER (p_partkey % 10 = 1) AS emails, count(*) AS skipped_rows FROM part WHERE p_partkey % 10 IN (1, 2) GROUP BY 1)
        SELECT file_id, coalesce(emails, '') AS emails, skipped_rows FROM n UNION ALL SELECT i, 'old', 0 FROM range(30) r(i) WHERE i NOT IN (SELECT file_id FROM n)""",
    "shadow_reports": _RAW
    + """SELECT file_id, count(*) FILTER (id % 3 > 0) AS main_items, count(*) FILTER (id % 4 > 0) AS other_items, other_items - main_items AS delta_items,
        round(avg(b::INT) FILTER (id % 3 > 0), 4) AS main_brewery, round(avg(n::INT) FILTER (id % 4 > 0), 4) AS other_name FROM num GROUP BY 1""",
    "page_styles": f"""WITH p AS (SELECT page_id, {_TEXT} AS t, CASE WHEN page_id % 2 = 0 THEN 'Table Talk' ELSE 'Plain' END AS beer_name FROM pages), f AS (SELECT *, {_FOUND} FROM p)
        SELECT page_id, beer_name, CASE WHEN page_id % 4 = 0 THEN 'Porter' ELSE coalesce({_PICK}, CASE WHEN page_id % 4 = 1 THEN 'Wheat Beer' END) END AS style FROM f""",
    "page_labels": """SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 3 ELSE 2 END AS candidates, CASE WHEN page_id % 5 > 0 THEN 'https://assets.pics.example/site/beer_logos' || CASE WHEN page_id % 3 = 0 THEN '_hd/' ELSE '/beer-' END || page_id
        || CASE WHEN page_id % 2 = 0 THEN '_hd.jpeg' ELSE '_sm.png' END ELSE 'https://assets.pics.example/a' || page_id || '.png' END AS label FROM pages""",
    "form_texts": _WITH
    + """SELECT id, 'brewery_required' AS code FROM items WHERE id % 5 = 0 UNION ALL SELECT id, 'beer_name_required' FROM items WHERE id % 25 = 0 UNION ALL SELECT id, 'beer_name_long' FROM items WHERE length(beer_name) * (id % 25) > 200
        UNION ALL SELECT id, 'abv_number' FROM items WHERE id % 7 = 0 UNION ALL SELECT id, 'currency_length' FROM items WHERE id % 3 = 0""",
    "order_payloads": "SELECT valid, count(*) AS orders FROM (SELECT l_orderkey, bool_and(l_partkey % 50 > 0 AND l_quantity::INT - 2 > 0) AS valid FROM lineitem GROUP BY 1) GROUP BY 1",
    "waiting_beers": "SELECT s_suppkey AS tap_id, s_name AS beer_name FROM supplier WHERE s_suppkey % 7 = 4 AND s_suppkey % 3 > 0",
    "location_boards": "SELECT n_nationkey AS location_id, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS beers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "runs_with_files": f"WITH {bound.RUNS} SELECT c_mktsegment AS supplier, count(*) AS runs, count(DISTINCT c_name) AS files FROM runs LEFT JOIN customer ON c_custkey = file_id GROUP BY 1",
    "line_totals": _WITH + "SELECT id, floor(price) * 2 * CASE WHEN format_type = 'кега' AND (id % 3 = 1 OR (id % 3 = 2 AND floor(price) < 2000)) THEN volume ELSE 1 END AS total, substr(trim(repeat(' 45', (id % 30)::INT)), 1, 64) AS ibu FROM items",
}
