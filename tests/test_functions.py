"""Column functions, row rules and readers on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkmalt.functions import contacts, display, normalize, packaging, style, text
from sparkmalt.operators import changes, classify, dedup, extract, quality
from sparkmalt.plans import boards, ingest, orders
from sparkmalt.sources import files, xlsx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("150 руб (0,5 л)", (150.0, "RUB", 0.5)), ("1 200", (1.0, "RUB", None)), ("€5", (5.0, "EUR", None)), ("нет", (None, None, None)), (None, (None, None, None)), ("5 евро", (5.0, "RUB", None))],
)
def test_price(spark, given, want):
    assert tuple(one(spark, normalize.price(F.lit(given).cast("string")))) == want


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (normalize.abv, "5,2%", 5.2),
        (normalize.abv, None, None),
        (normalize.volume, "500 мл", 0.5),
        (normalize.volume, "12 шт", None),
        (normalize.volume, "0.75", 0.75),
        (normalize.currency, "usd", "USD"),
        (normalize.currency, "RUB", "RUB"),
        (normalize.packaging, "Keg", "кега"),
        (normalize.packaging, "кег", "кег"),
        (normalize.brewery, "4 Brewers г. Владимир", "4 Brewers"),
        (normalize.brewery, "Москва", ""),
        (normalize.brewery, None, ""),
        (packaging.litres, "кег 30 л", 30.0),
        (text.null_if_empty, "н/д", None),
        (text.null_if_empty, " x ", "x"),
        (display.export_format, "Бутылка 0.5", "бут"),
    ],
)
def test_scalars(spark, function, given, want):
    assert one(spark, function(F.lit(given).cast("string"))) == want


def test_split_brewery(spark):
    got = one(spark, normalize.split_brewery(F.lit("Foo - Bar Baz"), F.lit(None).cast("string")))
    assert tuple(got) == ("Foo", "Bar Baz")
    assert tuple(one(spark, normalize.split_brewery(F.lit("4Foo - Bar"), F.lit("")))) == ("", "4Foo - Bar")
    assert tuple(one(spark, normalize.split_brewery(F.lit("Foo - Bar"), F.lit("Own")))) == ("Own", "Foo - Bar")


def test_kegs(spark):
    cases = [("", 15.0, True), ("банка", 30.0, False), ("KEG", 1.0, True), (None, None, False)]
    for form, volume, want in cases:
        assert one(spark, display.looks_like_keg(F.lit(form).cast("string"), F.lit(volume).cast("double"))) is want


def test_contacts(spark):
    got = one(spark, contacts.contacts(F.lit("ул. Мира 5, тел +7 495 123-45-67, a.b@c.ru www.x.ru")))
    assert got["emails"] == ["a.b@c.ru"] and got["addresses"] == ["ул. Мира 5"] and "www.x.ru" in got["links"] and got["phones"]


def test_rows_that_are_no_products(spark):
    schema = "brewery string, beer_name string, price string, style string"
    rows = [("B", None, None, None, False), (None, "Название", "100", None, False), (None, "AB", "100", None, False), ("B", "Beer", None, None, True), (None, None, "5", None, True), (None, None, None, None, False)]
    df = spark.createDataFrame([r[:4] for r in rows], schema)
    assert [r["is_product"] for r in classify.classified(df).collect()] == [r[4] for r in rows]


def test_validation(spark):
    rows = [("N", "B", "100001", None, ["price_high"]), ("N", "B", "-1", None, ["price_negative"]), ("N", "B", "10", "1", ["per_litre_low"]), ("N", "B", "abc", None, ["price_invalid"]), (None, None, None, None, ["name_and_brewery_missing"])]
    df = spark.createDataFrame([r[:4] for r in rows], "beer_name string, brewery string, price string, volume string")
    got = quality.validated(df).collect()
    assert [[x["code"] for x in r["issues"]] for r in got] == [r[4] for r in rows]
    assert [r["is_valid"] for r in got] == [True, False, True, False, True]
    assert quality.totals(quality.validated(df.limit(0))).first()["total"] == 0


def test_change_types(spark):
    cases = [((None, None, None), ("A", "x", 1), "installed"), (("A", "x", 1), ("", "", None), "removed"), (("A", "x", 100), ("A", "x", 120), "price_changed"), (("A", "x", 1), ("B", "y", 1), "installed"), (("A", "x", None), ("A", "x", 0), "updated"), (("A", "x", 1), ("A", "x", 1), None)]
    for old, new, want in cases:
        state = lambda s: (F.lit(s[0]).cast("string"), F.lit(s[1]).cast("string"), F.lit(s[2]).cast("long"))
        assert one(spark, changes.change_type(state(old), state(new))) == want


def test_dedup(spark):
    rows = [(1, "Foo", "A (NEW)", "IPA", "can", 5.0, "text"), (2, "foo", "a", "ipa", "CAN", 5.0, "longer text"), (3, "foo", "a (Fresh brewed)", "ipa", "can", 5.0, "the longest text of all")]
    df = spark.createDataFrame(rows, "id long, brewery string, beer_name string, style string, format_type string, price double, description string")
    got = dedup.deduplicated(df, "id").collect()
    assert [(r["id"], r["copies"]) for r in got] == [(2, 3)]
    assert dedup.deduplicated(df.limit(0), "id").count() == 0


def test_order_lines(spark):
    lines = spark.createDataFrame([(1, 1, 7, 2, None), (1, 2, 9, 1, 50)], "order_id long, line_no int, item_id long, quantity long, price_cents long")
    items = spark.createDataFrame([(7, "Seven", 300)], "id long, beer_name string, price_cents long")
    orders_ = spark.createDataFrame([(1,), (2,)], "order_id long")
    got = orders.statistics(orders_, orders.resolved(lines, items)).first()
    assert (got["total_orders"], got["total_sum"], got["total_positions"], got["average"]) == (2, 6.5, 3, 3.25)
    empty = orders.statistics(orders_.limit(0), lines.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0, 0.0)
    assert {r["item_name"] for r in orders.resolved(lines, items).collect()} == {"Seven", "ID 9"}
    assert {r["item_id"] for r in orders.missing_items(lines, items).collect()} == {9}


def test_payload_and_permutation(spark):
    ok = "array(named_struct('item_id', 1L, 'quantity', 2), named_struct('item_id', 2L, 'quantity', {}))"
    assert one(spark, quality.order_lines_valid(F.expr(ok.format("1")))) is True
    assert one(spark, quality.order_lines_valid(F.expr(ok.format("0")))) is False
    assert one(spark, quality.is_permutation(F.array(F.lit(2), F.lit(1)), F.array(F.lit(1), F.lit(2)))) is True
    assert one(spark, quality.is_permutation(F.array(F.lit(2), F.lit(2)), F.array(F.lit(1), F.lit(2)))) is False


def test_queue(spark):
    df = spark.createDataFrame([("A", "a", 1.0, "B | b(2,5)", None), ("A", "a", 1.0, "", "C | c")], "brewery string, beer_name string, price double, next_beer_1 string, next_beer_2 string")
    got = changes.queue_shifted(df).collect()
    assert tuple(got[0])[:3] == ("B", "b", 2.5) and tuple(got[1])[:3] == ("A", "a", 1.0)


def test_layout(spark):
    df = spark.range(7).select(F.lit(1).alias("location_id"), F.col("id").alias("tap_id"), (F.col("id") + 1).alias("position"))
    got = {r["tap_id"]: (r["board_column"], r["board_row"]) for r in boards.layout(df).collect()}
    assert got[0] == (0, 0) and got[2] == (0, 2) and got[3] == (1, 0) and got[6] == (2, 0)


def test_workbook(spark):
    rows = [["Менеджер: Иван +7 495 123-45-67"], [], ["Пивоварня", "Название", "Цена", "Объем", "Тип тары"], ["Brew", "Stout One", "200", "0,5", "банка"], ["", "Gose Two", "250", "", "can"], ["", "Hidden", "1", "1", "can"]]
    book = spark.createDataFrame([("f", bytearray(xlsx.workbook({"Прайс": rows, "Контакты": [["x"]]}, hidden=(5,)))), ("bad", bytearray(b"no workbook"))], "file_id string, content binary")
    cells = xlsx.cells_of(book)
    got = {r["beer_name"]: r for r in ingest.items(cells).collect()}
    assert set(got) == {"Stout One", "Gose Two"}
    assert got["Gose Two"]["brewery"] == "Brew" and got["Gose Two"]["volume"] == 0.45 and got["Stout One"]["volume"] == 0.5
    assert got["Stout One"]["style"] == "Stout" and got["Gose Two"]["style"] == "Gose"


def test_zip_and_replace(spark, tmp_path):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.xlsx", b"1")
        z.writestr("__MACOSX/a.xlsx", b"2")
    df = spark.createDataFrame([("z", bytearray(raw.getvalue())), ("bad", bytearray(b"x"))], "file_id string, content binary")
    assert [(r["file_id"], bytes(r["content"])) for r in files.members(df).collect()] == [("a.xlsx", b"1")]
    out = str(tmp_path / "items")
    files.replace_files(spark.createDataFrame([(1, "a"), (2, "b")], "n int, file_id string"), out)
    files.replace_files(spark.createDataFrame([(3, "a")], "n int, file_id string"), out)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [2, 3]


def test_sessions_and_fill(spark):
    df = spark.createDataFrame([("f", "s", i, b) for i, b in enumerate([None, "A", "", None, "B"])], "file_id string, sheet string, row_idx int, brewery string")
    assert [r["brewery"] for r in extract.forward_filled(df).orderBy("row_idx").collect()] == [None, "A", "A", "A", "B"]


def test_a_city_alone_stays_the_brewery(spark):
    """what the city rules would leave empty is restored."""
    df = spark.createDataFrame([("Москва", "a"), ("Alt г. Москва", "b"), ("Alt", "c")], "brewery string, beer_name string").withColumns({c: F.lit(None).cast("string") for c in ("abv", "price", "volume", "format_type")})
    got = {r["beer_name"]: r["brewery"] for r in normalize.normalized(df).collect()}
    assert got == {"a": "Москва", "b": "Alt", "c": "Alt"}


def test_a_price_heading_is_no_stock(spark):
    """E8."""
    df = spark.createDataFrame([("Цена банка", "a"), ("12", "b"), (None, "c")], "stock string, beer_name string").withColumns({c: F.lit(None).cast("string") for c in ("brewery", "style", "abv", "ibu", "price", "volume", "format_type", "description")})
    assert {r["beer_name"]: r["stock"] for r in extract.split_cells(df).collect()} == {"a": None, "b": "12", "c": None}


def test_style_from_json_of_a_page(spark):
    """Every JSON object of a page is read, in order; what is nothing, lists and broken ones are passed over."""
    script = lambda *texts: "".join(f'<script type="application/ld+json">{t}</script>' for t in texts)
    pages = {
        "second": script('{"genre": "Brewery"}', '{"category": " Hazy Sour "}'),
        "falsy": script('{"genre": "", "category": [], "keywords": "Amber Ale"}'),
        "broken": script("{genre: Stout", '[{"genre": "Porter"}]', "", '{"keywords": "Lager"}'),
        "masked": script('{"genre": "Food", "category": "IPA"}'),
        "none": "<p>text</p>",
    }
    df = spark.createDataFrame([*pages.items(), ("null", None)], "k string, html string")
    got = {r["k"]: r["s"] for r in df.select("k", style.page_style(F.col("html"), F.lit("x")).alias("s")).collect()}
    assert got == {"second": "Hazy Sour", "falsy": "Amber Ale", "broken": "Lager", "masked": None, "none": None, "null": None}
