"""Page tables and text lines as product rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkmalt.operators import pages

GRID = "file_id string, page int, table int, row int, cells array<string>"


def grid(spark, rows, file_id="f", table=1):
    return spark.createDataFrame([(file_id, 1, table, i, r) for i, r in enumerate(rows)], GRID)


@pytest.fixture(scope="module")
def found(spark):
    two_prices = [["Прайс", None, None, None], ["Название", "Стиль", "Цена кег", "Цена фасовка"], [None, None, "кег 20л", "банка 0.33л"], ["Red Moon Barrel", "Porter", "7600р", "230р/ банка"], ["(NEW) Grey Dunes Brew", "Gose", None, "250р"], ["12.5%", "x", "1р", "2р"], ["", "", "", ""], ["LIBRA X DIETA Long Night Out", "Stout", "9000р", "-"]]
    plain = [["Old Harbour Brown", "Brown Ale", "5.5%ABV", "230р/ банка 0.33л коробка 20шт – 4600р", "в наличии"], ["Stone Pier Amber", "Amber Ale", "6%ABV", "20n 380р/л", "есть"]]
    out = pages.products(grid(spark, two_prices).union(grid(spark, plain, "g"))).collect()
    return {(r["file_id"], r["row"], r["price_column"]): r for r in out}


def test_a_row_per_price_column(found):
    assert {k for k in found if k[0] == "f"} == {("f", 3, 2), ("f", 3, 3), ("f", 4, 2), ("f", 4, 3), ("f", 7, 2)}
    keg, can = found["f", 3, 2], found["f", 3, 3]
    assert (keg["beer_name"], keg["price"], keg["format_type"], keg["volume"]) == ("Red Moon Barrel", "7600", "кег", 20.0)
    assert (can["style"], can["price"], can["format_type"], can["volume"]) == ("Porter", "230", "банка", 0.33)
    assert found["f", 4, 2]["price"] == "250" and found["f", 4, 2]["beer_name"] == "Grey Dunes Brew"  # the price beside an empty cell
    assert (found["f", 7, 2]["brewery"], found["f", 7, 2]["beer_name"]) == ("LIBRA X DIETA", "Long Night Out")


def test_without_headings(found):
    assert [r["beer_name"] for k, r in sorted(found.items(), key=str) if k[0] == "g"] == ["Stone Pier Amber"]  # the first row would be a heading's place
    r = found["g", 1, None]
    assert (r["style"], r["abv"], r["price"], r["volume"], r["stock"]) == ("Amber Ale", "6", "380", 20.0, "есть")


@pytest.mark.parametrize(
    ("headings", "want"),
    [
        (["название", "стиль", "ттх", "объём/цена кег"], {"beer_name": 0, "style": 1, "abv": 2, "price": 3, "volume": 3, "format_type": 3}),
        (["наименование пива", "пивоварня", "цена за литр"], {"beer_name": 0, "brewery": 1, "price": 2, "volume": 2}),
        (["x", ""], {}),
    ],
)
def test_heading_map(spark, headings, want):
    assert spark.createDataFrame([(headings,)], "h array<string>").select(pages.heading_map(F.col("h")).alias("m")).first()["m"] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("220p/ бажжя ( 0.45 )", ("220", "банка", 0.45)), ("aer 30n - 7600р", ("7600", "кег", 30.0)), ("4400р банка", ("4400", "банка", 0.45)), ("none here", (None, None, None)), (None, (None, None, None))],
)
def test_price_cell(spark, text, want):
    none = F.lit(None)
    got = spark.createDataFrame([(text,)], "t string").select(pages.price_cell(F.col("t"), none.cast("string"), none.cast("double")).alias("p")).first()["p"]
    assert tuple(got) == want


def test_lines_and_breweries(spark):
    lines = spark.createDataFrame([("f", "DUSK Bonfire Smoked Baltic Porter 8.5%ABV"), ("f", "just a line"), ("f", None), ("f", "x")], "file_id string, text string")
    got = pages.line_products(lines, F.lit("Dusk")).collect()
    assert [(r["beer_name"], r["style"], r["abv"], r["brewery"]) for r in got] == [("DUSK", "Bonfire Smoked Baltic Porter", "8.5", "Dusk")]
    rows = spark.createDataFrame([("f", None), ("f", "Own"), ("g", "")], "file_id string, brewery string")
    of = spark.createDataFrame([("f", "brewery", "Dusk"), ("g", "distributor", None)], "file_id string, kind string, name string")
    assert sorted((r["file_id"], r["brewery"]) for r in pages.brewery_filled(rows, of).collect() if r["brewery"]) == [("f", "Dusk"), ("f", "Own")]
