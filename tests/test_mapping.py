"""Header scores, content scores, column rules and assignment, on sheets made for each case."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sparkmalt.functions.numbers import counted
from sparkmalt.operators import headers, mapping, rules
from sparkmalt.plans import sheets
from sparkmalt.sources import registry
from sparkmalt.sources.shared import written

CELLS = "file_id string, sheet string, row_idx int, col_idx int, value string"


def cells(spark, books):
    """Cells of sheets given as lists of rows, by file."""
    return spark.createDataFrame([(f, "s", r, c, v) for f, rows in books.items() for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None], CELLS)


def chosen(spark, rows, keywords=None, weights=None):
    heads = spark.createDataFrame([("f", "s", 0)], "file_id string, sheet string, header_row int")
    found = mapping.candidates(cells(spark, {"f": rows}), heads, keywords, weights)
    return {r["field"]: r["col_idx"] for r in mapping.assigned(found).collect()}


def test_scores_by_kind_of_match(spark):
    """Equal, containing, contained and alike words, against the plain rules; weights multiply."""
    words = {"stock": ["ladenbestand"], "style": ["sorte"]}
    heads = ["Ladenbestand", "Ladenbestand Mai", "bestand", "Ladenbestant", "Xyz", "Sorte / Ladenbestand"]
    df = spark.createDataFrame([(h,) for h in heads], "header string")
    got = {(r["header"], r["field"]): r["header_score"] for r in mapping.header_scores(df, words, {"stock": 2.0}).collect()}
    alike = 4.0 * SequenceMatcher(None, "ladenbestand", "ladenbestant").ratio()
    assert [got[h, "stock"] for h in heads] == pytest.approx([20.0, 12.0, 6.0, 2 * alike, 0.0, 12.0])
    assert got["Sorte / Ladenbestand", "style"] == 6.0


def test_every_part_has_its_heading_scored(spark, tmp_path):
    """Against plain ratios of all headings and words."""
    parts = [(k, ["cold widget", "Small bolt", "s", "", None][k % 5]) for k in range(80)] + [(3, "cold widget"), (None, "no key")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for k, name in parts:
        if k is None:
            continue
        name = name or ""
        head = sheets.MISSPELT[k % 6] + name[: k // 6 % (len(name) + 1)]
        h = " ".join(head.lower().split())
        for field, found in registry.FIELDS.items():
            best = 0.0
            for w in map(mapping.heading_text, found):
                ratio = SequenceMatcher(None, w, h).ratio()
                best = max(best, 10.0 if w == h else 6.0 if w in h else 3.0 if h in w else 4.0 * ratio if ratio >= 0.82 else 0.0)
            best -= sum(6.0 for x in mapping.LOWER.get(field, []) if x in h)
            best += sum(2.0 for x in mapping.RAISE.get(field, []) if x in h)
            want[head, field] = max(best, 0.0)
    got = sheets.QUERIES["fuzzy_header_scores"](spark, str(tmp_path)).collect()
    assert {(r["header"], r["field"]): r["header_score"] for r in got} == pytest.approx(want)
    assert len(got) == len(want) and len({r["header"] for r in got}) > 30
    assert sum(0 < s < 4 and s != 3 for s in want.values()) > 5


def test_locks_and_ties(spark):
    """A column named beyond doubt is kept for its field; 'OG' and service columns go to none; of equal totals the left one wins."""
    rows = [["Остаток", "OG", "Сайт", "Остаток на складе", "Wert", "Wert"], *[[str(n), "12", "x", str(n), "a", "a"] for n in (3, 4, 5)]]
    got = chosen(spark, rows, {"stock": ["остаток"], "currency": ["wert", "og", "сайт"]})
    assert got == {"stock": 0, "currency": 4}
    assert chosen(spark, [["Wert", "Wert"], ["a", "a"]], {"currency": ["wert"], "style": ["wert"]}) == {"currency": 0, "style": 1}


def test_matching_is_the_best_and_ties_go_left():
    """Against all matchings of small tables: greatest sum, then the smallest columns, row by row."""
    draw = random.Random(1)
    for _ in range(400):
        n, m = draw.randint(0, 4), draw.randint(1, 4)
        w = [[draw.choice([0, 0, 1, 2, 3, 2.5, -1]) for _ in range(m)] for _ in range(n)]
        ways = [c for c in itertools.product([*range(m), m], repeat=n) if len({x for x in c if x < m}) == sum(x < m for x in c) and all(x == m or w[i][x] > 0 for i, x in enumerate(c))]
        best = min(ways, key=lambda c: (-sum(w[i][x] for i, x in enumerate(c) if x < m), c))
        assert mapping.matched(w) == [x if x < m else -1 for x in best]


def test_matching_beats_the_greedy_choice(spark):
    """The greatest single score would leave the other field nothing; both get a column that fits."""
    scored = [("f", "s", 0, "Spalte A", "price", 0, 0.0, False, 9.0), ("f", "s", 0, "Spalte A", "abv", 1, 0.0, False, 10.0), ("f", "s", 1, "Spalte B", "abv", 1, 0.0, False, 8.0)]
    df = spark.createDataFrame(scored, "file_id string, sheet string, col_idx int, header string, field string, field_order int, header_score double, exact boolean, content_score double")
    assert {r["field"]: r["col_idx"] for r in mapping.assigned(df).collect()} == {"price": 0, "abv": 1}
    ruled = spark.createDataFrame([("f", "s", "abv", 0)], "file_id string, sheet string, field string, col_idx int")
    assert {r["field"]: r["col_idx"] for r in mapping.assigned(df.where("col_idx = 0"), ruled).collect()} == {"abv": 0}


def test_an_exact_heading_wins_over_contents(spark):
    """Names that end in small numbers look like strengths, and names of digits alone like bitterness; their heading says what they are."""
    for names in ([f"Kellerbier {i}" for i in range(6)], [f"{i}" for i in range(6)], [f"Lot {i}%" for i in range(6)]):
        rows = [["Пивоварня", "Название", "Стиль", "Цена"], *[["Alt", x, "lager", str(200 + i)] for i, x in enumerate(names)]]
        got = chosen(spark, rows)
        assert (got["brewery"], got["beer_name"], got["price"]) == (0, 1, 3) and got.get("abv") is None


@pytest.mark.parametrize(("text", "number"), [("4,5%", 4.5), ("0,5 л", 0.5), ("200 руб", 200.0), ("от 5", 5.0), ("№ 7", 7.0), ("1 234", 1234.0), ("Kellerbier 4", None), ("5 Elements Stout", None), ("", None), (None, None), ("rot", None)])
def test_counted(spark, text, number):
    assert spark.createDataFrame([(text,)], "x string").select(counted(F.col("x")).alias("x")).first()["x"] == number


def test_contents_decide_where_headings_say_little(spark):
    rows = [["Spalte A", "Spalte B", "Spalte C"], *[[f"{p}", f"Kellerbier vom {x} Fass aus dem tiefen kühlen Keller", f"{a},5%"] for p, a, x in [(310, 4, "roten"), (95, 5, "blauen"), (1200, 6, "alten"), (640, 7, "neuen")]]]
    got = chosen(spark, rows, registry.FIELDS)
    assert (got["price"], got["beer_name"], got["abv"]) == (0, 1, 2)


@pytest.mark.parametrize(
    ("field", "values", "other"),
    [("volume", ["0,5", "0,33", "0,75"], "price"), ("stock", ["много", "нет", "мало"], "volume"), ("format_type", ["кег", "банка", "кег"], "abv"), ("description", ["Ein langer Text, der von Hopfen, Malz und Hefe erzählt und gar kein Ende nehmen will, wie lange auch immer"] * 2, "style"), ("style", ["porter", "gose", "ipa"], "price"), ("ibu", ["35", "110", "60"], "abv")],
)
def test_content_scores(spark, field, values, other):
    row = mapping.content_scored(spark.createDataFrame([(values,)], "values array<string>")).first()
    assert row[f"s_{field}"] >= 5 > row[f"s_{other}"]


def test_content_of_nothing(spark):
    assert set(mapping.content_scored(spark.createDataFrame([([],)], "values array<string>")).first()) == {0.0}


def test_layers(spark):
    told = [("supplier", "volume", " Liter "), ("global", "volume", "liter"), ("manual", "style", "sorte"), ("registry", "abv", "abv")]
    got = {r["field"]: (r["keywords"], r["weight"]) for r in registry.merged_layers(spark.createDataFrame(told, "layer string, field string, keyword string")).collect()}
    assert got == {"volume": (["liter"], 1.35), "style": (["sorte"], 1.5), "abv": (["abv"], 1.0)}


def test_candidates_by_rank(spark):
    heads = spark.createDataFrame([("f", "s", 0)], "file_id string, sheet string, header_row int")
    found = mapping.candidates(cells(spark, {"f": [["Цена", "Цена за шт", "Сорт"], ["1", "2", "x"]]}), heads, {"price": ["цена"], "style": ["сорт"]})
    got = {(r["field"], r["rank"]): (r["col_idx"], r["score"], r["confidence"]) for r in mapping.top_candidates(found).collect()}
    assert got == {("price", 1): (0, 10.0, 10.0), ("price", 2): (1, 6.0, 10.0), ("style", 1): (2, 10.0, 10.0)}


def test_no_headings(spark):
    assert mapping.header_scores(spark.createDataFrame([], "header string")).count() == 0
    assert spark.range(1).select(mapping.locked_field(F.lit(None).cast("string")).alias("x")).first()["x"] is None


BOOKS = {
    "late": [["Телефон +7 495 000-00-00"], ["с 1 мая"], ["Название", "Стиль", "Цена"], ["Kellerbier", "lager", "200"]],
    "none": [["Kellerbier vom Fass", "310"], ["Rauchbier vom Fass", "95"], ["Zwickl vom Fass", "400"]],
    "plain": [["Ding", "Wert"], ["Kellerbier vom Fass", "310"], ["Rauchbier vom Fass", "95"]],
}


def test_heading_rows(spark):
    got = {r["file_id"]: r["header_row"] for r in headers.found(cells(spark, BOOKS)).collect()}
    assert got == {"late": 2, "none": -1, "plain": 0}


def ruled(spark, books, heads=None):
    df = cells(spark, books)
    rows = spark.createDataFrame([(f, "s", (heads or {}).get(f, 0)) for f in books], "file_id string, sheet string, header_row int")
    return {r["file_id"]: r for r in rules.mapped(rules.profiles(df, rows)).collect()}


def test_rules(spark):
    names = [f"Kellerbier vom Fass, Lot {i}" for i in range(4)]
    books = {
        "codes": [["ЕГАИС", "Название", "Цена"], *[[f"Эль-{i}", n, "120"] for i, n in enumerate(names)]],
        "bare": [[n, "120"] for n in names],
        "packs": [["Наименование", "Остаток", "Цена"], *[[n, "кег", "120"] for n in names]],
        "same": [["Наименование", "Остаток", "Цена"], *[[n, str(120 + i), str(120 + i)] for i, n in enumerate(names)]],
        "swapped": [["Наименование", "Цена", "Наличие формат", "Тара"], *[[n, "120", "много", "кег"] for n in names]],
    }
    got = {f: r["mapping"] for f, r in ruled(spark, books, {"bare": -1}).items()}
    assert got["codes"]["beer_name"] == 1 and got["codes"]["price"] == 2
    assert (got["bare"]["beer_name"], got["bare"]["price"]) == (0, 1)
    assert got["packs"]["format_type"] == 1 and "stock" not in got["packs"]
    assert got["same"]["price"] == 2 and "stock" not in got["same"]
    assert got["swapped"]["format_type"] == 3 and got["swapped"]["stock"] == 2


def test_own_mapping_wins(spark):
    df = cells(spark, {"f": [["Название", "Цена"], ["Kellerbier vom Fass", "120"]]})
    seen = rules.profiles(df, headers.found(df)).withColumn("own", F.create_map(F.lit("beer_name"), F.lit(1)))
    assert rules.mapped(seen, "own").first()["mapping"]["beer_name"] == 1


def test_supplier_kinds(spark):
    rng = random.Random(3)
    books = {
        "many": [["Пивоварня", "Цена"], *[[x, "1"] for x in ("Alt", "Neu", "Alt")]],
        "one": [["Пивоварня", "Цена"], *[["Alt", "1"]] * 3],
        "named": [["Название", "Цена"], *[[f'"Dusk" Bier Nummer {rng.randrange(99)}', "1"] for _ in range(3)]],
        "Brewery Fox.xlsx": [["Название", "Цена"], *[[f"{x} ein Bier im Fass", "1"] for x in ("rot", "blau")]],
        "x/Каталог.xlsx": [["Название", "Цена"], *[[f"{x} ein Bier im Fass", "1"] for x in ("rot", "blau")]],
    }
    got = {f: (r["supplier"]["kind"], r["supplier"]["name"]) for f, r in ruled(spark, books).items()}
    assert got == {"many": ("distributor", None), "one": ("brewery", "Alt"), "named": ("brewery", "Dusk"), "Brewery Fox.xlsx": ("brewery", None), "x/Каталог.xlsx": ("distributor", None)}


def test_contents_are_the_last_guess(spark):
    """Numbers whose largest is no price: by position there is nothing, by the first rows a price and, beside brewery words, a name."""
    books = {"n": [["500"], ["20000"], ["700"]], "both": [["500", "Two Foxes brewery"], ["20000", "Owl brewery"], ["700", "Elk brewery"]]}
    heads = spark.createDataFrame([(f, "s", -1) for f in books], "file_id string, sheet string, header_row int")
    seen = rules.profiles(cells(spark, books), heads)
    got = {r["file_id"]: (r["a"], r["b"]) for r in seen.select("file_id", rules.guessed(F.col("columns")).alias("a"), rules.guessed_by_content(F.col("columns")).alias("b")).collect()}
    assert got == {"n": ({}, {"price": 0}), "both": ({"brewery": 1}, {"price": 0, "brewery": 1})}
    assert {r["file_id"]: r["mapping"]["price"] for r in rules.mapped(seen).collect()} == {"n": 0, "both": 0}


def test_cells_are_not_broadcast(spark, tmp_path):
    """Sizes are guessed from packed files, so cells may pass for the small side; no join with heading rows may send a side whole to the driver."""
    cells = spark.createDataFrame([("a", "s", r, c, v) for r in range(3) for c, v in enumerate(["Цена", "Название"] if r == 0 else ["100", "Lot"])], "file_id string, sheet string, row_idx int, col_idx int, value string")
    cells.write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    heads = spark.createDataFrame([("a", "s", 0)], "file_id string, sheet string, header_row int")
    for made in (mapping.samples(cells, heads), rules.profiles(cells, heads)):
        assert "Broadcast" not in made._jdf.queryExecution().sparkPlan().toString()


def test_scores_of_contents_are_not_broadcast(spark, tmp_path):
    """There is a row of them for every column of every sheet; what a heading locks is told once for a column, not once for each field."""
    sheet = [["Цена", "Название"], ["100", "Lot one"], ["200", "Lot two"]]
    cells(spark, {"f": sheet}).write.parquet(str(tmp_path / "cells"))
    found = mapping.candidates(spark.read.parquet(str(tmp_path / "cells")), spark.createDataFrame([("f", "s", 0)], "file_id string, sheet string, header_row int"))
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "file_id" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
    assert {(r["header"], r["locked"]) for r in found.select("header", "locked").collect()} == {("Цена", "price"), ("Название", None)}
    assert {r["field"]: r["col_idx"] for r in mapping.assigned(found).collect()} == {"price": 0, "beer_name": 1}


def test_profiles_are_made_in_parts_of_bounded_size(spark):
    """Cells that pack well are still dealt to tasks by their number, and every sheet is whole."""
    n, width = F.col("id"), 20
    row = ((n % 400) / width).cast("int")
    value = F.when(row == 0, "Цена").otherwise(F.concat(F.lit("text "), row.cast("string")))
    cells = written(spark.range(1000 * 400).select(F.format_string("f%d", F.floor(n / 400)).alias("file_id"), F.lit("s").alias("sheet"), row.alias("row_idx"), (n % width).cast("int").alias("col_idx"), value.alias("value")), "many-cells")
    heads = cells.select("file_id", "sheet").distinct().withColumn("header_row", F.lit(0))
    seen = rules.profiles(cells, heads).select(F.spark_partition_id().alias("part"), F.size("columns").alias("n"), *[F.col("columns")[3][c].alias(c) for c in ("header", "priced", "values")]).collect()
    assert len(seen) == 1000 and {(r["n"], r["header"], r["priced"]) for r in seen} == {(width, "цена", 19)}
    assert {tuple(r["values"]) for r in seen} == {tuple(f"text {i}" for i in range(1, 11))}
    assert max(Counter(r["part"] for r in seen).values()) * 400 <= 1.5 * (1 << 17)
