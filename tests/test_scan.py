"""Scans across blocks against plain windows, and how far a large key spreads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkmalt.operators import repair, scan
from sparkmalt.plans import boards, bound, ingest
from tests.test_mapping import cells

def wanted() -> dict:
    return {"carry": {"last_x": F.col("x"), "x": F.upper(F.col("x"))}, "before": {"old_x": F.col("x"), "old_n": F.col("n")}, "place": "place", "total": "total"}


def test_blocks_give_what_windows_give(spark):
    """Keys of two columns with nulls, one key with most rows, null order values, columns that are replaced."""
    draw = random.Random(2)
    data = [("big" if draw.random() < 0.7 else draw.choice(["a", None, "c"]), draw.choice([1, None]), None if i % 97 == 5 else i, draw.choice([None, None, "x", "y", f"v{i}"]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, l int, at int, x string, n int").repartition(5)
    run = lambda crowded: sorted(map(str, scan.scanned(df, ["k", "l"], ["at", "n"], most=100, crowded=crowded, **wanted()).collect()))
    plain = run(False)
    assert run(True) == plain and run(None) == plain and len(plain) == len(data)
    for wants in ({"place": "p"}, {"total": "t"}, {"carry": {"c": F.col("x")}}, {"before": {"b": F.struct("x", "n")}}):
        a, b = (sorted(map(str, scan.scanned(df, ["k"], ["at", "n"], most=100, crowded=c, **wants).collect())) for c in (False, True))
        assert a == b


def test_nothing_to_scan(spark):
    df = spark.createDataFrame([], "k string, l int, at int, x string, n int")
    assert scan.scanned(df, ["k", "l"], ["at"], **wanted()).collect() == []
    assert scan.scanned(df, ["k", "l"], ["at"], crowded=True, **wanted()).collect() == []
    assert scan.sizes(df, ["k"]) == (0, 0)


def test_a_large_key_is_no_single_task(spark):
    """A sheet of a million rows: no task has more than a fourth of them, and every value is the last one given above."""
    df = spark.range(1_000_000).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 1_000_000).alias("at")).withColumn("x", F.when(F.col("at") % 1000 == 1, F.col("at")))
    out = scan.scanned(df, ["k"], ["at"], carry={"last": F.col("x")}, place="place", most=50_000)
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 400_000
    want = F.floor((F.col("at") - 1) / 1000) * 1000 + 1
    assert out.where((F.col("place") != F.col("at") + 1) | ~F.col("last").eqNullSafe(F.when(F.col("at") > 0, want))).count() == 0


@pytest.mark.parametrize("most", [3, 10_000])
def test_changes_and_layout_at_any_size(spark, most):
    sf = "/root/testdata/sf0.001"
    plain, found = boards.taps(spark, sf), boards.taps(spark, sf, most)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, boards.layout(found, most=most).collect())) == sorted(map(str, boards.layout(plain).collect()))
    states = bound.tap_states(spark, sf).withColumn("tap_id", F.col("tap_id") % 3)
    logs = [sorted(map(str, boards.changes.change_log(states, ["tap_id"], ["created_at", "state_id"], most=m).collect())) for m in (most, scan.MOST)]
    assert logs[0] == logs[1] and logs[0]


def test_doubtful_breweries_of_a_large_file(spark):
    """R4: breweries that are long and nearly all different are names, where the name is missing; a file with two breweries keeps them."""
    long = [("f", f"Very Old Amber Ale {i}", None if i % 2 else "Lot", None, None) for i in range(12)]
    rows = spark.createDataFrame([*long, *[("g", f"House {i % 2}", None, None, None) for i in range(12)], (None, None, None, None, None)], "file_id string, brewery string, beer_name string, description string, style string")
    a, b = (sorted(map(str, repair.repaired(rows, crowded=c).collect())) for c in (False, True))
    assert a == b
    moved = {r["beer_name"] for r in repair.repaired(rows).where("file_id = 'f'").collect()}
    assert "Very Old Amber Ale 1" in moved and "Lot" in moved
    assert {r["brewery"] for r in repair.repaired(rows).where("file_id = 'g'").collect()} == {"House 0", "House 1"}


def test_items_of_a_sheet_in_blocks(spark):
    """A list whose breweries stand above their rows and whose packaging rows follow their beers, in blocks of four rows and whole."""
    rows = [["Пивоварня", "Название", "Стиль", "Цена", "Объем", "Тип тары"]]
    for i in range(20):
        rows.append([f"Haus {i // 7}" if i % 7 == 0 else None, "кег 30 л" if i % 5 == 4 else f"Kellerbier rot {i}", None if i % 5 == 4 else "lager", str(200 + i), "30 л", "кег"])
    looks = {"hidden": F.lit(False), "strike": F.lit(False), "font_rgb": F.lit(None).cast("string")}
    df = cells(spark, {"f": rows, "g": rows[:5]}).withColumns(looks)
    fields = ["file_id", "row_idx", "brewery", "beer_name", "style", "price", "volume", "format_type"]
    a, b = (sorted(map(str, ingest.items(df, most=m).select(*fields).collect())) for m in (4, scan.MOST))
    assert a == b and len(a) == 24 and any("Haus 2" in x for x in a)
