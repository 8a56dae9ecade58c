"""Searches by posting lists against plain tests of every row."""

from __future__ import annotations

import random

import pytest
from sparkmalt.sources import postings
from sparkmalt.sources.shared import fresh

FIELDS, BUCKETS = ["name", "brewery"], 5
ASKED = [
    [],
    [("name", "contains", "")],
    [("name", "contains", "ab")],
    [("name", "contains", "abca")],
    [("name", "contains", "ABCA"), ("brewery", "starts_with", "ба")],
    [("name", "starts_with", "cab"), ("name", "ends_with", "bca")],
    [("brewery", "equals", "бабб")],
    [("name", "contains", "\n😀a")],
    [("name", "contains", "%_x")],
    [("name", "contains", "zzz")],
    [("name", "contains", "aaaa" * 12)],
]


def plain(row: tuple, asked: list) -> bool:
    test = {"contains": str.__contains__, "equals": str.__eq__, "starts_with": str.startswith, "ends_with": str.endswith}
    texts = dict(zip(FIELDS, row[1:]))
    return all(test[mode]((texts[field] or "").lower(), text.lower()) for field, mode, text in asked)


@pytest.fixture(scope="module")
def data() -> list[tuple]:
    """Random texts, with null and empty ones, a very long one, repeated keys and rows, null and negative keys."""
    pick = random.Random(5)
    texts = lambda signs, most: None if pick.random() < 0.05 else "".join(pick.choices(signs, k=pick.randrange(most)))
    rows = [(pick.choice([None, -3, -20]) if i % 29 == 0 else i - i % 3 // 2, texts("abcABC", 12), texts("абБ", 6)) for i in range(600)]
    return [*rows, *rows[:20], (7, "x\n😀abca", ""), (9001, "5%_x", "баб"), (9002, "a" * 200_000, "баб")]


@pytest.fixture(scope="module")
def index(spark, data) -> str:
    path = fresh(spark, "index")
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string, brewery string")
    postings.stored(frame(data[:400]), path, FIELDS, width=50, buckets=BUCKETS)
    postings.stored(frame(data[400:]), path, FIELDS, width=50, mode="append")
    return path


@pytest.mark.parametrize("asked", ASKED, ids=str)
@pytest.mark.parametrize("dense", [8, 0])  # 0: posting lists are used however long they are
def test_found(spark, data, index, asked, dense, monkeypatch):
    monkeypatch.setattr(postings, "DENSE", dense)
    order = lambda rows: sorted(rows, key=repr)
    got = [(r["id"], r["name"], r["brewery"]) for r in postings.found(spark, index, asked).collect()]
    assert order(got) == order([r for r in data if plain(r, asked)])


def test_only_folders_with_candidates(spark, data, index, capsys):
    lists = postings.chosen(spark, index, [("name", "contains", "5%_x"), ("brewery", "contains", "баб")], BUCKETS)
    assert [g for _, g, _ in lists][:2] == ["%_x", "5%_"] and all(n <= postings.SPREAD for _, _, n in lists)
    hits = postings.candidates(spark, index, lists, postings.kept_schema(spark, index)["id"].dataType, BUCKETS)
    assert postings.folders(hits) == [9001 // 50]
    postings.found(spark, index, [("name", "contains", "5%_x")]).explain("formatted")
    scan = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters") and postings.RANGE in line)
    assert "rows_range#" in scan and " = 180" in scan.replace("IN (180)", "= 180")
    hits.explain("formatted")
    assert "bucket" in capsys.readouterr().out.split("PartitionFilters:")[1].splitlines()[0]
    assert postings.chosen(spark, index, [("name", "contains", "abc"), ("name", "contains", "qqq")], BUCKETS) == []
    assert postings.chosen(spark, index, [("name", "contains", "ab")], BUCKETS) is None


def test_many_folders(spark, data, index, monkeypatch):
    monkeypatch.setattr(postings, "MOST_FOLDERS", 1)
    monkeypatch.setattr(postings, "DENSE", 0)
    asked = [("name", "contains", "abca")]
    assert postings.found(spark, index, asked).count() == sum(plain(r, asked) for r in data)


def test_empty_table(spark):
    path = fresh(spark, "index")
    postings.stored(spark.createDataFrame([], "id long, name string, brewery string"), path, FIELDS)
    assert postings.found(spark, path, [("name", "contains", "abc")]).count() == 0
    assert postings.found(spark, path, []).count() == 0
