"""Readers, sinks and the stream of workbooks."""

from __future__ import annotations

import io
import random
import re
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkmalt import streaming
from sparkmalt.operators import changes
from sparkmalt.plans import ingest
from sparkmalt.sources import files, keyed, sinks, xlsx

HEAD = ["Пивоварня", "Название", "Стиль", "Цена", "Объем", "Тип тары"]
ROWS = [["Alt", f"Kellerbier {i}", "lager", 200 + i, "0,5 л", "банка"] for i in range(5)] + [["Neu", "Rauchbier", "ale", 310, "20 л", "кег"]]


def bare_places(book):
    """The workbook without the places of its rows and cells, which a file may leave out."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            raw = a.read(name).decode()
            b.writestr(name, re.sub(r'<(row|c) r="[^"]*"', r"<\1", raw) if "worksheets" in name else raw)
    return out.getvalue()


def without(book, part):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            if part not in name:
                b.writestr(name, a.read(name))
    return out.getvalue()


def test_workbooks_as_they_come(spark):
    book = xlsx.workbook({"Пиво": [HEAD, *ROWS]})
    df = spark.createDataFrame([("full", book), ("bare", bare_places(book)), ("no sheet", without(book, "sheets/s1")), ("text", b"hello")], "file_id string, content binary")
    got = {(r["file_id"], r["row_idx"], r["col_idx"]): r["value"] for r in xlsx.cells_of(df).collect()}
    assert {f for f, _, _ in got} == {"full", "bare"}
    assert all(got["bare", r, c] == v for (f, r, c), v in got.items() if f == "full")
    assert {r["file_id"] for r in xlsx.unreadable(df).collect()} == {"no sheet", "text"}


def test_a_workbook_is_decoded_in_little_memory():
    """A sheet of 80000 rows, 28 MB unpacked, with its cells in order, while a fifth of that is held at most."""
    import tracemalloc

    book = xlsx.workbook({"a": [[f"row {i}", i, "x" * 40] for i in range(80_000)], "b": [["last"]]})
    size = zipfile.ZipFile(io.BytesIO(book)).getinfo("xl/worksheets/s1.xml").file_size
    tracemalloc.start()
    n, last = 0, None
    for cell in xlsx.decode("f", book):
        if cell[1] == "a":
            assert (cell[2], cell[3]) == divmod(n, 3) and (cell[3] != 1 or cell[4] == str(cell[2]))
            n += 1
        last = cell
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 240_000 and last[1:5] == ("b", 0, 0, "last")
    assert peak < size / 5, (peak, size)


def test_a_broken_workbook_gives_no_cell(spark):
    """The second sheet breaks off; nothing of the first is given. A shared string that isn't there is an empty cell."""
    book = xlsx.workbook({"a": [["x"]], "b": [["y", 5]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            raw = a.read(name)
            b.writestr(name, raw[:-30] if "s2" in name else raw)
    lost = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(lost, "w") as b:
        for name in a.namelist():
            b.writestr(name, a.read(name).replace(b"<v>5</v>", b"<v>7</v>").replace(b'<c r="B1">', b'<c r="B1" t="s">'))
    df = spark.createDataFrame([("broken", out.getvalue()), ("lost", lost.getvalue()), ("none", None), ("zip", out.getvalue()[:50])], "file_id string, content binary")
    assert {(r["file_id"], r["value"]) for r in xlsx.cells_of(df).collect()} == {("lost", "x"), ("lost", "y")}
    assert {r["file_id"] for r in xlsx.unreadable(df).collect()} == {"broken", "none", "zip"}


def test_csv_to_items(spark, tmp_path):
    (tmp_path / "list.csv").write_text("\n".join(",".join(map(str, r)) for r in [HEAD, *[[*r[:4], r[4].replace(",", "."), r[5]] for r in ROWS]]), encoding="utf-8")
    got = {r["beer_name"]: (r["brewery"], float(r["price"]), r["volume"]) for r in ingest.items(files.csv_cells(spark, str(tmp_path))).collect()}
    assert got["Rauchbier"] == ("Neu", 310.0, 20.0) and got["Kellerbier 2"] == ("Alt", 202.0, 0.5) and len(got) == 6


def test_csv_widths(spark, tmp_path):
    """Cells of records wider than the first one, of other files than the first, in quotes, in either encoding, blank records counted."""
    (tmp_path / "a.csv").write_text("Телефон 123\nПивоварня,Название,Цена\nAlt,Helles,200\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_bytes('Alt,"Rauch, ""rot""\r\nzwei",200,,\r\n\r\n  ,\r\nНовый,x,1,2,3,4,5\r\n'.encode("cp1251"))
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_text("x" * 300_000 + ",y", encoding="utf-8")
    got: dict = {}
    for r in files.csv_cells(spark, str(tmp_path)).collect():
        got.setdefault(r["file_id"][-5], {})[r["row_idx"], r["col_idx"]] = r["value"]
    assert got["a"] == {(0, 0): "Телефон 123", (1, 0): "Пивоварня", (1, 1): "Название", (1, 2): "Цена", (2, 0): "Alt", (2, 1): "Helles", (2, 2): "200"}
    assert got["b"] == {(0, 0): "Alt", (0, 1): 'Rauch, "rot"\r\nzwei', (0, 2): "200", **{(3, i): v for i, v in enumerate(["Новый", "x", "1", "2", "3", "4", "5"])}}
    assert set(got) == {"a", "b", "d"} and got["d"] == {(0, 0): "x" * 300_000, (0, 1): "y"}


def test_csv_as_the_workbook(spark):
    """A list with a first line of one cell gives the same items from a CSV file as from a workbook."""
    grid = [["Телефон 123"], HEAD, *ROWS]
    text = "\n".join(",".join(f'"{v}"' for v in r) for r in grid).encode()
    fields = ["row_idx", "brewery", "beer_name", "style", "price", "volume", "format_type"]
    both = [cells for cells in (files.csv_records(spark.createDataFrame([("f", text)], "file_id string, content binary")), xlsx.cells_of(spark.createDataFrame([("f", xlsx.workbook({"csv": grid}))], "file_id string, content binary")))]
    a, b = (sorted(map(str, ingest.items(c).select(*fields).collect())) for c in both)
    assert a == b and len(a) == len(ROWS)


def test_metadata_of_a_list(spark):
    book = xlsx.workbook({"Пиво": [["Менеджер: a@beer.example, самовывоз"], HEAD, *ROWS]})
    cells = xlsx.cells_of(spark.createDataFrame([("f", book)], "file_id string, content binary"))
    row = ingest.metadata(cells).first()
    assert row["emails"] == ["a@beer.example"] and row["skipped_rows"] == 2


def test_stream_takes_new_workbooks_once(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.xlsx").write_bytes(xlsx.workbook({"Пиво": [HEAD, *ROWS]}))
    run = lambda: streaming.ingest_folder(spark, str(inbox), str(out), str(tmp_path / "check"), files_per_batch=1, unreadable=str(tmp_path / "bad")).awaitTermination()
    run()
    assert spark.read.parquet(str(out)).count() == len(ROWS)
    (inbox / "b.xlsx").write_bytes(xlsx.workbook({"Пиво": [HEAD, *ROWS[:2]]}))
    (inbox / "c.xlsx").write_bytes(b"no workbook")
    run()
    run()
    assert sorted(r["count"] for r in spark.read.parquet(str(out)).groupBy("file_id").count().collect()) == [2, len(ROWS)]
    assert [r["file_id"][-6:] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["c.xlsx"]


def test_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b", None), (2, 'say "x"', 3.5), (3, "two\nlines", 0.0)], "id int, name string, price double").coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part-*"))
    assert text == '﻿id,name,price\n1,"a,b",\n2,say "x",3.5\n3,"two\nlines",0.0\n'


@pytest.mark.parametrize(("original", "explicit", "want"), [("Пиво", "x", "Пиво"), (None, " ПИВО ", "Пиво"), ("Банки", None, "Титул"), (None, None, "Титул")])
def test_sheet_names(spark, original, explicit, want):
    df = spark.createDataFrame([(["Титул", "Пиво"], original, explicit)], "names array<string>, a string, b string")
    assert df.select(sinks.sheet_in_book(F.col("names"), F.col("a"), F.col("b")).alias("x")).first()["x"] == want


def test_columns_of_a_form(spark):
    assert [r["x"] for r in spark.createDataFrame([(1,), (26,), (27,), (52,), (53,)], "n int").select(sinks.column_letters(F.col("n")).alias("x")).collect()] == ["A", "Z", "AA", "AZ", "BA"]


def test_last_edit_wins(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "id int, name string, n int")
    edits = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, 3), (1, None, 7, 2), (9, "z", 1, 1), (None, "no", 1, 1)], "id int, name string, n int, at int")
    assert sorted(map(tuple, sinks.updated_by_id(rows, edits, order="at").collect()), key=str) == [(1, "y", 7), (2, "b", 2), (None, "c", 3)]
    assert sinks.updated_by_id(rows, edits.drop("at")).where("id = 1").collect() == [(1, "y", 7)]


def test_changes_touch_the_folders_of_their_keys(spark, tmp_path):
    """Edits, deletions that empty a folder, keys that don't exist and null keys, against the same changes in plain Python; other folders keep their files."""
    path = f"{tmp_path}/items"
    data = {i: f"name {i}" for i in [*range(-25, 400), 10_000]}
    rows = spark.createDataFrame([*data.items(), (None, "none")], "id long, name string")
    keyed.stored(rows, path, width=100)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "items").rglob("*.parquet")}
    edits = spark.createDataFrame([(5, "first", 1), (5, "second", 2), (150, "new", 1), (777, "nowhere", 1), (None, "no", 1)], "id long, name string, at int")
    deleted = spark.createDataFrame([(10_000,), (7,), (888,), (None,)], "id long")
    assert keyed.changed(spark, path, edits, deleted, width=100, order="at") == 3
    want = {i: n for i, n in (data | {5: "second", 150: "new"}).items() if i not in (7, 10_000)}
    got = keyed.read(spark, path).collect()
    assert {r["id"]: r["name"] for r in got if r["id"] is not None} == want and len(got) == len(want) + 1
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "items").rglob("*.parquet")}
    kept = {p.parent.name for p in before.keys() & after.keys() if before[p] == after[p]}
    assert kept == {"key_range=-1", "key_range=2", "key_range=3", "key_range=__HIVE_DEFAULT_PARTITION__"}
    assert keyed.changed(spark, path, deleted=spark.createDataFrame([(5_000,)], "id long"), width=100) == 0


def test_stream_of_changes_goes_on_after_a_restart(spark, tmp_path):
    """Files of states in three runs over one checkpoint give the log of the whole table; late, repeated and null-ordered rows are told apart."""
    inbox, out = tmp_path / "in", tmp_path / "out"
    schema = "tap_id long, created_at timestamp, state_id long, brewery string, beer_name string, price long"
    draw, at = random.Random(4), datetime(2024, 5, 1)
    rows = [(draw.choice([1, 2, 3, None]), at + timedelta(minutes=i), i, draw.choice(["", "Alt", "Neu"]), draw.choice(["", "Rot"]), draw.choice([None, 5, 6])) for i in range(200)]
    run = lambda: streaming.log_changes(spark.readStream.schema(schema).parquet(str(inbox)), str(out), str(tmp_path / "check")).awaitTermination()
    fields = ["tap_id", "state_id", "change_type", "old_brewery", "old_beer_name", "old_price", "brewery", "price"]
    for part in (rows[:80], rows[80:90], rows[90:]):
        draw.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        run()
    run()
    want = changes.change_log(spark.createDataFrame(rows, schema), ["tap_id"], ["created_at", "state_id"]).select(*fields)
    got = spark.read.parquet(str(out)).select(*fields)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100
    late = [(1, at - timedelta(days=1), 900, "Neu", "Rot", 5), (1, None, 901, "Neu", "Rot", 5), next(r for r in rows if r[0] == 2)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(inbox))
    run()
    assert {(r["tap_id"], r["state_id"], r["old_brewery"]) for r in spark.read.parquet(str(out)).where("change_type = 'late'").collect()} == {(1, 900, None), (1, 901, None), (2, late[2][2], None)}
    last = max((r for r in rows if r[0] == 3), key=lambda r: r[1])
    spark.createDataFrame([(3, at + timedelta(days=9), 999, "Fox", "Blau", 1)], schema).coalesce(1).write.mode("append").parquet(str(inbox))
    run()
    assert spark.read.parquet(str(out)).where("state_id = 999").first()["old_brewery"] == last[3]


def test_one_row_at_a_time(spark):
    """Of a batch's rows each is unpacked when the one before is done, and the batch that goes to Python is bounded."""
    rows = spark.range(50, numPartitions=1).selectExpr("cast(id as string) AS file_id", "repeat('x', 100) AS text")
    out = files.one_by_one(rows, lambda r: [(r["file_id"], r["text"].encode())] * (int(r["file_id"]) % 3), files.CONTENTS)
    assert [r["file_id"] for r in out.collect()] == [str(i) for i in range(50) for _ in range(i % 3)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_cells_are_made_once(spark):
    """Rows that count come with all their cells from one pass; what goes is hidden, struck out or grey in one of the first cells."""
    looks = {0: (False, False, None), 1: (True, False, None), 2: (False, True, None), 3: (False, False, "FF808080"), 4: (None, None, "FFFF0000")}
    cells = spark.createDataFrame([("f", "s", r, c, f"{r}-{c}", *(looks[r] if c == 1 else looks[0])) for r in looks for c in range(3)], xlsx.CELLS)
    rows = xlsx.active_rows(cells)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r["row_idx"]: sorted(c["value"] for c in r["cells"]) for r in rows.collect()} == {r: [f"{r}-{c}" for c in range(3)] for r in (0, 4)}
    assert xlsx.cells_of_rows(rows).count() == 6


def test_places_of_a_row(spark):
    """Fields from the cells at their columns, the first text of a place that stands twice, no text for signs of nothing, prices in order of columns; no side of the join is broadcast."""
    cell = "array<struct<col_idx:int,value:string>>"
    rows = spark.createDataFrame([("f", "s", 0, [(0, "Name")]), ("f", "s", 1, [(3, "9 / 1"), (0, "-"), (0, " Lot "), (2, "7 "), (1, "nan")]), ("f", "t", 1, [(0, "x")])], f"file_id string, sheet string, row_idx int, cells {cell}")
    of = "struct<format_type:string,volume:double>"
    known = spark.createDataFrame([("f", "s", 0, {"beer_name": 0, "style": 1, "description": 5}, ("unknown", None, False, False), [(2, ("кег", 20.0)), (3, ("банка", 0.33)), (1, ("кег", 1.0))])], f"file_id string, sheet string, header_row int, mapping map<string,int>, supplier struct<kind:string,name:string,has_column:boolean,in_names:boolean>, prices array<struct<col_idx:int,of:{of}>>")
    placed = ingest.placed(rows, known)
    assert "Broadcast" not in placed._jdf.queryExecution().sparkPlan().toString()
    (row,) = placed.collect()
    assert (row["row_idx"], row["beer_name"], row["style"], row["description"], row["price"]) == (1, "Lot", None, None, None)
    assert [(o["col_idx"], o["price"], o["of"]["volume"]) for o in row["options"]] == [(2, "7", 20.0), (3, "9", 0.33)]
