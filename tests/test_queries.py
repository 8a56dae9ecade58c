"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sparkmalt.plans import registered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else round(float(x), 9)
    return str(x)


def rows(columns: list[str], data: list) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(value(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, duck, name):
    got = registered.QUERIES[name](spark, SF)
    found = got.collect()
    if name not in registered.ORACLES:
        assert found
        return
    want = duck.execute(registered.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    want_rows, got_rows = rows(columns, want.fetchall()), rows(got.columns, found)
    assert want_rows, "an oracle without rows proves nothing"
    extra, missing = got_rows - want_rows, want_rows - got_rows
    assert not extra and not missing, (sorted(columns), list(extra.items())[:3], list(missing.items())[:3], len(extra), len(missing))
