"""Near duplicates against all pairs of sets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkmalt.llm import neardup, queries
from sparkmalt.llm.graph import components as tree
from tests.llm.fixtures import SF, components, hostile


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = components([tuple(r) for r in docs.collect()], 85)
    out = queries.op7_minhash(spark, SF)
    assert result(out) == want
    assert any(i != c for i, (_, c) in want.items())
    assert {r["doc_id"] for r in out.where("kept").collect()} == {c for _, c in want.values()}


@pytest.mark.parametrize("block", [512, 8])
def test_large_groups(spark, block):
    """Many near copies of one text, in small blocks, with links that only pairs of blocks can find."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i % 12):
            w[(j * 9 + 3) % 100] = f"x{i % 12}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"solo{i}_{j}" for j in range(30))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(docs, percent=80, block=block)) == components(rows, 80)


def test_chain(spark):
    """Each text is near the next only."""
    rows = [(i, " ".join(f"w{j}" for j in range(8 * i, 8 * i + 100))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(docs, percent=80, block=4)) == components(rows, 80)


def test_hostile_rows(spark):
    docs = hostile(spark)
    out = neardup.near_duplicates(docs, percent=85).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[9]["component_id"] == by[10]["component_id"] == 9 and not by[10]["kept"]
    for i in (3, 4, 5):
        assert by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"]
    assert by[8]["n_shingles"] == 1
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10 != 9] + [(70, 71), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in tree(edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(51) if i % 10 and i < 50} | {71: 70}
    assert tree(edges.limit(0)).count() == 0
    assert neardup.match_threshold(64, 0.85) < 64 * 0.85
    assert edges.select(F.count("*")).first()[0]
