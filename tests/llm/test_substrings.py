"""Repeated substrings against a table of all windows."""

from __future__ import annotations

import hashlib

import pytest

from sparkmalt.llm import queries, substrings
from tests.llm.fixtures import SF, hostile, repeats


@pytest.mark.parametrize("group", [512, 1])
def test_against_brute_force(spark, group):
    """``group`` 1 sends all anchors with several units down the counted way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = repeats([tuple(r) for r in docs.collect()], 35)
    got = {(r["doc_id"], r["text"]): (r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept_text"]) for r in substrings.remove_repeats(docs, group=group).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (6, 3)])
def test_hostile_rows(spark, window, gram):
    docs = hostile(spark)
    want = repeats([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    out = substrings.remove_repeats(docs, window=window, gram=gram)
    assert out.columns == [*docs.columns, "dedup"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept_text"]) == want[r["doc_id"], r["text"]]
        assert r["key"] == "junk" and sum(x["words"] for x in r["dedup"]["spans"]) == r["dedup"]["n_removed"]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for (i, _), (a, b, c) in repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 35).items()}
    assert {r[0]: tuple(r)[1:4] for r in queries.op2_substring_dedup(spark, SF).collect()} == want


def test_automaton_counts():
    a = substrings.SuffixAutomaton()
    a.add([b"a", b"b", b"a", b"b"], 1)
    a.add([b"b", b"a", b"c"], 3)
    a.finish()
    assert a.repeated([b"b", b"a", b"c"], 2) == [0, 1]
    assert a.repeated([b"a", b"b", b"x"], 2) == [0]
