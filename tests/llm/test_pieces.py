"""The prefix table against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmalt.llm import pieces, queries
from sparkmalt.llm.queries import bpe_model
from tests.llm.fixtures import SF, hostile


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=bpe_model())


@pytest.fixture(scope="module")
def own():
    with open(bpe_model(), "rb") as f:
        return pieces.PrefixTable(f.read())


def check(library, own, text):
    want = library.encode(text, add_eos=True)
    assert own.encode(text, True) == want, text
    assert own.decode(want) == library.decode(want), text


def test_texts_of_the_corpus(spark, library, own):
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        check(library, own, r["text"] or "")


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "  two  spaces   three    four ", "\n\n\t\ttabs\r\n", "▁", "▁▁ x ▁", "<s></s><unk>", "😀 emoji 👩‍👩‍👧", "日本語のテキスト", "é" * 50, "\u0085  ", "a" * 300, "x\x00y", "<0x41>", "１２３ 123", "﻿bom", "é", " " * 40 + "x" + " " * 33])
def test_odd_texts(library, own, text):
    check(library, own, text)


def test_random_texts(library, own):
    rng = random.Random(5)
    for alphabet in ("ab ", "the cat sat on ", "éèà çù\n ", "0123456789.,-", "<>/▁ \t", "你好世界 x"):
        for _ in range(150):
            check(library, own, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))))


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_any_text(library, own, text):
    check(library, own, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=12))
def test_any_ids_decode(library, own, ids):
    assert own.decode(ids) == library.decode(ids)


def test_table(spark, library):
    docs = hostile(spark).withColumnRenamed("n", "decoded")
    out = pieces.encode_decode(docs, bpe_model())
    assert out.columns == [*[c for c in docs.columns if c != "decoded"], "ids", "decoded"]
    for r in out.collect():
        want = library.encode(r["text"] or "", add_eos=True)
        assert list(r["ids"]) == want and r["decoded"] == library.decode(want)
    assert pieces.encode_decode(docs.limit(0), bpe_model()).count() == 0


def test_query(spark, library):
    """Every row of the query against the library."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_sentencepiece(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_eos=True)
        assert rows[i] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
