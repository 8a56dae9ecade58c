"""The stages of the pipeline: columns, decisions, empty and hostile inputs."""

from __future__ import annotations

import sentencepiece

import corpus_pipeline
from sparkmalt.llm import quality
from sparkmalt.llm.queries import bpe_model
from tests.llm.fixtures import SF, components, hostile, repeats
from tests.llm.test_models import plain_matches


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        out = stage(spark, now, SF)
        out = out.cache()
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "tokens":
            assert out.columns == columns and out.schema == docs.schema
        if name == "quality_rules":
            stats = quality.rule_stats(now)
            kept = quality.apply(stats, quality.fit(stats, spark.read.parquet(f"{SF}/labels.parquet"))).where("rules.kept").select("doc_id").collect()
            assert set(after) == {r["doc_id"] for r in kept}
        if name == "near_duplicates":
            want = components([(i, r["text"]) for i, r in before.items()], corpus_pipeline.SIMILARITY)
            assert set(after) == {c for _, c in want.values()}
        if name == "repeated_substrings":
            for (i, t), (_, gone, left) in repeats([(i, r["text"]) for i, r in before.items()], 35).items():
                assert after[i]["text"] == (left if gone else t)
                assert after[i]["n_chars"] == (len(left) if gone else before[i]["n_chars"])
        if name == "benchmark_leaks":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {i for i, r in before.items() if not plain_matches(items, r["text"])}
        if name == "tokens":
            sp = sentencepiece.SentencePieceProcessor(model_file=bpe_model())
            for i, r in after.items():
                assert list(r["ids"]) == sp.encode(before[i]["text"], add_eos=True) and r["n_tokens"] == len(r["ids"])
        seen.append(len(after))
        now = out
    assert seen[0] > seen[1] >= seen[3] > 0
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def test_near_duplicates_go_by_id_and_text(spark):
    """Another text under a repeated id stays; of equal rows, and of null ids with equal texts, one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (None, c + " tail"), (None, "z " + a), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, [(3, b), (5, a), (7, c), (8, None), (8, None), (9, "")]))
    alone = spark.createDataFrame([(None, c), (None, c + " tail"), (None, c)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, alone, SF).count() == 1


def test_hostile_and_empty(spark):
    docs = hostile(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count()
