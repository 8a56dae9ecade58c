"""A training-data pipeline: quality rules, near duplicates, repeated substrings, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; all but the last return the columns of ``documents``. A stage's
result is written as Parquet and read again before the next. Defined cases, for
every stage: null and empty texts, null ids, repeated rows and extra columns
are kept as they are unless said otherwise; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.llm import decontaminate, neardup, pieces, quality, substrings
from sparkmalt.llm.queries import bpe_model
from sparkmalt.llm.store import spare, table, written

SIMILARITY = 80  # percent of shared five-word shingles from which documents are near duplicates


def own(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or that the isolation forest finds anomalous; null and empty texts fail."""
    stats, out = spare(docs, "stats"), spare(docs, "rules")
    measured = quality.rule_stats(docs, out=stats)
    forest = quality.fit(measured, table(spark, sf_dir, "labels"), column=stats)
    return own(quality.apply(measured, forest, column=stats, out=out).where(F.col(out)["kept"]), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of smallest id.

    A document is a row's id and text: other texts under the same id stay, null
    ids group like others, and of rows that repeat both id and text one stays.
    Null and empty texts have no duplicates.
    """
    found = written(neardup.near_duplicates(docs.select("doc_id", "text"), percent=SIMILARITY).select(F.col("doc_id").alias("id"), F.col("text_tag").alias("tag"), "first", "n_shingles"), "near-duplicates")
    tag = F.xxhash64(F.col("text"))
    same = lambda other: docs["doc_id"].eqNullSafe(other["id"]) & (tag == other["tag"])
    gone = found.where(~F.col("first"))
    repeated = written(found.where("first AND n_shingles > 0").groupBy("id", "tag").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    left = docs.join(gone, same(gone), "left_anti")
    if repeated.take(1):
        once = docs.join(repeated, same(repeated), "left_semi").withColumn(mark := spare(docs, "tag"), tag).dropDuplicates(["doc_id", mark])
        left = left.join(repeated, same(repeated), "left_anti").unionByName(once.drop(mark))
    return own(left, docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words under repeated windows; a text that loses none stays as it is, others are joined by spaces (n_chars follows)."""
    out = spare(docs, "dedup")
    found = substrings.remove_repeats(docs, out=out)
    changed = F.col(out)["n_removed"] > 0
    found = found.withColumn("text", F.when(changed, F.col(out)["kept_text"]).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return own(found, docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item of ``benchmark``."""
    out = spare(docs, "matches")
    found = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), out=out)
    return own(found.where(F.size(F.col(out)) == 0), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids with an end id, and the text that they decode to."""
    out = pieces.encode_decode(docs.select("doc_id", "text"), bpe_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
