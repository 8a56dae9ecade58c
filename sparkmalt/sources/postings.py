"""Substring search over a stored table without reading all of it: posting lists of trigrams, the rarest first, then a test of the rows themselves.

Three tables lie in a folder. ``rows`` has the rows in folders by ranges of their
key, as in ``keyed``. ``postings`` has (field, gram, key), once for each three
signs in a row of a field's lower-case text; folders by field and hash of the gram,
files by ranges of gram and key, so that a gram of a third of all rows is many
files and rare grams share one. ``counts`` has the number of postings of each gram
and, under the empty gram, of rows. ``columns`` is an empty table that keeps the
types of the rows and the number of buckets; a large table wants many, so that a
search reads little besides its lists, a small one few.

A text that a search finds, in any of its modes, holds all grams of the search.
Its rarest gram therefore names all rows that can match; grams up to ``SPREAD``
times as frequent narrow them down, and commoner ones, whose lists would cost more
than they save, are left to the test of the rows. Only folders of ``rows`` with a
candidate are read. What grams can't narrow (searches of under three signs, or
grams of more than one row in ``DENSE``) is a scan; its result is the same.

Null texts count as empty, as in ``matches``. Keys are whole numbers; rows of one
key, and rows with a null key, are candidates together and tested each for itself.
A table without rows can be stored and searched.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.functions.text import matches
from sparkmalt.sources.keyed import WIDTH
from sparkmalt.sources.shared import written

SPREAD, DENSE = 16, 8
MOST_GRAMS = 16  # grams of a search whose lists are intersected
MOST_FOLDERS = 10_000  # named one by one in the scan of rows; with more, all are read
BUCKETS, TOTALS = 8, -1  # folders of a field's grams, and the one of the number of rows
NO_RANGE = -1 << 62  # folder of null keys
RANGE, KEY = "rows_range", "rows_key"

Search = tuple[str, str, str]  # field, mode (contains, equals, starts_with, ends_with), text


def grams(text: Column) -> Column:
    """Distinct three signs in a row of a text in lower case; null for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text.cast("string")), F.lit("(?s)(?=(...))"), F.lit(1)))


def range_of(key: Column, width: int) -> Column:
    return F.coalesce(F.floor(key / width).cast("long"), F.lit(NO_RANGE))


def asked_grams(text: str) -> set[str]:
    """The grams of the text that ``matches`` looks for."""
    t = text.lower()
    return {t[i : i + 3] for i in range(len(t) - 2)}


def bucket_of(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def stored(rows: DataFrame, path: str, fields: list[str], key: str = "id", width: int = WIDTH, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Writes rows with their posting lists; mode ``append`` adds rows to a stored table, in its buckets.

    Rows come last: a job that is lost before leaves postings without rows, which the
    test of the rows drops, and can be run again.
    """
    if mode == "append":
        buckets = kept_schema(rows.sparkSession, path)[RANGE].metadata["buckets"]
    lists = [rows.select(F.lit(f).alias("field"), F.explode(grams(F.col(f))).alias("gram"), F.col(key).alias(KEY)) for f in fields]
    all_lists = lists[0]
    for other in lists[1:]:
        all_lists = all_lists.union(other)
    lists_ = written(all_lists.withColumns({"bucket": (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int"), RANGE: range_of(F.col(KEY), width)}), "postings")
    by_gram = lists_.repartitionByRange("field", "bucket", "gram", KEY).sortWithinPartitions("field", "bucket", "gram", KEY)
    by_gram.write.mode(mode).partitionBy("field", "bucket").parquet(f"{path}/postings")
    total = rows.agg(F.count("*").alias("n")).select(F.lit(fields[0]).alias("field"), F.lit(TOTALS).alias("bucket"), F.lit("").alias("gram"), "n")
    counts = lists_.groupBy("field", "bucket", "gram").agg(F.count("*").alias("n")).unionByName(total)
    counts.repartition("field", "bucket").sortWithinPartitions("field", "bucket", "gram").write.mode(mode).partitionBy("field", "bucket").parquet(f"{path}/counts")
    placed = rows.withColumn(RANGE, range_of(F.col(key), width))
    placed.limit(0).withMetadata(RANGE, {"buckets": buckets}).write.mode(mode).parquet(f"{path}/columns")
    # a range holds many rows where keys repeat, so it is dealt by key as well
    placed.repartitionByRange(RANGE, key).sortWithinPartitions(RANGE, key).write.mode(mode).partitionBy(RANGE).parquet(f"{path}/rows")


def _table(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{path}/{name}")


def kept_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(f"{path}/columns").schema


def chosen(spark: SparkSession, path: str, asked: list[Search], buckets: int) -> list[tuple[str, str, int]] | None:
    """(field, gram, number of postings) to intersect, the rarest first; [] if a gram is nowhere, so that nothing matches; None for a scan."""
    pairs = sorted({(f, g) for f, _, q in asked for g in asked_grams(q)})  # no more than the searches have signs
    if not pairs:
        return None
    here = [(F.col("field") == f) & (F.col("bucket") == bucket_of(g, buckets)) & (F.col("gram") == g) for f, g in pairs]
    any_of = F.col("bucket") == TOTALS
    for other in here:
        any_of = any_of | other
    known = _table(spark, path, "counts", "gram string, n long, field string, bucket int").where(any_of).groupBy("field", "gram").agg(F.sum("n").alias("n"))
    found = sorted((r["n"], r["field"], r["gram"]) for r in known.collect())
    total = sum(n for n, _, g in found if g == "")
    found = [x for x in found if x[2] != ""]
    if len(found) < len(pairs):
        return []
    if found[0][0] * DENSE > total:
        return None
    return [(f, g, n) for n, f, g in found if n <= SPREAD * found[0][0]][:MOST_GRAMS]


def candidates(spark: SparkSession, path: str, lists: list[tuple[str, str, int]], key_type: T.DataType, buckets: int) -> DataFrame:
    """(rows_key, rows_range), one row per key that stands in all of the ``lists``."""
    number = F.lit(None).cast("long")
    here = F.lit(False)
    for i, (field, gram, _) in enumerate(lists):
        # folder and gram are constants, so that they reach the scan
        this = (F.col("field") == field) & (F.col("bucket") == bucket_of(gram, buckets)) & (F.col("gram") == gram)
        number, here = F.when(this, F.lit(1 << i).cast("long")).otherwise(number), here | this
    postings = _table(spark, path, "postings", f"gram string, {KEY} {key_type.simpleString()}, {RANGE} long, field string, bucket int").where(here)
    return postings.groupBy(KEY, RANGE).agg(F.bit_or(number).alias("has")).where(F.col("has") == (1 << len(lists)) - 1).drop("has")


def folders(hits: DataFrame) -> list[int] | None:
    """Ranges of the rows table with a candidate; None for over ``MOST_FOLDERS``."""
    named = [r[RANGE] for r in hits.select(RANGE).distinct().limit(MOST_FOLDERS + 1).collect()]  # bounded
    return named if len(named) <= MOST_FOLDERS else None


def found(spark: SparkSession, path: str, asked: list[Search], key: str = "id") -> DataFrame:
    """Rows that match all of the searches, without regard to case; all rows for no search."""
    kept = kept_schema(spark, path)
    rows, buckets = spark.read.schema(kept).parquet(f"{path}/rows"), kept[RANGE].metadata["buckets"]
    fits = F.lit(True)
    for field, mode, text in asked:
        fits = fits & matches(F.col(field), mode, text)
    lists = chosen(spark, path, asked, buckets)
    if lists == []:
        return rows.where(F.lit(False)).drop(RANGE)
    if lists is not None:
        hits = written(candidates(spark, path, lists, rows.schema[key].dataType, buckets), "candidates")
        if (named := folders(hits)) is not None:
            rows = rows.where(F.col(RANGE).isin(named)) if named else rows.where(F.lit(False))
        rows = rows.join(hits.withColumnRenamed(RANGE, "__range"), (F.col(RANGE) == F.col("__range")) & F.col(key).eqNullSafe(F.col(KEY)), "left_semi")
    return rows.where(fits).drop(RANGE)
