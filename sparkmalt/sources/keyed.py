"""A stored table whose rows lie in folders by ranges of their key, so that changes touch only the folders that can hold the keys they name.

A folder holds ``width`` consecutive keys. Edits and deletions are few beside the
table: the ranges that they name are found first, those folders alone are read (by
partition pruning), changed, written to the shared folder and put in their place;
others keep their files. Null keys are in a folder of their own, which no change
names. Keys that are not in the table change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.sources import sinks
from sparkmalt.sources.shared import written

RANGE = "key_range"
WIDTH = 1 << 20


def range_of(key: Column, width: int) -> Column:
    return F.floor(key / width).cast("long")


def stored(rows: DataFrame, path: str, key: str = "id", width: int = WIDTH) -> None:
    """Writes a table anew; a folder's rows come from one task, as its size is bounded where keys don't repeat."""
    rows.withColumn(RANGE, range_of(F.col(key), width)).repartition(RANGE).write.mode("overwrite").partitionBy(RANGE).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(RANGE)


def changed(spark: SparkSession, path: str, edits: DataFrame | None = None, deleted: DataFrame | None = None, key: str = "id", width: int = WIDTH, order: str | None = None) -> int:
    """Applies ``edits`` (as in ``sinks.updated_by_id``), then deletes the keys of ``deleted``; the number of folders that were written again."""
    asked = [df.select(range_of(F.col(key), width).alias(RANGE)) for df in (edits, deleted) if df is not None]
    ranges = asked[0].unionByName(asked[1]) if len(asked) == 2 else asked[0]
    named = written(ranges.where(F.col(RANGE).isNotNull()).distinct(), "key-ranges")
    table = spark.read.parquet(path)
    # a join on the partition column: Spark reads the folders of these ranges alone
    old = table.join(F.broadcast(named) if named.count() < 100_000 else named, RANGE, "left_semi")
    new = old.drop(RANGE)
    if edits is not None:
        new = sinks.updated_by_id(new, edits, key, order)
    if deleted is not None:
        new = sinks.deleted_by_id(new, deleted, key)
    # written before anything is replaced, so the folders that are read stay until then
    new = written(new.withColumn(RANGE, range_of(F.col(key), width)), "changed")
    had, left = ({r[RANGE] for r in df.select(RANGE).distinct().collect()} for df in (old, new))  # numbers of folders
    new.repartition(RANGE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for empty in had - left:  # a folder without rows isn't overwritten
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{RANGE}={empty}"), True)
    return len(had)
