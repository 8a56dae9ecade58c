"""Values carried along ordered rows of a key, also where one key has more rows than a task should see.

A plain window sends a key to one task. Here rows are dealt by ranges of key and
order into blocks of about ``MOST`` rows, so a large key spans many blocks; each
block's end (last filled value, last row, number of rows) is one row of a summary;
a window over a key's few summary rows tells what comes into each block; and a
window inside the block does the rest. No task holds a key whole.

Keys that all stay below ``most`` rows go through the plain window, with the same
result; a count per key decides, in partial sums. Null keys are a key like others,
null order values come first. Rows that are equal in key and order come in any
order, as in a window. Empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmalt.sources.shared import written

MOST = 1 << 18  # rows of a key that one task may see
KEY, BLOCK, HEAD = "__key", "__block", "__head"


def sizes(rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """The number of rows, and of those of the largest key."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    return found["all"] or 0, found["most"] or 0


def scanned(rows: DataFrame, keys: list[str], order: list[str], carry: dict[str, Column] | None = None, before: dict[str, Column] | None = None, place: str | None = None, total: str | None = None, most: int = MOST, crowded: bool | None = None) -> DataFrame:
    """``rows`` with more columns, within ``keys`` along ``order``.

    ``carry``: the last value that isn't null, up to and with the row; ``before``:
    the value of the row before; ``place``: the row's number from 1; ``total``: the
    key's number of rows. ``crowded`` says what is known already of the largest key.
    """
    carry, before = carry or {}, before or {}
    every = most
    if crowded is None:
        every, largest = sizes(rows, keys)
        crowded = largest > most
    if not crowded:
        along = Window.partitionBy(*keys).orderBy(*order)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = {n: F.last(v, ignorenulls=True).over(upto) for n, v in carry.items()} | {n: F.lag(v).over(along) for n, v in before.items()}
        found |= ({place: F.row_number().over(along)} if place else {}) | ({total: F.count("*").over(Window.partitionBy(*keys))} if total else {})
        return rows.withColumns(found)
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // most))
    values = {f"__v{i}": v for i, v in enumerate([*carry.values(), *before.values()])}
    dealt = written(rows.repartitionByRange(parts, *keys, *order).withColumns(values | {KEY: F.struct(*keys), BLOCK: F.spark_partition_id()}), "blocks")
    carried, last = list(values)[: len(carry)], list(values)[len(carry) :]
    at = F.struct(*order)
    ends = dealt.groupBy(KEY, BLOCK).agg(
        F.count("*").alias("__n"),
        F.max_by(F.struct(F.lit(0).alias("__"), *last), at).alias("__last"),
        *[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(f"{v}_end") for v in carried],
    )
    blocks = Window.partitionBy(KEY).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(
        KEY,
        BLOCK,
        F.struct(
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("n"),
            F.sum("__n").over(Window.partitionBy(KEY)).alias("all"),
            F.lag("__last").over(blocks).alias("last"),
            *[F.last(f"{v}_end", ignorenulls=True).over(earlier).alias(v) for v in carried],
        ).alias(HEAD),
    )
    inside = Window.partitionBy(KEY, BLOCK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined, number = dealt.join(heads, [KEY, BLOCK]), F.row_number().over(inside)
    found = {n: F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(HEAD)[v]) for n, v in zip(carry, carried, strict=True)}
    found |= {n: F.when(number == 1, F.col(HEAD)["last"][v]).otherwise(F.lag(v).over(inside)) for n, v in zip(before, last, strict=True)}
    found |= ({place: (F.col(HEAD)["n"] + number).cast("int")} if place else {}) | ({total: F.col(HEAD)["all"]} if total else {})
    return joined.withColumns(found).drop(KEY, BLOCK, HEAD, *values)
