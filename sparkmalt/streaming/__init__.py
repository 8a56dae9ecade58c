"""Price lists and tap states as they arrive: new workbooks become items, new states a log of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkmalt.operators import changes
from sparkmalt.plans import ingest
from sparkmalt.sources import files, xlsx

BEFORE = ["brewery", "beer_name", "price"]


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of workbooks (file_id, content), at most so many in a batch."""
    found = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return found.select(F.col("path").alias("file_id"), "content")


def ingest_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 100, unreadable: str | None = None) -> StreamingQuery:
    """Parses each new workbook once and writes its items by file; a batch that runs again replaces the same files.

    Files that are no workbooks go to the Parquet folder ``unreadable`` (file_id,
    error), if there is one, by file as well.
    """

    def batch(df: DataFrame, _: int) -> None:
        files.replace_files(ingest.items(xlsx.cells_of(df)), out)
        if unreadable:
            files.replace_files(xlsx.unreadable(df), unreadable)

    return arriving(spark, folder, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_stream(states: DataFrame, key: str = "tap_id", order: tuple[str, ...] = ("created_at", "state_id")) -> DataFrame:
    """The change log of a stream of states (brewery, beer_name, price and others), as ``changes.change_log`` gives it for a table.

    Kept between batches is each key's latest state and its place in the order,
    in the query's checkpoint, so a restart goes on where the last batch ended. A
    batch's rows of a key are put in order first. A row that comes before the
    latest state known, or again with the same place, is late: it changes nothing
    and is given as a change of type ``late`` without a state before it. Rows with
    a null in the order are late, too; null keys are a key like others. What a
    task holds is one key's rows of one batch, which the source's batch size bounds.
    """
    places = {f"__place{i}": c for i, c in enumerate(order)}
    # pandas has no whole numbers beside nulls: values travel as texts, and places are filled where they are null
    texts = [F.col(c).cast("string").alias(c) for c in states.columns]
    kind_of = {c: states.schema[c].dataType for c in states.columns}
    any_value = lambda c: F.lit("1970-01-01" if isinstance(kind_of[c], (T.DateType, T.TimestampType, T.TimestampNTZType)) else "0").cast(kind_of[c])
    filled = [F.coalesce(F.col(c), any_value(c)).alias(p) for p, c in places.items()]
    placeless = F.exists(F.array(*[F.col(c).isNull() for c in order]), lambda x: x)
    rows = states.select(*texts, *filled, placeless.alias("late"))
    old = [T.StructField(f"old_{c}", T.StringType()) for c in BEFORE]
    kept = T.StructType([rows.schema[p] for p in places] + old)
    shape = T.StructType([*rows.schema.fields, *old])

    def follow(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = tuple(state.get) if state.exists else None
        found = []
        for row in pd.concat(list(batches)).sort_values(list(places), kind="stable").to_dict("records"):
            place = tuple(row[p] for p in places)
            row["late"] = bool(row["late"]) or (latest is not None and place <= latest[: len(places)])
            before = [None] * len(BEFORE) if row["late"] or latest is None else latest[len(places) :]
            found.append(row | {f"old_{c}": v for c, v in zip(BEFORE, before, strict=True)})
            if not row["late"]:
                latest = (*place, *(row[c] for c in BEFORE))
        if latest is not None:
            state.update(latest)
        yield pd.DataFrame(found, columns=shape.names)

    told = rows.groupBy(key).applyInPandasWithState(follow, shape, kept, "append", GroupStateTimeout.NoTimeout)
    back = lambda name, c: F.col(name).cast(kind_of[c]).alias(name)
    told = told.select(*[back(c, c) for c in states.columns], *[back(f"old_{c}", c) for c in BEFORE], "late")
    old, new = ([F.col(f"{p}{c}") for c in BEFORE] for p in ("old_", ""))
    kind = F.when(F.col("late"), "late").otherwise(changes.change_type(tuple(old), tuple(new)))
    return told.withColumn("change_type", kind).where(F.col("change_type").isNotNull()).drop("late")


def log_changes(states: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the changes of all states that are there, each once, to a Parquet folder."""
    return change_stream(states).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
