"""Tables of the corpus operators: input tables, and intermediate ones in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmalt.sources.shared import fresh, shared_dir, written

__all__ = ["fresh", "shared_dir", "spare", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark's own reader so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
