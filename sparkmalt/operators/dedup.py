"""Deduplication of items by a normalised key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean


def base_name(c: Column) -> Column:
    """A name in small letters without what stands in brackets."""
    return F.trim(F.regexp_replace(F.lower(clean(c)), r"\s*\([^)]*\)\s*", ""))


def price_text(c: Column) -> Column:
    return F.coalesce(F.format_string("%.2f", c.cast("double")), F.lit(""))


def own_description(description: Column, name: Column) -> Column:
    """A description without the name that it begins with."""
    d, n = clean(description), clean(name)
    begins = (n != "") & F.lower(d).startswith(F.lower(n))
    return F.when(begins, F.regexp_replace(F.trim(F.substr(d, F.length(n) + 1)), r"^[:\-\s]+", "")).otherwise(d)


def key() -> list[Column]:
    low = lambda c: F.lower(clean(F.col(c)))
    return [low("brewery").alias("k_brewery"), base_name(F.col("beer_name")).alias("k_name"), low("style").alias("k_style"), low("format_type").alias("k_format"), price_text(F.col("price")).alias("k_price")]


def deduplicated(items: DataFrame, order: str) -> DataFrame:
    """One item per key: not a "(fresh ...)" one if there is another, then the longest description of its own,
    then one that doesn't begin with the name, then the first by ``order``.

    A total order stands for a fold over pairs, so the result doesn't hang on how rows are split; sums are partial before the shuffle.
    """
    own = own_description(F.col("description"), F.col("beer_name"))
    begins = F.lower(clean(F.col("description"))).startswith(F.lower(clean(F.col("beer_name")))) & (clean(F.col("beer_name")) != "")
    rank = F.struct(F.lower(clean(F.col("beer_name"))).contains("(fresh"), -F.length(own), begins, F.col(order))
    columns = items.columns
    best = items.groupBy(*key()).agg(F.min_by(F.struct(*columns), rank).alias("item"), F.count("*").alias("copies"))
    return best.select("item.*", "copies")


def first_per_key(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of smallest ``order`` for each value of ``keys``."""
    return items.groupBy(*keys).agg(F.min_by(F.struct(*items.columns), order).alias("item")).select("item.*")
