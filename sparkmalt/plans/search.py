"""Searches in items by posting lists instead of scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.plans import bound
from sparkmalt.sources import postings
from sparkmalt.sources.shared import fresh

# Searches, each of one or more terms that must all match: frequent and rare ones, all modes, too short for a gram, without a hit, signs of patterns.
SEARCHES = [
    [("label", "contains", "ing 1")],
    [("label", "contains", "Gear 12")],
    [("label", "contains", "BOLT"), ("brewery", "equals", "brand#7")],
    [("label", "starts_with", "red r"), ("label", "ends_with", "7")],
    [("brewery", "contains", "#1")],
    [("label", "contains", "9"), ("brewery", "ends_with", "d#25"), ("sheet", "contains", "econ")],
    [("label", "contains", "gear%1")],
    [("label", "contains", "пиво")],
]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with ``label``: the name with the item's number, so that names are many."""
    return bound.items(spark, sf_dir).withColumn("label", F.concat("beer_name", F.lit(" "), F.col("id").cast("string")))


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found by each of the searches, from an index that is built in two steps: even numbers, then odd ones."""
    items, path = _labelled(spark, sf_dir).select("id", "sheet", "brewery", "label"), fresh(spark, "item-index")
    fields = ["label", "brewery", "sheet"]
    postings.stored(items.where("id % 2 = 0"), path, fields)
    postings.stored(items.where("id % 2 <> 0"), path, fields, mode="append")
    hits = [postings.found(spark, path, asked).select(F.lit(i).alias("search"), "id", "label", "brewery") for i, asked in enumerate(SEARCHES)]
    return reduce(DataFrame.unionByName, hits)


def _sql(field: str, mode: str, text: str) -> str:
    name = {"contains": "contains", "equals": "=", "starts_with": "starts_with", "ends_with": "suffix"}[mode]
    column, quoted = f"lower({field})", f"'{text.lower()}'"
    return f"{column} = {quoted}" if name == "=" else f"{name}({column}, {quoted})"


_SELECTS = [f"SELECT {i} AS search, id, label, brewery FROM labelled WHERE {' AND '.join(_sql(*term) for term in asked)}" for i, asked in enumerate(SEARCHES)]

QUERIES = {"item_index_search": indexed_search}
ORACLES = {"item_index_search": f"WITH {bound.ITEMS}, labelled AS (SELECT *, beer_name || ' ' || id AS label FROM items) " + " UNION ALL ".join(_SELECTS)}
