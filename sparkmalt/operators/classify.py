"""Product rows and other rows of a price list, and what the others say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions import contacts
from sparkmalt.functions.text import clean, present, settled

HEADINGS = ["название", "наименование", "наличие", "наличии"]  # fixed values
FIELDS = ["brewery", "beer_name", "style", "abv", "ibu", "price", "volume", "format_type", "stock", "description"]


def row_text(columns: list[str]) -> Column:
    """The filled fields of a row, joined by spaces."""
    return F.array_join(F.filter(F.array(*[clean(F.col(c)) for c in FIELDS if c in columns]), lambda x: x != ""), " ")


def is_product() -> Column:
    """There is a name, brewery or price, more than a brewery alone, and the name is no heading and no stub."""
    name, brewery, price, style = (present(F.col(c)) for c in ("beer_name", "brewery", "price", "style"))
    alone = brewery & ~name & ~price & ~style
    text = F.lower(clean(F.col("beer_name")))
    return (name | brewery | price) & ~alone & ~text.isin(HEADINGS) & ~F.length(text).between(1, 2)


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_text`` and ``is_product``."""
    return settled(rows, {"row_text": row_text(rows.columns), "is_product": is_product()})


def metadata(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file, from the rows that are no products: contacts in order of rows (``row_idx``), distinct service phrases, number of rows."""
    other = rows.where(~F.col("is_product")).withColumn("found", contacts.contacts(F.col("row_text"))).withColumn("said", contacts.service_phrases(F.col("row_text")))
    listed = lambda f: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", f"found.{f}"))), lambda x: x[f])).alias(f)
    return other.groupBy(key).agg(*[listed(f) for f in ("phones", "emails", "addresses", "links")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("said")))).alias("extra_text"), F.count("*").alias("skipped_rows"))
