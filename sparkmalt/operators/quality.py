"""Validation of items: coded issues per row, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.text import present, truthy

# Highest plausible values, and the usual price per litre: fixed values.
HIGHEST = {"price": 100000.0, "volume": 100.0, "abv": 20.0}
PER_LITRE = (50.0, 10000.0)


def issue(when: Column, code: str, severity: str, field: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def issues(columns: list[str]) -> Column:
    """Array of the issues of a row; fields that the table lacks raise none."""
    found = []
    for field, highest in HIGHEST.items():
        if field in columns:
            text = F.trim(F.col(field).cast("string"))
            value = text.try_cast("double")
            found += [
                issue((text != "") & value.isNull(), f"{field}_invalid", "error", field),
                issue(value < 0, f"{field}_negative", "error", field),
                issue(value > highest, f"{field}_high", "warning", field),
                issue(value == 0, f"{field}_zero", "warning", field),
            ]
    name, brewery = present(F.col("beer_name")), present(F.col("brewery"))
    found += [
        issue(~name & ~brewery, "name_and_brewery_missing", "warning", "beer_name"),
        issue(~name & brewery, "name_missing", "warning", "beer_name"),
        issue(name & ~brewery, "brewery_missing", "warning", "brewery"),
    ]
    if {"price", "volume"} <= set(columns):
        price, volume = (F.trim(F.col(c).cast("string")).try_cast("double") for c in ("price", "volume"))
        both = truthy(price) & (volume > 0)
        found += [
            issue(both & (price < PER_LITRE[0] * volume), "per_litre_low", "warning", "price"),
            issue(both & (price > PER_LITRE[1] * volume), "per_litre_high", "warning", "price"),
        ]
    if "stock" in columns:
        found.append(issue(F.trim(F.col("stock").cast("string")).try_cast("double") < 0, "stock_negative", "error", "stock"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def validated(items: DataFrame) -> DataFrame:
    """``items`` with ``issues`` and ``is_valid``; invalid rows stay."""
    out = items.withColumn("issues", issues(items.columns))
    return out.withColumn("is_valid", ~F.exists("issues", lambda x: x["severity"] == "error"))


def totals(checked: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, errors, warnings."""
    count = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.coalesce(F.sum(count("error")), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(count("warning")), F.lit(0)).alias("warnings"),
    )


def order_lines_valid(lines: Column) -> Column:
    """An order's lines: at least one, each with an item and a whole quantity above 0."""
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x["item_id"].isNotNull() & F.coalesce(x["quantity"] > 0, F.lit(False)))


def waiting_beer_valid(name: Column) -> Column:
    """A beer that waits for a tap has a name."""
    return present(name)


# Patterns and greatest lengths of an item form's texts: fixed values.
FORM_NUMBER = r"^\d+([.,]\d+)?$"
FORM_LENGTHS = {"brewery": 100, "beer_name": 200, "style": 100, "ibu": 10, "format_type": 50, "stock": 50, "description": 1000}


def form_text_errors(columns: list[str]) -> Column:
    """Codes of what is wrong with an item form's texts: missing names, too long texts, numbers that are none, currencies not of three letters."""
    text = lambda c: F.col(c).cast("string")
    checks = [(F.length(F.coalesce(text(c), F.lit(""))) == 0, f"{c}_required") for c in ("brewery", "beer_name") if c in columns]
    checks += [(F.length(text(c)) > n, f"{c}_long") for c, n in FORM_LENGTHS.items() if c in columns]
    checks += [(~text(c).rlike(FORM_NUMBER), f"{c}_number") for c in ("abv", "price", "volume") if c in columns]
    checks += [(F.length("currency") != 3, "currency_length")] if "currency" in columns else []
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda x: x.isNotNull())


def is_permutation(ids: Column, of: Column) -> Column:
    """The same ids, each once."""
    return (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(ids, of)) == 0) & (F.size(F.array_except(of, ids)) == 0)
