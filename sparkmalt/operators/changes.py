"""Change capture, upserts and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean, truthy
from sparkmalt.operators import scan

# brewery, beer_name, price of a state
State = tuple[Column, Column, Column]


def change_type(old: State, new: State) -> Column:
    """installed, removed, price_changed, updated, or null where nothing changed."""
    (ob, on, op), (nb, nn, np_) = [(clean(b), clean(n), p) for b, n, p in (old, new)]
    had, has = (ob != "") | (on != ""), (nb != "") | (nn != "")
    same, priced = (ob == nb) & (on == nn), ~op.eqNullSafe(np_)
    return (
        F.when(~had & has, "installed")
        .when(had & ~has, "removed")
        .when(same & priced & (truthy(op) | truthy(np_)), "price_changed")
        .when(~same & had & has, "installed")
        .when(~same | priced, "updated")
    )


def change_log(states: DataFrame, key: list[str], order: list[str], most: int = scan.MOST) -> DataFrame:
    """States (brewery, beer_name, price) with those before them and the kind of change; rows that change nothing go. Keys of over ``most`` rows are spread over tasks."""
    out = scan.scanned(states, key, order, before={f"old_{c}": F.col(c) for c in ("brewery", "beer_name", "price")}, most=most)
    kind = change_type((F.col("old_brewery"), F.col("old_beer_name"), F.col("old_price")), (F.col("brewery"), F.col("beer_name"), F.col("price")))
    return out.withColumn("change_type", kind).where(F.col("change_type").isNotNull())


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial maxima, no window."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")


def upserted(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``updates`` (one per key) in place of those of the same key."""
    return table.join(updates, keys, "left_anti").unionByName(updates)


def queue_shifted(c: DataFrame) -> DataFrame:
    """The first waiting beer (a label) becomes current, the second the first."""
    from sparkmalt.functions.display import parse_label

    next_ = parse_label(F.col("next_beer_1"))
    ready = clean(F.col("next_beer_1")) != ""
    moved = lambda new, old: F.when(ready, new).otherwise(old)
    return c.withColumns(
        {
            "brewery": moved(next_["brewery"], F.col("brewery")),
            "beer_name": moved(next_["name"], F.col("beer_name")),
            "price": moved(F.coalesce(next_["price"], F.col("price").cast("double")), F.col("price").cast("double")),
            "next_beer_1": moved(F.col("next_beer_2"), F.col("next_beer_1")),
            "next_beer_2": moved(F.lit(None).cast("string"), F.col("next_beer_2")),
        }
    )


def reordered(rows: DataFrame, ids: DataFrame, key: str, position: str) -> DataFrame:
    """``rows`` with positions from the arrays of ``ids`` (one row: ids), 1 for the first."""
    placed = ids.select(F.posexplode("ids").alias("__at", key)).select(key, (F.col("__at") + 1).alias("__at"))
    return rows.join(placed, key, "left").withColumn(position, F.coalesce("__at", position)).drop("__at")
