"""The driver's tables seen as price-list items, order lines, parse runs and tap states.

Money is in whole cents: sums of integers come out the same in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = 20  # price lists that the parts are dealt over


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def money(c: Column) -> Column:
    return c / F.lit(100.0)


def half_up(c: Column, digits: int) -> Column:
    """Rounded halves up, in plain double arithmetic."""
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def local_day(c: Column, zone: str = "Europe/Moscow") -> Column:
    return F.to_date(F.from_utc_timestamp(c, zone))


def packaging_by_volume(volume: Column) -> Column:
    return F.when(volume >= 15, "кега").when(volume >= 8, "бутылка").otherwise("банка")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_id, sheet, brewery, beer_name, style, price_cents, price, currency, volume, format_type."""
    c = F.col
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("id"),
        (c("p_partkey") % FILES).alias("file_id"),
        c("p_type").alias("sheet"),
        c("p_brand").alias("brewery"),
        c("p_name").alias("beer_name"),
        c("p_type").alias("style"),
        cents(c("p_retailprice")).alias("price_cents"),
        c("p_retailprice").alias("price"),
        F.lit("RUB").alias("currency"),
        c("p_size").cast("double").alias("volume"),
        packaging_by_volume(c("p_size")).alias("format_type"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, created_at, day, customer_id."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"), local_day(F.col("o_orderdate")).alias("day"), F.col("o_custkey").alias("customer_id"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, line_no, item_id, quantity, price_cents (per piece), supplier_id; lines without an item id (null or 0) go, a quantity of 0 counts as 1."""
    rows = table(spark, sf_dir, "lineitem").where("l_partkey <> 0")
    quantity = F.coalesce(F.nullif(F.col("l_quantity").cast("long"), F.lit(0)), F.lit(1))
    rows = rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_id"), quantity.alias("quantity"), cents(F.col("l_extendedprice")).alias("cents"), F.col("l_suppkey").alias("supplier_id"))
    return rows.withColumn("price_cents", F.expr("(2 * cents + quantity) div (2 * quantity)")).drop("cents")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, created_at, file_id, status, delta (shadow parser against main parser), confidence_cents."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("file_id"),
        F.col("event_type").alias("status"),
        (F.get_json_object("props", "$.k").cast("long") - 50).alias("delta"),
        cents(F.col("value")).alias("confidence_cents"),
    )


def tap_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tap_id, created_at, state_id, brewery, beer_name, price: a tap's beer after each event; an error event empties it."""
    return states_of(table(spark, sf_dir, "events"))


def arriving_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the table's files."""
    schema = table(spark, sf_dir, "events").schema
    return states_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def states_of(events: DataFrame) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    filled = lambda c: F.when(kind == "error", F.lit("")).otherwise(c)
    return events.select(
        F.col("user_id").alias("tap_id"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("state_id"),
        filled(kind).alias("brewery"),
        filled(F.concat(F.lit("beer "), (k % 2).cast("string"))).alias("beer_name"),
        F.when(kind != "error", k % 5).alias("price"),
    )


# The same views as SQL, for the oracles.
ITEMS = """items AS (SELECT p_partkey AS id, p_partkey % 20 AS file_id, p_type AS sheet, p_brand AS brewery, p_name AS beer_name,
    p_type AS style, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, p_retailprice AS price, 'RUB' AS currency,
    CAST(p_size AS DOUBLE) AS volume,
    CASE WHEN p_size >= 15 THEN 'кега' WHEN p_size >= 8 THEN 'бутылка' ELSE 'банка' END AS format_type FROM part)"""
ORDERS = "ords AS (SELECT o_orderkey AS order_id, o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS day, o_custkey AS customer_id FROM orders)"
LINES = """lines AS (SELECT order_id, line_no, item_id, quantity, (2 * cents + quantity) // (2 * quantity) AS price_cents, supplier_id
    FROM (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS item_id,
        coalesce(nullif(CAST(l_quantity AS BIGINT), 0), 1) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
        l_suppkey AS supplier_id FROM lineitem WHERE l_partkey <> 0))"""
RUNS = """runs AS (SELECT event_id AS run_id, ts AS created_at, user_id AS file_id, event_type AS status,
    CAST(json_extract_string(props, '$.k') AS BIGINT) - 50 AS delta, CAST(round(value * 100) AS BIGINT) AS confidence_cents FROM events)"""
STATES = """states AS (SELECT user_id AS tap_id, ts AS created_at, event_id AS state_id,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS brewery,
    CASE WHEN event_type = 'error' THEN '' ELSE 'beer ' || (k % 2) END AS beer_name,
    CASE WHEN event_type <> 'error' THEN k % 5 END AS price
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def half_up_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"
