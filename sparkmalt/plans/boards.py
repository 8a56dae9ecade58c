"""Tap boards: taps per location, positions, layout, history of changes, waiting beers, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt import streaming
from sparkmalt.functions.text import contains_ci
from sparkmalt.operators import changes, quality, scan
from sparkmalt.plans import bound
from sparkmalt.sources import shared, sinks

STATUS = {"active": "На кране", "free": "Свободен", "next": "Следующий", "fresh": "Свежий"}  # fixed values
TAP_FIELDS = ["brewery", "beer_name", "description", "abv_text", "volume_price_text", "bitterness_ibu", "next_beer_1", "next_beer_2"]


def with_tap_count(locations: DataFrame, taps: DataFrame) -> DataFrame:
    """Locations with their number of taps, 0 included; taps are counted before the join."""
    counts = taps.groupBy("location_id").agg(F.count("*").alias("n"))
    return locations.join(counts, "location_id", "left").select(*locations.columns, F.coalesce("n", F.lit(0)).alias("tap_count"))


def with_taps(locations: DataFrame, taps: DataFrame) -> DataFrame:
    """Locations with the array of their taps in order; a board has tens of taps."""
    listed = taps.groupBy("location_id").agg(F.sort_array(F.collect_list(F.struct("position", "tap_id", "beer_name"))).alias("taps"))
    return locations.join(listed, "location_id", "left").withColumn("taps", F.coalesce("taps", F.array().cast(listed.schema["taps"].dataType)))


def waiting(beers: DataFrame, location: int) -> DataFrame:
    """The beers that wait at a location; those without a name can't be put on a tap."""
    return beers.where((F.col("location_id") == location) & quality.waiting_beer_valid(F.col("beer_name")))


def board(taps: DataFrame) -> DataFrame:
    """Taps with the text of their status."""
    text = F.lit("")
    for code, shown in STATUS.items():
        text = F.when(F.col("status") == code, F.lit(shown)).otherwise(text)
    return taps.withColumn("status_text", text)


def next_position(locations: DataFrame, taps: DataFrame) -> DataFrame:
    """The next free position of each location, 1 for an empty one."""
    top = taps.groupBy("location_id").agg(F.max("position").alias("top"))
    return locations.join(top, "location_id", "left").select("location_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_position"))


def layout(taps: DataFrame, columns: int = 3, most: int = scan.MOST) -> DataFrame:
    """Column and row of each tap when a location's board is filled column by column; a board of over ``most`` taps is spread over tasks."""
    counted = scan.scanned(taps, ["location_id"], ["position", "tap_id"], place="__nth", total="__all", most=most)
    placed = counted.withColumns({"__rows": F.ceil(F.col("__all") / columns).cast("int"), "__at": F.col("__nth") - 1}).drop("__nth", "__all")
    return placed.withColumns({"board_column": F.floor(F.col("__at") / F.col("__rows")).cast("int"), "board_row": (F.col("__at") % F.col("__rows")).cast("int")}).drop("__rows", "__at")


def searched(taps: DataFrame, text: str, fields: list[str] = TAP_FIELDS, visible_only: bool = True) -> DataFrame:
    found = F.lit(False)
    for f in fields:
        if f in taps.columns:
            found = found | contains_ci(F.col(f), text)
    return taps.where(found & (F.col("is_visible") if visible_only else F.lit(True)))


def kegs_for_board(wanted: DataFrame, items: DataFrame, keg: Column) -> DataFrame:
    """Beers for a board with the item that they come from; known items must be kegs, unknown ones stay."""
    known = items.select(F.col("id").alias("source_item_id"), F.col("beer_name").alias("item_name"), keg.alias("__keg"))
    out = wanted.join(known, "source_item_id", "left")
    return out.where(F.col("__keg").isNull() | F.col("__keg")).drop("__keg")


def history(states: DataFrame) -> DataFrame:
    return changes.change_log(states, ["tap_id"], ["created_at", "state_id"])


def latest_history(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("state_id")).limit(n)


def taps(spark: SparkSession, sf_dir: str, most: int = scan.MOST) -> DataFrame:
    """Suppliers as taps: location is the nation, position the order of keys in it."""
    c = F.col
    status = F.element_at(F.array(*map(F.lit, STATUS)), (c("s_suppkey") % 4 + 1).cast("int"))
    suppliers = bound.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal")
    return scan.scanned(suppliers, ["s_nationkey"], ["s_suppkey"], place="position", most=most).select(
        c("s_suppkey").alias("tap_id"),
        c("s_nationkey").alias("location_id"),
        "position",
        c("s_name").alias("beer_name"),
        F.lit("house").alias("brewery"),
        F.round(c("s_acctbal")).cast("double").alias("price"),
        status.alias("status"),
        (c("s_suppkey") % 5 > 0).alias("is_visible"),
        F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("Brew | Beer"), c("s_suppkey").cast("string"), F.lit("(7.5)"))).otherwise("").alias("next_beer_1"),
        F.concat(F.lit("Later | Beer"), c("s_suppkey").cast("string")).alias("next_beer_2"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("name"))


def upserted_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps after updates: first positions get a new beer, some positions are new."""
    have = taps(spark, sf_dir).select("location_id", "position", "beer_name")
    new = locations(spark, sf_dir).select("location_id", F.explode(F.array(F.lit(1), F.lit(999))).alias("position"), F.lit("guest").alias("beer_name"))
    return changes.upserted(have, new, ["location_id", "position"])


def reordered_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taps of each location in reverse order; only whole permutations are taken: every third location asks for one tap twice and keeps its order."""
    have = taps(spark, sf_dir)
    ids = have.groupBy("location_id").agg(F.sort_array(F.collect_list("tap_id"), asc=False).alias("ids"), F.collect_list("tap_id").alias("of"))
    ids = ids.withColumn("ids", F.when(F.col("location_id") % 3 == 0, F.concat("ids", F.slice("ids", 1, 1))).otherwise(F.col("ids")))
    good = ids.where(quality.is_permutation(F.col("ids"), F.col("of")))
    return changes.reordered(have, good, "tap_id", "position").select("tap_id", "location_id", "position")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmalt.functions.display import looks_like_keg

    wanted = bound.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), (F.col("s_suppkey") * 37).alias("source_item_id"))
    return kegs_for_board(wanted, bound.items(spark, sf_dir), looks_like_keg(F.col("format_type"), F.col("volume")))


LARGE = 2000  # rows of a key that the two queries below leave to one task


def queue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three queues, one for each status, with their places and the queues' lengths."""
    rows = bound.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    out = scan.scanned(rows, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], place="place", total="length", most=LARGE)
    return out.select(F.col("o_orderkey").alias("order_id"), "place", "length")


def busy_tap_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of two taps that all events happen at."""
    states = bound.tap_states(spark, sf_dir).withColumn("tap_id", F.col("tap_id") % 2)
    return changes.change_log(states, ["tap_id"], ["created_at", "state_id"], most=LARGE).select("tap_id", "state_id", "change_type", "old_beer_name", "old_price")


def streamed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log from a stream of the events."""
    out = shared.fresh(spark, "changes")
    streaming.log_changes(bound.arriving_states(spark, sf_dir), out, shared.fresh(spark, "changes-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("tap_id", "state_id", "change_type", "old_beer_name", "beer_name", "old_price", "price")


QUERIES = {
    "streamed_changes": streamed_changes,
    "queue_places": queue_places,
    "busy_tap_changes": busy_tap_changes,
    "location_counts": lambda s, d: with_tap_count(locations(s, d), taps(s, d)),
    "tap_board": lambda s, d: board(taps(s, d)).select("tap_id", "location_id", "position", "status_text"),
    "next_position": lambda s, d: next_position(locations(s, d), taps(s, d)),
    "board_layout": lambda s, d: layout(taps(s, d)).select("tap_id", "board_column", "board_row"),
    "tap_search": lambda s, d: searched(taps(s, d), "#0000000").select("tap_id", "beer_name"),
    "board_requests": _requests,
    "change_log": lambda s, d: history(bound.tap_states(s, d)).select("tap_id", "state_id", "change_type", "old_beer_name", "beer_name", "old_price", "price"),
    "tap_history": lambda s, d: latest_history(history(bound.tap_states(s, d))).select("tap_id", "state_id", "change_type"),
    "latest_state": lambda s, d: changes.latest(bound.tap_states(s, d), ["tap_id"], ["created_at", "state_id"]).select("tap_id", "state_id", "brewery", "beer_name", "price"),
    "queue_shift": lambda s, d: changes.queue_shifted(taps(s, d)).select("tap_id", "brewery", "beer_name", "price", "next_beer_1", "next_beer_2"),
    "tap_export": lambda s, d: board(taps(s, d)).select("tap_id", sinks.csv_line(["position", "brewery", "beer_name", "status_text", "next_beer_1"]).alias("line")),
    "tap_upsert": upserted_taps,
    "tap_reorder": reordered_taps,
}
_TAPS = """taps AS (SELECT s_suppkey AS tap_id, s_nationkey AS location_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS position,
    s_name AS beer_name, round(s_acctbal) AS price, s_suppkey % 5 > 0 AS is_visible FROM supplier)"""
_LOG = f"""WITH {bound.STATES}, p AS (SELECT *, lag(brewery) OVER w AS ob, lag(beer_name) OVER w AS old_beer_name, lag(price) OVER w AS old_price FROM states
    WINDOW w AS (PARTITION BY tap_id ORDER BY created_at, state_id)),
  q AS (SELECT *, coalesce(ob, '') <> '' AS had, brewery <> '' AS has, coalesce(ob, '') = brewery AND coalesce(old_beer_name, '') = beer_name AS same,
    old_price IS DISTINCT FROM price AS priced, coalesce(old_price, 0) <> 0 OR coalesce(price, 0) <> 0 AS any_price FROM p),
  log AS (SELECT *, CASE WHEN NOT had AND has THEN 'installed' WHEN had AND NOT has THEN 'removed' WHEN same AND priced AND any_price THEN 'price_changed'
    WHEN NOT same AND had AND has THEN 'installed' WHEN NOT same OR priced THEN 'updated' END AS change_type FROM q) """
ORACLES = {
    "queue_places": "SELECT o_orderkey AS order_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)::INT AS place, count(*) OVER (PARTITION BY o_orderstatus) AS length FROM orders",
    "busy_tap_changes": _LOG.replace("PARTITION BY tap_id", "PARTITION BY tap_id % 2") + "SELECT tap_id % 2 AS tap_id, state_id, change_type, old_beer_name, old_price FROM log WHERE change_type IS NOT NULL",
    "location_counts": f"WITH {_TAPS} SELECT n_nationkey AS location_id, n_name AS name, count(tap_id) AS tap_count FROM nation LEFT JOIN taps ON location_id = n_nationkey GROUP BY 1, 2",
    "tap_board": f"WITH {_TAPS} SELECT tap_id, location_id, position, CASE tap_id % 4 WHEN 0 THEN 'На кране' WHEN 1 THEN 'Свободен' WHEN 2 THEN 'Следующий' ELSE 'Свежий' END AS status_text FROM taps",
    "next_position": f"WITH {_TAPS} SELECT n_nationkey AS location_id, coalesce(max(position), 0) + 1 AS next_position FROM nation LEFT JOIN taps ON location_id = n_nationkey GROUP BY 1",
    "board_layout": f"WITH {_TAPS}, b AS (SELECT tap_id, position - 1 AS a, CAST(ceil(count(*) OVER (PARTITION BY location_id) / 3.0) AS INT) AS n FROM taps) SELECT tap_id, a // n AS board_column, a % n AS board_row FROM b",
    "tap_search": f"WITH {_TAPS} SELECT tap_id, beer_name FROM taps WHERE is_visible AND contains(lower(beer_name), '#0000000')",
    "board_requests": f"WITH {bound.ITEMS} SELECT s_suppkey AS request_id, s_suppkey * 37 AS source_item_id, beer_name AS item_name FROM supplier LEFT JOIN items ON id = s_suppkey * 37 WHERE format_type IS NULL OR format_type = 'кега'",
    "streamed_changes": _LOG + "SELECT tap_id, state_id, change_type, old_beer_name, beer_name, old_price, price FROM log WHERE change_type IS NOT NULL",
    "change_log": _LOG + "SELECT tap_id, state_id, change_type, old_beer_name, beer_name, old_price, price FROM log WHERE change_type IS NOT NULL",
    "tap_history": _LOG + "SELECT tap_id, state_id, change_type FROM log WHERE change_type IS NOT NULL ORDER BY created_at DESC, state_id DESC LIMIT 50",
    "latest_state": f"WITH {bound.STATES} SELECT tap_id, state_id, brewery, beer_name, price FROM states QUALIFY row_number() OVER (PARTITION BY tap_id ORDER BY created_at DESC, state_id DESC) = 1",
    "queue_shift": f"WITH {_TAPS} SELECT tap_id, CASE WHEN tap_id % 2 = 0 THEN 'Brew' ELSE 'house' END AS brewery, CASE WHEN tap_id % 2 = 0 THEN 'Beer' || tap_id ELSE beer_name END AS beer_name, CASE WHEN tap_id % 2 = 0 THEN 7.5::DOUBLE ELSE price END AS price, CASE WHEN tap_id % 2 = 0 THEN 'Later | Beer' || tap_id ELSE '' END AS next_beer_1, CASE WHEN tap_id % 2 <> 0 THEN 'Later | Beer' || tap_id END AS next_beer_2 FROM taps",
    "tap_upsert": f"WITH {_TAPS}, n AS (SELECT n_nationkey AS location_id, unnest([1, 999]) AS position, 'guest' AS beer_name FROM nation) SELECT location_id, position, beer_name FROM taps WHERE (location_id, position) NOT IN (SELECT location_id, position FROM n) UNION ALL SELECT * FROM n",
    "tap_reorder": f"WITH {_TAPS} SELECT tap_id, location_id, CASE WHEN location_id % 3 = 0 THEN position ELSE row_number() OVER (PARTITION BY location_id ORDER BY tap_id DESC)::INT END AS position FROM taps",
    "tap_export": f"WITH {_TAPS} SELECT tap_id, position || ',house,' || beer_name || ',' || ['На кране', 'Свободен', 'Следующий', 'Свежий'][tap_id % 4 + 1] || ',' || CASE WHEN tap_id % 2 = 0 THEN 'Brew | Beer' || tap_id || '(7.5)' ELSE '' END AS line FROM taps",
}
