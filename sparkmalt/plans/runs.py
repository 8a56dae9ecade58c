"""Parse runs: drift between parsers, the canary gate, progress, mapping recommendations and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.operators import changes, mapping
from sparkmalt.plans import bound
from sparkmalt.plans.bound import half_up, half_up_sql
from sparkmalt.sources import registry



def newest(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def filtered(runs: DataFrame, file_id: int | None = None, status: str | None = None) -> DataFrame:
    out = runs if file_id is None else runs.where(F.col("file_id") == file_id)
    return out if status is None else out.where(F.col("status") == status)


def drift(runs: DataFrame, n: int = 200) -> DataFrame:
    """One row over the newest runs: total_runs, average_delta, max_abs_delta. A run without a shadow counts as a run."""
    last = newest(runs, n)
    return last.agg(F.count("*").alias("total_runs"), half_up(F.coalesce(F.sum("delta") / F.count("delta"), F.lit(0.0)), 3).alias("average_delta"), F.coalesce(F.max(F.abs("delta")), F.lit(0)).alias("max_abs_delta"))


def canary(runs: DataFrame, n: int = 20, most_delta: int = 20, least_confidence: float = 3.0) -> DataFrame:
    """One row: whether the newest runs let the new parser stay; no runs fail."""
    got = newest(runs, n).agg(F.count("*").alias("runs"), F.coalesce(F.max(F.abs("delta")), F.lit(0)).alias("max_abs_delta"), F.coalesce(F.sum("confidence_cents") / F.count("*") / 100, F.lit(0.0)).alias("confidence"))
    return got.withColumn("passed", (F.col("max_abs_delta") <= most_delta) & (F.col("confidence") >= least_confidence))


def progress(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Per file: its newest run and number of items, as a final state."""
    last = changes.latest(runs, ["file_id"], ["created_at", "run_id"]).select("file_id", "run_id", "status")
    counts = items.groupBy("file_id").agg(F.count("*").alias("items"))
    out = last.join(counts, "file_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return out.withColumn("state", F.when(F.col("status") == "error", "failed").when(F.col("items") > 0, "completed").otherwise("empty"))


def shadow(main: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Item counts of two parsers per file, their difference, and that as a share of the first (of 1 if it has none)."""
    a, b = main.groupBy(key).agg(F.count("*").alias("main_items")), other.groupBy(key).agg(F.count("*").alias("other_items"))
    out = a.join(b, key, "full").fillna(0, ["main_items", "other_items"])
    delta = F.col("other_items") - F.col("main_items")
    return out.withColumns({"delta": delta, "delta_pct": half_up(delta * F.lit(100.0) / F.greatest(F.col("main_items"), F.lit(1)), 2)})


def learned_layers(feedback: DataFrame, layers: DataFrame) -> DataFrame:
    """The mapping after accepted feedback joined it."""
    return registry.merged_layers(layers.unionByName(registry.learned(feedback)))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: a click accepts a heading for a field."""
    f = F.element_at(F.array(*map(F.lit, registry.FIELDS)), (F.col("user_id") % 12 + 1).cast("int"))
    return bound.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("supplier_id"), F.concat(F.lit(" Col "), (F.col("event_id") % 5).cast("string")).alias("source_column"), f.alias("suggested_field"), (F.col("event_type") == "click").alias("accepted"))


def layers(spark: SparkSession) -> DataFrame:
    rows = [("registry", f, w) for f, ws in registry.FIELDS.items() for w in ws[:2]]
    return spark.createDataFrame(rows, "layer string, field string, keyword string")


def mapping_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learned_layers(feedback(spark, sf_dir), layers(spark))
    return out.select("field", F.size("keywords").alias("keywords"), F.array_join("keywords", "|").alias("words"), "weight")


def mapping_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest heading accepted for each supplier and field."""
    rows = bound.table(spark, sf_dir, "events").where("event_type = 'click'")
    rows = rows.select("user_id", (F.col("event_id") % 7).alias("slot"), "event_id", F.concat(F.lit("col "), (F.col("event_id") % 5).cast("string")).alias("source_column"))
    return changes.latest(rows, ["user_id", "slot"], ["event_id"])


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of runs whose two best columns are close; the scores come as JSON."""
    c = F.col
    score = lambda k: F.format_string('{"index":%d,"header":"h%d","score":%d}', F.lit(k), F.lit(k), (c("event_id") * (k + 3)) % 11)
    payload = F.concat(F.lit('{"price":['), score(1), F.lit(","), score(2), F.lit(","), score(3), F.lit("]}"))
    told = bound.table(spark, sf_dir, "events").select(c("event_id").cast("string").alias("file_id"), F.lit("s").alias("sheet"), payload.alias("candidates"))
    one = told.select("file_id", "sheet", F.explode(F.from_json("candidates", "map<string,array<struct<index:int,header:string,score:double>>>")).alias("field", "list"))
    ranked = one.select("file_id", "sheet", "field", F.posexplode(F.sort_array(F.transform("list", lambda x: F.struct((-x["score"]).alias("minus"), x["index"].alias("col_idx"), x["header"].alias("header"), x["score"].alias("score"))))).alias("at", "x"))
    return mapping.recommendations(ranked.select("file_id", "sheet", "field", (c("at") + 1).alias("rank"), "x.col_idx", "x.header", "x.score"))


QUERIES = {
    "run_filter": lambda s, d: newest(filtered(bound.runs(s, d), 7), 100).select("run_id", "status", "delta"),
    "drift": lambda s, d: drift(bound.runs(s, d)),
    "canary_gate": lambda s, d: canary(bound.runs(s, d)),
    "run_progress": lambda s, d: progress(bound.runs(s, d), bound.items(s, d)),
    "shadow_delta": lambda s, d: shadow(bound.items(s, d).where("volume < 40"), bound.items(s, d).where("volume > 10"), "brewery"),
    "mapping_learned": mapping_learned,
    "mapping_upsert": mapping_upserted,
    "mapping_recommendations": recommended,
}
_SLOTS = ", ".join(f"'{f}'" for f in registry.FIELDS)
_LAYERS = " UNION ALL ".join(f"SELECT 'registry' AS layer, '{f}' AS field, '{w}' AS keyword" for f, ws in registry.FIELDS.items() for w in ws[:2])
_THREE = ", ".join(f"({k}, (event_id * {k + 3}) % 11)" for k in (1, 2, 3))
ORACLES = {
    "run_filter": f"WITH {bound.RUNS} SELECT run_id, status, delta FROM runs WHERE file_id = 7 ORDER BY created_at DESC, run_id DESC LIMIT 100",
    "drift": f"WITH {bound.RUNS}, l AS (SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 200) SELECT count(*) AS total_runs, {half_up_sql('sum(delta) / count(delta)', 3)} AS average_delta, max(abs(delta)) AS max_abs_delta FROM l",
    "canary_gate": f"WITH {bound.RUNS}, l AS (SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 20), a AS (SELECT count(*) AS runs, max(abs(delta)) AS max_abs_delta, sum(confidence_cents) / count(*) / 100 AS confidence FROM l) SELECT *, max_abs_delta <= 20 AND confidence >= 3 AS passed FROM a",
    "run_progress": f"WITH {bound.RUNS}, {bound.ITEMS}, l AS (SELECT file_id, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, run_id DESC) = 1) SELECT file_id, run_id, status, count(id) AS items, CASE WHEN status = 'error' THEN 'failed' WHEN count(id) > 0 THEN 'completed' ELSE 'empty' END AS state FROM l LEFT JOIN items USING (file_id) GROUP BY 1, 2, 3",
    "shadow_delta": f"WITH {bound.ITEMS}, c AS (SELECT brewery, count(*) FILTER (volume < 40) AS main_items, count(*) FILTER (volume > 10) AS other_items FROM items GROUP BY 1) SELECT *, other_items - main_items AS delta, {half_up_sql('(other_items - main_items) * 100.0 / greatest(main_items, 1)', 2)} AS delta_pct FROM c",
    "mapping_learned": f"WITH l AS ({_LAYERS} UNION ALL SELECT CASE WHEN user_id % 3 > 0 THEN 'supplier' ELSE 'global' END, ([{_SLOTS}])[user_id % 12 + 1], 'col ' || (event_id % 5) FROM events WHERE event_type = 'click'), d AS (SELECT DISTINCT field, keyword FROM l) SELECT field, count(*)::INT AS keywords, string_agg(keyword, '|' ORDER BY keyword) AS words, (SELECT max(CASE WHEN layer = 'registry' THEN 1.0::DOUBLE ELSE 1.35::DOUBLE END) FROM l WHERE l.field = d.field) AS weight FROM d GROUP BY field",
    "mapping_upsert": "SELECT user_id, event_id % 7 AS slot, event_id, 'col ' || (event_id % 5) AS source_column FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id DESC) = 1",
    "mapping_recommendations": f"WITH c AS (SELECT event_id, unnest([{_THREE}]) AS x FROM events), r AS (SELECT event_id, x[1]::INT AS k, x[2]::DOUBLE AS s, row_number() OVER (PARTITION BY event_id ORDER BY x[2] DESC, x[1]) AS n FROM c), p AS (SELECT event_id::VARCHAR AS file_id, 's' AS sheet, 'price' AS field, max(CASE WHEN n = 1 THEN k END) AS col_idx, max(CASE WHEN n = 1 THEN s END) AS score, max(CASE WHEN n = 2 THEN k END) AS k2, max(CASE WHEN n = 2 THEN s END) AS second_score FROM r GROUP BY 1) SELECT file_id, sheet, field, 'h' || col_idx AS header, col_idx, score, 'h' || k2 AS second_header, second_score FROM p WHERE score >= 1 AND score - second_score <= 1",
}
