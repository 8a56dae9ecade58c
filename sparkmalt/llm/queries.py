"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.llm import centroids, chat, decontaminate, lm, neardup, pieces, quality, shards, substrings, topk, toxicity, turns, warc
from sparkmalt.llm.store import table


def bpe_model() -> str:
    """Path of the public BPE model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, lm.train(docs), carry=["doc_id"])
    return out.select("doc_id", "pseudo.n_words", "pseudo.log_prob", "pseudo.mean_log_prob")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept_text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_decode(docs, bpe_model())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    one = out.select("doc_id", F.explode("matches").alias("m"))
    return one.select("doc_id", F.col("m.item").alias("item_id"), "m.score", F.col("m.question").alias("question_overlap"), F.col("m.answer").alias("answer_overlap"), F.col("m.word").alias("passage_word"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    out = toxicity.apply(docs, lexicon, out="score", carry=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(trap).alias("text"),
    )
    out = chat.format_chats(told.unionByName(extra))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = quality.rule_stats(docs, carry=["doc_id"])
    out = quality.apply(stats, quality.fit(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[F.col(f"rules.{c}").alias(c) for c in quality.COUNTS], "rules.base_failed", "rules.anomaly", "rules.kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shards.shuffled_shards(docs, 8, seed=11).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shards.shard_of(F.col("doc_id"), 9, 11).alias("grown_shard"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def whole_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vector) of ``embeddings``, components as whole 256ths; what no long can hold is whole already, or not finite."""
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: whole(256 * x.cast("double"))).alias("vector"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark, sf_dir)
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every, found = told.select(F.col("conv_id").alias("id")).distinct(), turns.reports(turns.damaged(told))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(found, every["id"].eqNullSafe(found["conv_id"]), "left").select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(whole_vectors(spark, sf_dir), k=40, rounds=5, dim=64, seed=2, limited=False)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_chat": op6_chat,
    "op7_minhash": op7_minhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_topk": op11_topk,
    "op12_turn_repair": op12_turn_repair,
    "op13_centroids": op13_centroids,
}


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """SQL of op13: a pair of steps for each round, assignment and means, and a last assignment."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rn, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min(CAST(list_inner_product(v.x, v.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x) AS BIGINT) * {k} + c.k) AS d FROM v, c{i} c GROUP BY rn)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT d % {k} AS k, pos, sum(CAST(x[pos] AS BIGINT)) AS s, count(*) AS n FROM a{i}, range(1, 65) t(pos) GROUP BY ALL)""")
            steps.append(f"""n{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS DOUBLE) ORDER BY pos) AS x FROM m{i} GROUP BY k)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n ON c.k = n.k)""")
    return f"""WITH {", ".join(steps)},
        f AS (SELECT vec_id, d % {k} AS k, d // {k} AS distance FROM a{rounds})
        SELECT f.vec_id, CAST(f.k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
        FROM f JOIN c{rounds} c ON f.k = c.k"""


ORACLES: dict[str, str] = {
    "op11_topk": """
        WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.rn <> c.rn WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS place FROM s)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
    """,
    # the least (cost, audit) of every state after every row; roles follow from the audit, as they take turns
    "op12_turn_repair": """
        WITH RECURSIVE told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, e: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS kind FROM told),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM crc, range(1, 3) t(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j, left(role, 1) AS i,
            regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM d),
        r AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
            lag(i) OVER (PARTITION BY conv_id ORDER BY j) || i AS pair FROM o),
        facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
        put(before, after, n) AS (VALUES ('', 's', 0), ('', 'u', 0), ('', 'a', 1), ('', '', 0), ('s', 'u', 0), ('s', 'a', 1), ('s', '', 2), ('u', 'u', 1), ('u', 'a', 0), ('u', '', 1), ('a', 'u', 0), ('a', 'a', 1), ('a', '', 0)),
        ways AS (SELECT conv_id, j, i AS after, 'K' AS edit, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS price FROM r WHERE fault IS NULL OR fault = 'truncated'
            UNION ALL SELECT conv_id, j, x, 'R', CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END FROM r, (VALUES ('u'), ('a')) t(x) WHERE fault IS NULL OR fault = 'truncated'),
        dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS j, '' AS state, '0000000000' AS way FROM facts
            UNION ALL
            SELECT conv_id, j, state, min(way) FROM (
                SELECT dp.conv_id, ways.j, ways.after AS state, lpad(CAST(CAST(left(way, 10) AS BIGINT) + 3 * put.n + price AS VARCHAR), 10, '0') || substr(way, 11) || repeat('I', put.n) || edit AS way
                FROM dp JOIN ways ON dp.conv_id IS NOT DISTINCT FROM ways.conv_id AND ways.j = dp.j + 1 JOIN put ON put.before = dp.state AND put.after = ways.after AND ways.after <> ''
                UNION ALL
                SELECT dp.conv_id, dp.j + 1, dp.state, lpad(CAST(CAST(left(way, 10) AS BIGINT) + 4 AS VARCHAR), 10, '0') || substr(way, 11) || 'D' FROM dp JOIN facts ON dp.conv_id IS NOT DISTINCT FROM facts.conv_id AND dp.j < n) GROUP BY conv_id, j, state),
        ends AS (SELECT dp.conv_id, min(lpad(CAST(CAST(left(way, 10) AS BIGINT) + 3 * put.n AS VARCHAR), 10, '0') || substr(way, 11) || repeat('I', put.n)) AS way
            FROM dp JOIN facts ON dp.conv_id IS NOT DISTINCT FROM facts.conv_id AND dp.j = n JOIN put ON put.before = dp.state AND put.after = '' GROUP BY dp.conv_id),
        letters AS (SELECT conv_id, p, substr(way, 10 + p, 1) AS edit, length(replace(left(substr(way, 11), p), 'I', '')) AS j, length(replace(left(substr(way, 11), p), 'D', '')) AS nth FROM ends, range(1, 100000) t(p) WHERE p <= length(way) - 10),
        turns AS (SELECT letters.*, r.role, r.text, r.i, max(CASE WHEN edit = 'K' AND nth = 1 AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY letters.conv_id) AS system
            FROM letters LEFT JOIN r ON edit <> 'I' AND letters.conv_id IS NOT DISTINCT FROM r.conv_id AND letters.j = r.j),
        texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM turns WHERE edit <> 'D' GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(CAST(left(way, 10) AS BIGINT), 0) AS cost, coalesce(substr(way, 11), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON c.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN ends ON c.conv_id IS NOT DISTINCT FROM ends.conv_id LEFT JOIN texts ON c.conv_id IS NOT DISTINCT FROM texts.conv_id
    """,
    "op13_centroids": clusters_sql(),
    "op6_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
            length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h')) AS role_chars,
            length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) AS text_chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(text_chars + CASE WHEN before IS NULL THEN 11 + role_chars WHEN before = role THEN 7 ELSE 19 + role_chars END) + 8 AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
        f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
               CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first < page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON n >= 100 AND d.h = f.h
    """,
}
