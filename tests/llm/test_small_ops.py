"""Chat formatting, sharding, WARC: exact round trips and laws."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkmalt.llm import chat, queries, shards, warc
from tests.llm.fixtures import SF, hostile


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_query(spark):
    told = defaultdict(list)
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        told[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    trap = "\\### Assistant: </turn> ok"
    told[-7] = [(0, "user", trap), (1, "assistant", trap)]
    got = {r["conv_id"]: r for r in queries.op6_chat(spark, SF).collect()}
    assert set(got) == set(told)
    for conv, turns in told.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss))


def test_chat_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert Counter(tuple(r) for r in queries.op6_chat(spark, SF).collect()) == Counter(con.execute(queries.ORACLES["op6_chat"]).fetchall())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<says>\n"), (1, 1, "user", "\\l\\h\\b<also>\n"), (1, 2, "assistant", ""), (1, 3, "assistant", None), (1, 4, "### <says>\n", "x</turn>\n"), (1, 130, "user", "far"), (1, 131, None, None), (None, None, "user", "who"), (1, 131, None, None), (2, 5, "assistant", "only")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"), F.array_join("segments.text", "").alias("whole")).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert all(r["whole"] == r["formatted"] for r in got.values())
    assert got[2]["learned"] == "only" and got[1]["learned"] == ""
    assert got[1]["formatted"].count("### user") == 2  # neighbours of one role share a block
    assert chat.format_chats(df.limit(0)).count() == 0


def test_sharding_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = queries.op9_sharding(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(8)) and any(r["grown_shard"] == 8 for r in rows)


def test_shards_are_those_of_greatest_hash(spark):
    """``shard`` and ``grown_shard`` against the hashes themselves, one by one."""
    rows = queries.op9_sharding(spark, SF).collect()
    ids = spark.createDataFrame([(r["doc_id"], i) for r in rows for i in range(9)], "k long, i int")
    hashes = {(r["k"], r["i"]): r["h"] for r in ids.select("k", "i", F.xxhash64(F.lit(11), F.col("i"), F.col("k")).alias("h")).collect()}
    for r in rows:
        best = lambda n: max(range(n), key=lambda i: hashes[r["doc_id"], i])  # noqa: B023, E731
        assert r["shard"] == best(8) and r["grown_shard"] == best(9)


def test_many_copies_of_a_row_spread(spark):
    """A row that is repeated far beyond a bucket's size lies in many buckets; nothing is lost and reruns agree."""
    rows = [(None, "the same text again"), *[(i, f"text {i}") for i in range(50)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("n", F.when(F.col("doc_id").isNull(), 3000).otherwise(1)).withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "x")
    seen = []
    for parts in (1, 7):
        out = shards.shuffled_shards(docs.repartition(parts), 2, bucket_bytes=8192).collect()
        assert len(out) == 3050
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        seen.append(Counter((r["shard"], r["slot"], r["doc_id"]) for r in out))
    assert seen[0] == seen[1]


def test_sharding_hostile_and_repeatable(spark):
    docs = hostile(spark).withColumnRenamed("n", "shard")
    seen = []
    for parts in (1, 5):
        out = shards.shuffled_shards(docs.repartition(parts), 3, bucket_bytes=4096)
        rows = out.collect()
        assert len(rows) == docs.count()
        seen.append(sorted((r["shard"], r["slot"], r["doc_id"] or -1, r["text"] or "") for r in rows))
    assert seen[0] == seen[1]
    order = [x[2] for x in seen[0]]
    assert order != sorted(order)
    assert shards.shuffled_shards(docs.limit(0)).count() == 0


def test_warc_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = Counter(con.execute(queries.ORACLES["op10_warc"]).fetchall())
    assert Counter(tuple(r) for r in queries.op10_warc(spark, SF).collect()) == want


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 30
    rows = [(5, "http://a/ü x", big), (3, None, big), (9, "http://b", big), (9, "http://b", big), (4, "http://c\r\nX: y", "a" * 99), (6, "u", "a" * 99), (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "line\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write(df, archive_bytes=700)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 1
    got = warc.read(index).collect()
    by = {r["page_id"]: r for r in got}
    assert Counter((r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got) == Counter((i, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in rows)
    assert by[3]["record_type"] == "response" and by[5]["refers_to"] == 3 and by[9]["refers_to"] == 3
    assert by[4]["record_type"] == by[6]["record_type"] == "response" and by[None]["record_type"] == "response"
    assert bytes(by[10]["payload"]).decode() == rows[-1][2]
    assert [bytes(r["payload"]).decode() for r in warc.read(index.where("page_id = 4")).collect()] == ["a" * 99]
    assert warc.read(warc.write(df.limit(0))).count() == 0
