"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly, by seeded hashes, into buckets that fit
in memory, each bucket to one task; pass two shuffles each bucket with
Fisher-Yates and writes it. The
shard is the one whose seeded hash with the key is greatest (rendezvous
hashing), so the key and the number of shards decide it, and one more shard
takes records only into itself.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkmalt.llm.store import fresh, spare, written

BUCKET_BYTES, MOST_TASKS = 24 << 20, 100_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard, of 0 to ``shards`` - 1, whose hash with the key is greatest."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)])["i"]


def bytes_of(docs: DataFrame, columns: list[str]) -> Column:
    """Bytes that a row takes in memory, roughly: those of texts and binaries, and sixteen for each column."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in columns if docs.schema[c].dataType.typeName() in ("string", "binary")]
    return reduce(lambda a, b: a + b, texts, F.lit(16 * len(columns)).cast("long"))


def shuffled_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 11, bucket_bytes: int = BUCKET_BYTES, most_tasks: int = MOST_TASKS, path: str | None = None) -> DataFrame:
    """``docs`` written to ``path`` as Parquet, a folder per shard, and read back with ``shard`` and ``slot``.

    ``slot`` numbers the records of a shard without gaps from 0 in their
    shuffled order. A null text has size 0, a null key is a key like any other
    (so all such rows share a shard); repeated rows stay, each with a slot of
    its own (many copies of one row are numbered first, so that they spread over
    the shard's buckets); an empty table gives an empty table. Existing columns
    named ``shard`` or ``slot`` are replaced. The order depends on the seed and
    the rows only, not on how the input is split.
    """
    spark = docs.sparkSession
    path = path or fresh(spark, "shards")
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    column = {c: F.col(f"`{c}`") for c in own}
    bucket_, copy_, tie_, same_ = (spare(docs, c) for c in ("bucket", "copy", "tie", "same"))
    size = bytes_of(docs, own)
    rows = docs.select(*column.values(), shard_of(column[key], shards, seed).alias("shard"), F.xxhash64(F.lit(seed + 2), *column.values()).alias(tie_), F.lit(0).cast("long").alias(copy_))
    # one row per shard
    sizes = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum(size).alias("bytes")).collect()}
    counts = [max(1, math.ceil(sizes.get(i, 0) / bucket_bytes)) for i in range(shards)]
    firsts = np.concatenate(([0], np.cumsum(counts))).tolist()
    heavy = written(rows.groupBy(tie_).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > bucket_bytes / 2).select(F.col(tie_).alias(same_)), "heavy-rows")
    if heavy.take(1):
        same = F.col(tie_) == F.col(same_)
        copies = rows.join(heavy, same, "left_semi").groupBy(*column.values(), "shard", tie_).agg(F.count("*").alias(copy_))
        copies = copies.withColumn(copy_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy_))))
        rows = rows.join(heavy, same, "left_anti").unionByName(copies)
    of_shard = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)
    inside = F.pmod(F.xxhash64(F.lit(seed + 1), column[key], F.crc32(F.coalesce(column[text], F.lit(""))), copy_), of_shard(counts))
    scattered = rows.withColumn(bucket_, (of_shard(firsts[:-1]) + inside).cast("int"))
    # a number per bucket: at most one for each ``bucket_bytes`` of input, and ``shards`` more
    filled = np.zeros(firsts[-1], dtype=np.int64)
    for r in scattered.groupBy(bucket_).agg(F.count("*").alias("n")).collect():
        filled[r[bucket_]] = r["n"]
    before = np.concatenate(([0], np.cumsum(filled)))[:-1]
    shard_first = np.array(firsts)
    shared = spark.sparkContext.broadcast(before - np.repeat(before[shard_first[:-1]], counts))
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    arrow = to_arrow_schema(schema)

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            bucket = batch.column(len(own) + 1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in itertools.pairwise(edges):
                if held and bucket[a] != now:
                    yield from one(held, now)
                    held = []
                now = int(bucket[a]) if b > a else now
                held += [batch.slice(a, b - a)] if b > a else []
        if held:
            yield from one(held, now)

    def one(held: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        # rows come in a fixed order, so that a task that runs again gives the same permutation
        t = pa.Table.from_batches(held)
        order = np.arange(len(t))
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # numpy's shuffle is Fisher-Yates
        slot = pa.array(int(shared.value[bucket]) + np.arange(len(t)))
        out = pa.Table.from_arrays([*t.select(own).take(pa.array(order)).columns, t.column("shard"), slot], names=arrow.names)
        yield from out.cast(arrow).to_batches(max_chunksize=4096)

    # a bucket, or a few one after the other, to each task
    tasks = min(firsts[-1], most_tasks)
    dealt = scattered.repartitionById(tasks, F.floor(F.col(bucket_).cast("long") * tasks / firsts[-1]).cast("int")).sortWithinPartitions(bucket_, tie_, copy_)
    done = dealt.select(*column.values(), "shard", bucket_).mapInArrow(fisher_yates, schema)
    done.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path).select(*column.values(), "shard", "slot")
