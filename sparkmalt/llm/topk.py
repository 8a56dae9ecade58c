"""Exact top-k search by inner product, screened by statistics of segments.

Vectors are cut into segments at several resolutions. Means and deviations of
the segments bound a distance from below, and so an inner product from above:
``|q - x|^2 >= sum(n * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2))`` over segments
of n components. Going from coarse to fine, candidates whose bound can't reach
the k-th best score known so far are dropped; the others get exact scores.

Queries are dealt to blocks and candidates to slices of bounded size; a cell of
this grid is one task's work, and the best of each cell are merged. Equal vectors
are one candidate with its smallest ids, cut before anything is shuffled, so many
copies of a vector cost no more than a few.

Components are whole numbers held as doubles. A shorter vector counts as if
zeros followed. Vectors that are null or hold null or non-finite components take
no part; an empty vector scores 0. Null ids are never queries and come last among
ties; every row is a candidate of every query but of its own, so repeated rows
find each other and each answers for itself. Scores beyond a long are cut to its
limits, and so may tie. Empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16384  # queries of a block and candidates of a slice at most, on average
CHUNK = 128  # queries that are screened at once
LEVELS = (1, 4, 16, 32)  # segments, coarse to fine
PROBES = 4  # candidates beyond k that get exact scores at each level, to raise the limit
SLACK = 1e-9  # of the norms' product: more than rounding can take from a bound
EXACT = 2.0**53
LONG = 2**63 - 1
FOUND = "query_id long, tag long, copies long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column."""
    values, ends = np.asarray(column.flatten(), dtype=np.float64), np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))
    return np.split(values, ends[:-1]) if len(ends) else []


def by_width(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for vectors of like width, padded with zeros to a power of two."""
    width = np.array([1 << max(0, int(len(v) - 1).bit_length()) for v in vectors], dtype=np.int64)
    out = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        m = np.zeros((len(at), w))
        for i, j in enumerate(at):
            m[i, : len(vectors[j])] = vectors[j]
        out.append((at, m))
    return out


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Weighted means and deviations of a matrix's segments: the product of two such rows bounds an inner product."""
    cut = m.reshape(len(m), segments, -1)
    return np.concatenate([cut.mean(axis=2), cut.std(axis=2)], axis=1) * np.sqrt(cut.shape[2])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of vector q with rows of x; Python's whole numbers where doubles could round."""
    if len(x) == 0 or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * len(q) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(c) for c in q]
    return np.array([max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(whole, row, strict=True)))) for row in x], dtype=object)


class Best:
    """The best scores of one query so far: exact scores by candidate, and the k-th of them as the limit."""

    def __init__(self, k: int, barred: int) -> None:
        self.k, self.barred, self.scores, self.limit = k, barred, {}, -np.inf

    def add(self, at: np.ndarray, scores: np.ndarray) -> None:
        free = at != self.barred
        at, scores = at[free], scores[free]
        if len(at) > self.k:
            high = scores >= np.sort(scores)[-self.k]
            at, scores = at[high], scores[high]
        self.scores.update(zip(at.tolist(), scores.tolist(), strict=True))
        if len(self.scores) >= self.k:
            self.limit = sorted(self.scores.values(), reverse=True)[self.k - 1]

    def kept(self) -> list[tuple[int, int]]:
        """(candidate, score) of all that reach the limit, ties included."""
        return [(i, s) for i, s in self.scores.items() if s >= self.limit]


def screened(q: np.ndarray, x: np.ndarray, places: np.ndarray, best: list[Best], k: int) -> None:
    """Adds to ``best`` (one for each row of q) the exact scores of the candidates that no level of the bounds drops."""
    norms = np.linalg.norm(x, axis=1)
    levels = [s for s in LEVELS if s <= x.shape[1]]
    of_x = [statistics(x, s) for s in levels]
    for begin in range(0, len(q), CHUNK):
        part, mine = q[begin : begin + CHUNK], best[begin : begin + CHUNK]
        slack = SLACK * np.linalg.norm(part, axis=1)[:, None] * norms[None, :] + SLACK
        alive = np.ones((len(part), len(x)), dtype=bool)
        for s, stats in zip(levels, of_x, strict=True):
            columns = np.flatnonzero(alive.any(axis=0))
            bound = statistics(part, s) @ stats[columns].T + slack[:, columns]
            bound[~alive[:, columns]] = -np.inf
            first = min(len(columns), k + PROBES)
            probes = np.argpartition(-bound, first - 1, axis=1)[:, :first] if first else np.zeros((len(part), 0), dtype=np.int64)
            for i, b in enumerate(mine):
                at = columns[probes[i]]
                at = at[alive[i, at]]
                b.add(places[at], products(part[i], x[at]))
            limit = np.array([float(b.limit) for b in mine])[:, None]
            alive[:, columns] &= bound >= limit
        for i, b in enumerate(mine):
            at = np.flatnonzero(alive[i])
            b.add(places[at], products(part[i], x[at]))


def cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of each query of a cell, with ties at the last place cut by id."""
    asked, held = rows_of(queries["vector"].combine_chunks()), rows_of(candidates["vector"].combine_chunks())
    ids = candidates["ids"].to_pylist()
    same = {(int(h), v.tobytes()): i for i, (h, v) in enumerate(zip(candidates["tag"].to_pylist(), held, strict=True))}
    known = list(zip(queries["query_id"].to_pylist(), queries["tag"].to_pylist(), queries["copies"].to_pylist(), strict=True))
    own = [same.get((tag, v.tobytes()), -1) for (_, tag, _), v in zip(known, asked, strict=True)]
    left = {}  # of a query's own vector the ids without one of its own
    for i, (o, (query_id, _, _)) in enumerate(zip(own, known, strict=True)):
        if o >= 0:
            left[i] = list(ids[o])
            if query_id in left[i]:
                left[i].remove(query_id)
    best = [Best(k, o if i in left and not left[i] else -1) for i, o in enumerate(own)]
    widths = by_width(held)
    for at, q in by_width(asked):
        for places, x in widths:
            width = min(q.shape[1], x.shape[1])
            screened(q[:, :width], x[:, :width], places, [best[i] for i in at], k)
    out: list[tuple] = []
    for i, (b, who) in enumerate(zip(best, known, strict=True)):
        every = [(-s, j is None, j or 0) for c, s in b.kept() for j in (left[i] if c == own[i] and i in left else ids[c])]
        out += [(*who, None if none else j, -s) for s, none, j in sorted(every)[:k]]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names=["query_id", "tag", "copies", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of ``vectors`` (vec_id, vector) the k of highest inner product with each of ``queries`` (same columns, rows of vectors).

    Ties go to smaller ids. A query's own row is no candidate of it.
    """
    spark = vectors.sparkSession
    tag = F.xxhash64("vector")
    clean = lambda df: df.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector"))).withColumn("tag", tag)
    w = Window.partitionBy("tag", "vector").orderBy(F.col("vec_id").asc_nulls_last())
    first = clean(vectors).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)
    held = first.groupBy("tag", "vector").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("nth"), F.col("vec_id")))), lambda x: x["vec_id"]).alias("ids"))
    asked = clean(queries).where("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("query_id"), "tag", "vector").agg(F.count("*").alias("copies"))
    n, most = vectors.count(), spark.sparkContext.defaultParallelism
    slices = max(1, -(-n // block), min(most, -(-n // 1024)))
    blocks = max(1, -(-queries.count() // block))
    numbers = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "tag"), F.lit(blocks)).cast("int")).withColumn("slice", numbers(slices))
    right = held.withColumn("slice", F.pmod(F.hash("tag"), F.lit(slices)).cast("int")).withColumn("block", numbers(blocks))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        return cell(a, b, k)

    found = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(best, FOUND)
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")
