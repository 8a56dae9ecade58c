"""Clustering of whole-number vectors around centroids, screened by norms of blocks.

Every vector is compressed once to the norms of its segments and written with
them. By Cauchy and Schwarz ``|x - c|^2 >= sum((|x_s| - |c_s|)^2)`` over segments,
so of a vector's centroids only those whose bound doesn't exceed the best distance
found get an exact distance, in whole numbers. Each round is one pass over the
written table: a task adds up its vectors by cluster, and clusters times components
sums, as many as the centroids have, go to the driver.

Kept are vectors of exactly ``dim`` components, none null or non-finite, whatever
their ids; others have no row. By default components beyond 2**27 count as 2**27, so
that a squared distance fits a long. Without that limit vectors with such components
are held beside the others as doubles, and what touches them is worked out in Python's
whole numbers: clusters and centroids are exact at any size, and a distance or sum that
no long can hold is null. Null ids hash to null and come last among the first
centroids; rows that repeat are vectors of their own. With fewer kept vectors than
centroids each is one. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmalt.functions.text import settled
from sparkmalt.llm.store import written
from sparkmalt.llm.topk import usable

SEGMENTS = 16
LIMIT = 2**27
SLACK = 1e-9
LIMB, MOST = 32, 2**63 - 1
ASSIGNED = "struct<cluster:int, distance:long>"


def matrix(column: pa.Array, dim: int, kind: type = np.int64) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(-1, dim)


def segment_norms(m: np.ndarray, segments: int) -> np.ndarray:
    """Norms of a matrix's segments of components."""
    square = np.square(m.astype(np.float64))
    return np.sqrt(np.add.reduceat(square, np.linspace(0, m.shape[1], min(segments, m.shape[1]), endpoint=False).astype(np.int64), axis=1))


def lists(m: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as a list column, null where masked."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind), mask=None if mask is None else pa.array(mask))


def compressed(dim: int, limited: bool) -> Column:
    """``vector`` as ``v`` within LIMIT, ``far`` (itself, if it is beyond, unless ``limited``) and the segment norms of what counts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = matrix(b, dim, np.float64)
            near = np.clip(x, -LIMIT, LIMIT)
            beyond = (near != x).any(axis=1) & (not limited)
            norms = segment_norms(np.where(beyond[:, None], x, near), SEGMENTS)
            yield pa.StructArray.from_arrays([lists(near.astype(np.int32), pa.int32()), lists(x, pa.float64(), ~beyond), lists(norms, pa.float64())], names=["v", "far", "norms"])

    return F.arrow_udf(run, "struct<v: array<int>, far: array<double>, norms: array<double>>")("vector")


def far_rows(far: pa.Array) -> np.ndarray:
    return np.flatnonzero(np.asarray(far.is_valid()))


def nearest(x: np.ndarray, norms: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest row of ``c`` for each row of ``x`` (the smaller among equals), and the squared distance."""
    of_c = segment_norms(c, SEGMENTS)
    sizes = np.square(norms).sum(axis=1)[:, None] + np.square(of_c).sum(axis=1)[None, :]
    bound = sizes - 2 * (norms @ of_c.T) - SLACK * sizes
    exact = lambda rows, j: np.square(x[rows] - c[j]).sum(axis=1)
    cluster = bound.argmin(axis=1)
    best = exact(slice(None), cluster)
    start = cluster.copy()
    for j in range(len(c)):
        rows = np.flatnonzero((bound[:, j] <= best) & (start != j))
        d = exact(rows, j)
        better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = j, d[better]
    return cluster.astype(np.int32), best


class Places:
    """Centroids of whole numbers of any size, with the numbers and the values of those within LIMIT apart."""

    def __init__(self, rows: list[list[int]], dim: int) -> None:
        self.rows, self.dim = rows, dim
        self.near = np.array([j for j, r in enumerate(rows) if max(map(abs, r)) <= LIMIT], dtype=np.int64)
        self.far = sorted(set(range(len(rows))) - set(self.near.tolist()))
        self.values = np.array([rows[j] for j in self.near], dtype=np.int64).reshape(-1, dim)
        self.norms = segment_norms(np.array(rows, dtype=np.float64).reshape(-1, dim), SEGMENTS)

    def best_of(self, x: list[int], norms: np.ndarray, numbers: list[int], best: tuple[int, int] | None = None) -> tuple[int, int]:
        """(distance, number) of the nearest of some centroids, if it is nearer than ``best``; of those alone whose bound allows it."""
        of_c = self.norms[numbers]
        with np.errstate(over="ignore", invalid="ignore"):
            sizes = np.square(norms).sum() + np.square(of_c).sum(axis=1)
            bound = sizes - 2 * (of_c @ norms) - SLACK * sizes
        for i in np.argsort(bound, kind="stable").tolist():
            if best is None or not float(bound[i]) > best[0]:
                found = sum((a - b) ** 2 for a, b in zip(x, self.rows[numbers[i]], strict=True)), numbers[i]
                best = found if best is None else min(best, found)
        return best

    def nearest(self, x: np.ndarray, far: pa.Array, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """``nearest`` for vectors ``x``, of which those of ``far`` that aren't null are beyond LIMIT; distances beyond a long are -1. Last the far vectors, in order."""
        rows, wide = far_rows(far), [list(map(int, v)) for v in far.drop_null().to_pylist()]
        cluster, best = np.zeros(len(x), dtype=np.int32), np.full(len(x), -1, dtype=np.int64)
        plain = np.delete(np.arange(len(x)), rows)
        if len(self.near):
            at, best[plain] = nearest(x[plain], norms[plain], self.values)
            cluster[plain] = self.near[at]
        if self.far:
            hit = plain
            if len(self.near):
                of_c = self.norms[self.far]
                with np.errstate(over="ignore", invalid="ignore"):
                    sizes = np.square(norms[plain]).sum(axis=1)[:, None] + np.square(of_c).sum(axis=1)[None, :]
                    bound = sizes - 2 * (norms[plain] @ of_c.T) - SLACK * sizes
                hit = plain[~(bound > best[plain][:, None]).all(axis=1)]
            for i in hit.tolist():
                d, j = self.best_of(x[i].tolist(), norms[i], self.far, (int(best[i]), int(cluster[i])) if len(self.near) else None)
                cluster[i], best[i] = j, d if d <= MOST else -1
        every = list(range(len(self.rows)))
        for i, v in zip(rows.tolist(), wide, strict=True):
            d, j = self.best_of(v, norms[i], every)
            cluster[i], best[i] = j, d if d <= MOST else -1
        return cluster, best, wide


def limbs(values: list[int]) -> list[list[int]]:
    """Whole numbers as parts that add up to them times powers of 2**LIMB, each part small, the last with the sign."""
    n = max(v.bit_length() for v in values) // LIMB + 1
    return [[(v >> LIMB * i) & (2**LIMB - 1) if i + 1 < n else v >> LIMB * i for v in values] for i in range(n)]


def sums(c: Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the vectors of a task by nearest centroid, with their number and the parts of their sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = len(c.rows), c.dim
        total, n = np.zeros(shape, dtype=np.int64), np.zeros(len(c.rows), dtype=np.int64)
        beyond: dict[int, list[int]] = {}
        for b in batches:
            x, far = matrix(b.column("v"), c.dim), b.column("far")
            if not len(x):
                continue
            cluster, _, wide = c.nearest(x, far, matrix(b.column("norms"), min(SEGMENTS, c.dim), np.float64))
            rows = far_rows(far)
            x[rows] = 0
            for j, v in zip(cluster[rows].tolist(), wide, strict=True):
                beyond[j] = [a + b for a, b in zip(beyond[j], v, strict=True)] if j in beyond else v
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(x[order], first, axis=0)
            n += np.bincount(cluster, minlength=len(c.rows))
        out = [(j, 0, int(n[j]), total[j].tolist()) for j in np.flatnonzero(n).tolist()]
        out += [(j, i, 0, part) for j, v in beyond.items() for i, part in enumerate(limbs(v))]
        yield pa.RecordBatch.from_pylist([dict(zip(SUMS.names, r, strict=True)) for r in out], schema=SUMS)

    return add


SUMS = pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def moved(table: DataFrame, c: Places) -> Places:
    """The centroids after a round: floors of the exact means, empty ones where they were."""
    parts = table.select("v", "far", "norms").mapInArrow(sums(c), "cluster int, limb int, n long, total array<long>")
    one = parts.select("cluster", "limb", "n", F.posexplode("total").alias("at", "value"))
    means = one.groupBy("cluster", "limb", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n"))
    total: dict[int, list[int]] = {}
    n: dict[int, int] = {}
    for r in means.collect():  # centroids times components, times their parts if there are vectors beyond LIMIT
        total.setdefault(r["cluster"], [0] * c.dim)[r["at"]] += int(r["value"]) << LIMB * r["limb"]
        n[r["cluster"]] = max(n.get(r["cluster"], 0), r["n"])
    return Places([[x // n[j] for x in total[j]] if j in total else row for j, row in enumerate(c.rows)], c.dim)


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, limited: bool = True) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of ``vectors`` (vec_id, vector), whose components are whole numbers held as doubles.

    The first centroids are the k kept vectors of smallest sha256 of
    ``<seed>:<vec_id>``, equal hashes by components; nearest is by squared
    distance, ties by number. Unless ``limited`` components count as they are, and
    ``centroid`` holds decimal texts.
    """
    spark = vectors.sparkSession
    told = settled(vectors.select("vec_id", "vector"), {"vector": F.col("vector").cast("array<double>")})
    kept = told.where((F.size("vector") == dim) & usable(F.col("vector")))
    table = written(kept.select("vec_id", compressed(dim, limited).alias("c")).select("vec_id", "c.*"), "compressed")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.select(drawn.alias("drawn"), F.coalesce("far", F.col("v").cast("array<double>")).alias("v")).orderBy(F.col("drawn").asc_nulls_last(), "v").limit(k).collect()
    c = Places([list(map(int, r["v"])) for r in first], dim)
    for _ in range(rounds if first else 0):
        c = moved(table, c)

    def assign(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for v, far, norms in batches:
            cluster, distance, _ = c.nearest(matrix(v, dim), far, matrix(norms, min(SEGMENTS, dim), np.float64)) if len(v) else ([], np.zeros(0), [])
            yield pa.StructArray.from_arrays([pa.array(cluster, pa.int32()), pa.array(distance, pa.int64(), mask=distance < 0)], names=["cluster", "distance"])

    out = written(table.withColumn("at", F.arrow_udf(assign, ASSIGNED)("v", "far", "norms")).select("vec_id", "at.cluster", "at.distance"), "assigned")
    places = spark.createDataFrame([(i, row if limited else list(map(str, row))) for i, row in enumerate(c.rows)], f"cluster int, centroid array<{'long' if limited else 'string'}>")
    added = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).try_cast("long")
    by_cluster = out.groupBy("cluster").agg(added.alias("cluster_inertia"))
    total = out.agg(added).first()[0]
    told = by_cluster.join(F.broadcast(places), "cluster").select("cluster", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # as many rows as centroids
