"""Vectorised word splitting and hashing of Arrow text batches with numpy.

A word is a maximal run of characters other than space and U+0009..U+000D, so
the split works on UTF-8 bytes. Hashes are 64-bit polynomial sums over a random
byte table, finished by a bijective mixer; they depend on content only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.sources.shared import small_batches

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
STEP = U(0xD6E8FEB86659FD93)
CHUNK = 1 << 19
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size > 4 * CHUNK:
            return have
        _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@dataclass
class Words:
    """The words of several texts: byte spans in ``data``, 64-bit hashes, and each text's slice of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[i]..first[i + 1] are text i's words
    space: np.ndarray
    offset: np.ndarray  # byte offset of each text, with one separator byte between texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(BYTE[self.data] * powers(BASE, len(self.data))[: len(self.data)], out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * powers(INVERSE, len(self.data) + 1)[self.start])


def split(texts: list[bytes]) -> Words:
    """Words of UTF-8 texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    offset = np.concatenate(([0], np.cumsum(sizes)))
    return Words(data, start, end, np.searchsorted(start, offset), space, offset)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices (from, to, UTF-8 texts) of a string column of about ``limit`` bytes each; null is empty; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        before = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield begin, stop, [x or b"" for x in column.slice(begin, stop - begin).cast(pa.binary()).to_pylist()]
        begin = stop


def per_text(spark: SparkSession, judge: Callable[..., pa.Array], kind: T.DataType) -> Callable[..., Column]:
    """A column function of a text column (and another one): ``judge`` gets texts of about CHUNK bytes (and that column's slice) and gives a value for each.

    Only the text goes to Python and only the values come back; what else a row
    has stays with Spark.
    """
    small_batches(spark)

    def values(column: pa.Array, *more: pa.Array) -> pa.Array:
        parts = [judge(texts, *(m.slice(begin, stop - begin) for m in more)) for begin, stop, texts in chunks(column)]
        return pa.concat_arrays(parts) if parts else judge([], *more)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield values(column)

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield values(*columns)

    def column(*of: Column) -> Column:
        # not deterministic as far as the optimizer knows, so it runs once for each row, whatever uses its value
        run = F.arrow_udf(one if len(of) == 1 else two, kind)
        return run.asNondeterministic()(*of)

    return column


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; element i starts at word i."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, k):
            out = out * STEP + hashes[j : n + j]
    return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """True where a gram of k words starting at a word stays inside its text."""
    n = max(0, total - k + 1)
    ok = np.ones(n + k, dtype=np.int32)
    ok[n:] = 0
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = 0
    return ok[:n].astype(bool)
