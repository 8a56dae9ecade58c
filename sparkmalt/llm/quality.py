"""Quality rules: per-document rule statistics, and an isolation forest over them.

``rule_stats`` counts over every whole text, once. ``fit`` grows a forest of
random splits on a bounded sample of labelled rows and calibrates the anomaly
threshold on all labelled rows (a histogram by label, so nothing grows on the
driver). ``apply`` scores each document by its mean path length. The base rules
fail a text of under ten words, or with over a fifth of its words in windows
that occur again.

Defined cases: a null or empty text has no words and all counts 0, and fails
the base rules; repeated rows are scored each on its own; an empty table gives
an empty table; without labels of both kinds there is no threshold and only the
base rules reject. Other columns pass unchanged, a column named as the result
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.llm.store import spare, written
from sparkmalt.llm.words import U, Words, grams, inside, mix, per_text, split

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "top_share")
SAMPLE_ROWS = 8192  # bound of the labelled sample that the forest is grown on
BINS = 4096


def totals(flags: np.ndarray, w: Words) -> np.ndarray:
    """Sum of per-byte flags for each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[w.offset])


def commonest(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Occurrences of the commonest word, per text."""
    count = np.zeros(n, dtype=np.int64)
    if len(hashes):
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
        np.maximum.at(count, d[at], np.diff(np.append(at, len(h))))
    return count


def repeated(hashes: np.ndarray, w: Words, doc: np.ndarray, k: int = 5) -> np.ndarray:
    """Words inside k-word windows that occur twice or more in their text, per text."""
    n = len(w.counts)
    ok = np.flatnonzero(inside(w.first, k, len(hashes)))
    if not len(ok):
        return np.zeros(n, dtype=np.int64)
    with np.errstate(over="ignore"):
        keys = mix(grams(hashes, k)[ok] + doc[ok].astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + k + 1, dtype=np.int32)
    np.add.at(cover, ok[hit], 1)
    np.add.at(cover, ok[hit] + k, -1)
    marked = np.concatenate(([0], np.cumsum(np.cumsum(cover)[: len(hashes)] > 0)))
    return np.diff(marked[w.first])


def measure(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS, FEATURES) as arrays with a row for each text."""
    w = split(texts)
    n_words, hashes = w.counts, w.hashes()
    doc = np.repeat(np.arange(len(texts)), n_words)
    chars = totals(~w.space & ((w.data & 0xC0) != 0x80), w)
    symbols = totals(SYMBOLS[w.data], w)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    dup = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    repeat = repeated(hashes, w, doc)
    top = commonest(hashes, doc, len(texts))
    upper = totals((w.data >= 65) & (w.data <= 90), w)
    letters = upper + totals((w.data >= 97) & (w.data <= 122), w)
    digits = totals((w.data >= 48) & (w.data <= 57), w)
    marks = totals((w.data > 32) & (w.data < 127), w) - letters - digits
    share = lambda a, b, held: a / (b + held)  # noqa: E731  ``held``: pseudo-counts, so that a short text says little
    counts = np.column_stack((n_words, chars, symbols, dup, repeat))
    features = np.column_stack((share(chars + 100, n_words, 20), share(symbols, chars, 100), share(dup, np.array([len(x) for x in lines]), 8), share(repeat, n_words, 20), share(upper, letters, 100), share(marks, chars, 100), share(top, n_words, 20)))
    return counts, features.astype(np.float64)


@dataclass
class Forest:
    """Isolation trees as flat arrays: node i splits on ``feature`` (-1: leaf) at ``cut``, children ``below`` and ``below`` + 1."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    length: np.ndarray  # path length that ends at a leaf
    roots: np.ndarray
    usual: float
    threshold: float = float("inf")

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; short mean paths score high."""
        if not len(x) or not len(self.roots):
            return np.zeros(len(x))
        out = np.empty(len(x))
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            while True:
                f = self.feature[node]
                if (f < 0).all():
                    break
                step = self.below[node] + (part[row, np.maximum(f, 0)] >= self.cut[node])
                node = np.where(f < 0, node, step)
            out[a : a + 2048] = 2.0 ** (-self.length[node].mean(axis=1) / self.usual)
        return out


def usual_length(n: int) -> float:
    """Mean length of an unsuccessful search among n points."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, trees: int, rows: int, seed: int) -> Forest:
    """A forest over the rows of x. Splits fall anywhere between a node's bounds widened by a tenth, so that what lies outside the sample parts early."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = min(rows, len(x))
    deepest = int(np.ceil(np.log2(max(rows, 2)))) + 4
    feature, cut, below, length, roots = [], [], [], [], []

    def node() -> int:
        for column, value in ((feature, -1), (cut, 0.0), (below, -1), (length, 0.0)):
            column.append(value)
        return len(feature) - 1

    full = np.ptp(x, axis=0)
    for _ in range(trees):
        todo = [(node(), x[rng.choice(len(x), rows, replace=False)], 0)]
        roots.append(todo[0][0])
        while todo:
            i, part, depth = todo.pop()
            open_ = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else ()
            if depth >= deepest or not len(open_):
                length[i] = depth + usual_length(len(part))
                continue
            f = int(rng.choice(open_))
            low, high = part[:, f].min() - 0.1 * full[f], part[:, f].max() + 0.1 * full[f]
            c = rng.uniform(low, high)
            left, right = node(), node()
            feature[i], cut[i], below[i] = f, c, left
            side = part[:, f] >= c
            todo += [(left, part[~side], depth + 1), (right, part[side], depth + 1)]
    return Forest(np.array(feature), np.array(cut), np.array(below), np.array(length), np.array(roots), max(usual_length(rows), 1e-9))


STATS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])


def stats_arrays(counts: np.ndarray, features: np.ndarray) -> list[pa.Array]:
    return [*(pa.array(np.ascontiguousarray(c), pa.int64()) for c in counts.T), *(pa.array(np.ascontiguousarray(c)) for c in features.T)]


def rule_stats(docs: DataFrame, text: str = "text", out: str = "stats", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the statistics as struct ``out``, written: fit and apply read them and not the texts."""
    kept = [c for c in (docs.columns if carry is None else carry) if c != out]
    measured = per_text(docs.sparkSession, lambda part: pa.StructArray.from_arrays(stats_arrays(*measure(part)), names=STATS.names), STATS)
    return written(docs.select(*[F.col(f"`{c}`") for c in kept], measured(F.col(f"`{text}`")).alias(out)), "rule-stats")


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "stats", label: str = "quality", trees: int = 128, rows: int = 512, sample_rows: int = SAMPLE_ROWS, most_lost: float = 0.003, seed: int = 7) -> Forest:
    """A forest grown on at most ``sample_rows`` labelled rows (those of least hash), with a threshold calibrated on all.

    The forest learns what documents labelled 1 look like; the threshold is the
    one that separates the labels best among those that reject at most the
    share ``most_lost`` of the rows labelled 1.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    known = stats.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`.*")).join(marked, "key")
    known = written(known, "labelled-stats").where(F.col("n_words") >= 10)
    good = known.where("label = 1").orderBy(F.xxhash64("key", *FEATURES), "key").limit(sample_rows).select(*FEATURES).collect()
    if len(good) < 2:
        return Forest(*(np.zeros(0),) * 5, 1.0)
    forest = grow(np.array(good, dtype=np.float64), trees, rows, seed)
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([pa.array((shared.value.scores(x) * BINS).astype(np.int32)), batch.column(len(FEATURES)).cast(pa.int32())], names=["bin", "label"])

    counted = known.where(100 * F.col("n_repeat_words") <= 20 * F.col("n_words")).select(*FEATURES, "label").mapInArrow(bins, "bin int, label int").groupBy("bin", "label").count().collect()
    table = np.zeros((2, BINS + 1))
    for b, y, n in counted:
        table[int(y > 0), b] += n
    bad, fine = table[0][::-1].cumsum()[::-1], table[1][::-1].cumsum()[::-1]
    if bad[0] and fine[0]:
        gain = np.where(fine <= most_lost * fine[0], bad / bad[0] - fine / fine[0], -1.0)
        best = int(len(gain) - 1 - np.argmax(gain[::-1]))
        # halfway into the gap below the best cut, where no labelled row lies
        under = np.flatnonzero(table.sum(axis=0)[:best])
        forest.threshold = (best + (under[-1] + 1 if len(under) else best)) / 2 / BINS if gain[best] > 0 else float("inf")
    return forest


def apply(stats: DataFrame, forest: Forest, column: str = "stats", out: str = "rules") -> DataFrame:
    """``stats`` with struct ``out`` in place of ``column``: the statistics, base_failed, anomaly and kept."""
    rest = [c for c in stats.columns if c not in (column, out)]
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def anomaly(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(shared.value.scores(np.column_stack([b.field(f).to_numpy(zero_copy_only=False) for f in FEATURES]) if len(b) else np.zeros((0, len(FEATURES)))))

    of = F.col(f"`{column}`")
    scored = stats.withColumn(score := spare(stats, "score"), anomaly.asNondeterministic()(F.struct(*[of[f].alias(f) for f in FEATURES])))
    failed = (of["n_words"] < 10) | (100 * of["n_repeat_words"] > 20 * of["n_words"])
    kept = ~failed & (F.col(score) < F.lit(forest.threshold))
    verdict = F.struct(*[of[c].alias(c) for c in STATS.names], failed.alias("base_failed"), F.col(score).alias("anomaly"), kept.alias("kept"))
    return scored.select(*[F.col(f"`{c}`") for c in rest], verdict.alias(out))
