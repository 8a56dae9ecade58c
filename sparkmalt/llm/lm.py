"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts every word from the ``SIDE`` words on either side: each slot
has an embedding table, their sum goes through tanh and from there into two
softmaxes, one over groups of words and one over the words of the group. A
document's score is the sum, over all its words, of the log-probability of the
word given its surroundings. The network is written in numpy.

Words are counted over all documents. The ``VOCABULARY`` commonest have
embeddings of their own and are dealt, in the order of their endings, to groups
of ``MEMBERS``; both softmaxes predict them. For all other words the first
softmax predicts a tail class, cut from the sorted endings (last two bytes) so
that each has about the same part of the corpus, and there the word has its own
share of the corpus counts. The counts of the ``KNOWN`` commonest go to all
tasks; those of all other words stay in a table that scoring joins, so every
word has its own share. A word without a count has half an occurrence in its
tail class.

Training takes every document: each partition runs minibatch Adagrad from the
same start over its documents and gives its weights, which are averaged by
numbers of words seen, in two steps over blocks of the weights; so what is
gathered grows with the corpus, and only the averaged weights (of fixed size)
reach the driver. Every position of every document is predicted, in training
as in scoring. As a partition trains on its own rows, the weights depend (a
little) on how rows are dealt to partitions; with the same partitions they are
the same again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.llm.store import fresh, spare, written
from sparkmalt.llm.words import Words, chunks, per_text, small_batches, split

VOCABULARY, KNOWN, TAILS, MEMBERS, HIDDEN, SIDE = 4096, 65536, 64, 64, 16, 2
UNSEEN = 0.5  # occurrences, in each class, of words without a count
FIXED = 1 << 32  # log shares of joined words are summed in whole parts of this, so that their order doesn't matter
BATCH, RATE = 8192, 0.1
ROWS = 512  # positions whose logits are worked out at once, so that they stay in the processor's cache
PREFIX = 18  # bits of a hash by which it is looked up
SAFE = 60.0  # logits within this need no shift before exp
BLOCKS = 32  # of the averaged weights
MOST_COUNTED = 400_000


def endings(w: Words) -> np.ndarray:
    """The last two bytes of each word as a number under 65536, the last one first."""
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return w.data[w.end - 1].astype(np.int64) * 256 + before


@dataclass
class Symbols:
    """Symbols: 0..TAILS-1 for words without a known count by tail class, then the known words from the commonest on, then the text's edge."""

    hashes: np.ndarray  # sorted hashes of known words
    symbol: np.ndarray  # their symbols
    kind: np.ndarray  # of each symbol: its tail class, or TAILS + its group
    member: np.ndarray  # place in its group of each word that has one, else -1
    inner: np.ndarray  # log share in its group or tail class of each known word, or of a word without a count
    prior: np.ndarray  # log share of each tail class and group
    row: np.ndarray  # embedding of each symbol and of the edge
    classes: np.ndarray  # tail class of each ending
    counts: str | None = None  # path of the counts of all words (h, n)

    def __post_init__(self) -> None:
        before = (self.hashes >> np.uint64(64 - PREFIX)).astype(np.int64)
        self.begins = np.searchsorted(before, np.arange(1 << PREFIX)).astype(np.int32)  # first of the known hashes that begin with each PREFIX bits
        self.longest = int(np.bincount(before).max(initial=1))

    @property
    def edge(self) -> int:
        return len(self.kind)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each of ``h`` is among the known hashes, if it is there: found by its first bits, then step by step."""
        at, last = self.begins.take(h >> np.uint64(64 - PREFIX)), len(self.hashes) - 1
        np.minimum(at, last, out=at)
        for _ in range(self.longest - 1):
            at += self.hashes.take(at) < h
            np.minimum(at, last, out=at)
        return at

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first): symbols of the words of each text, with SIDE edges before, between and after texts."""
        return self.with_hashes(texts)[:2]

    def with_hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, first, hashes): as ``of``, and the hash of every word."""
        w = split(texts)
        h = w.hashes()
        got = self.classes[endings(w)]
        if len(self.hashes) and len(h):
            at = self.places(h)
            got = np.where(self.hashes.take(at) == h, self.symbol.take(at), got)
        doc = np.repeat(np.arange(len(texts)), w.counts)
        out = np.full(len(h) + SIDE * (len(texts) + 1), self.edge, dtype=np.int64)
        out[np.arange(len(h)) + SIDE * (doc + 1)] = got
        return out, w.first + SIDE * (np.arange(len(w.first)) + 1), h


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, _, part in chunks(batch.column(0)):
                for x in part:
                    counts.update(x.split())
                if len(counts) > MOST_COUNTED:
                    yield given(counts)
                    counts = Counter()
        yield given(counts)

    def given(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_forms(counts: DataFrame) -> DataFrame:
    """``counts`` with the hash ``h`` and the ending ``code`` of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = split(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w.hashes().view(np.int64)), pa.array(endings(w), pa.int32())], names=["word", "n", "h", "code"])

    return counts.mapInArrow(run, "word binary, n long, h long, code int")


def symbols(docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY, known: int = KNOWN) -> Symbols:
    """The symbol table of a corpus; about ``known`` words and a total per ending reach the driver, the counts of all words stay in a table."""
    path = fresh(docs.sparkSession, "word-counts")
    with_forms(count_words(docs, text)).write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    mass = np.zeros(1 << 16)
    for r in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():  # 65536 rows at most
        mass[r["code"]] = r["n"]
    # the lowest count that at most ``known`` words reach, by eighths of its binary logarithm
    octave = F.floor(F.log2("n") * 8).cast("int")
    reached, low = 0, None
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["o"]):
        if (reached := reached + r["words"]) > known:
            break
        low = r["o"]
    found = {bytes(r["word"]): r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).select("word", "n").collect()}
    if low is not None:
        found |= {bytes(r["word"]): r["n"] for r in counts.where(octave >= low).select("word", "n").collect()}
    return symbol_table(found, mass, vocabulary, path)


def symbol_table(found: dict[bytes, int], mass: np.ndarray, vocabulary: int, path: str | None = None) -> Symbols:
    """The table from counts of the known words and the total count of each ending."""
    top = sorted(found.items(), key=lambda x: (-x[1], x[0]))
    told = min(vocabulary, len(top))
    groups = -(-told // MEMBERS)
    w = split([x for x, _ in top])
    code, hashes, n = endings(w), w.hashes(), np.array([c for _, c in top], dtype=np.float64)
    mass = mass.copy()
    np.subtract.at(mass, code[:told], n[:told])
    classes = np.minimum(TAILS - 1, (np.cumsum(mass) - mass / 2) * TAILS // max(mass.sum(), 1)).astype(np.int64)
    kind = np.concatenate((np.arange(TAILS), classes[code]))
    member = np.full(len(kind), -1)
    by_ending = np.lexsort((np.arange(told), code[:told]))
    kind[TAILS + by_ending] = TAILS + np.arange(told) // MEMBERS
    member[TAILS + by_ending] = np.arange(told) % MEMBERS
    of = np.concatenate((np.bincount(classes, weights=mass, minlength=TAILS) + UNSEEN, np.bincount(kind[TAILS : TAILS + told] - TAILS, weights=n[:told], minlength=groups)))
    inner = np.log(np.concatenate((np.full(TAILS, UNSEEN), n)) / of[kind])
    row = np.where(np.arange(len(kind)) < TAILS + told, np.arange(len(kind)), kind)
    order = np.argsort(hashes)
    return Symbols(hashes[order], order + TAILS, kind, member, inner, np.log((of + 0.5) / (of + 0.5).sum()), np.append(row, TAILS + told).astype(np.min_scalar_type(TAILS + told)), classes, path)


@dataclass
class Softmax:
    """Softmaxes by output weights (the bias is their last row) of some rows at a time, in space that is used again and again."""

    out: np.ndarray
    safe: bool
    room: np.ndarray
    begins: np.ndarray
    ones: np.ndarray

    @staticmethod
    def of(out: np.ndarray, bias: np.ndarray) -> Softmax:
        out, width = np.concatenate((out, bias[..., None, :]), axis=-2), out.shape[-1]
        # hidden values are within 1, which bounds the logits
        safe = bool(np.abs(out).sum(axis=-2).max(initial=0.0) < SAFE)
        return Softmax(out, safe, np.empty((ROWS, width), dtype=np.float32), np.arange(ROWS) * width, np.ones(width, dtype=np.float32))

    def raised(self, h: np.ndarray, right: np.ndarray, group: object = ...) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """exp of the logits of each row of ``h`` (at most ROWS) and the rows' sums; places of the classes ``right`` in it, flat, and their logits."""
        x = np.matmul(h, self.out[group], out=self.room[: len(h)])
        if not self.safe:
            x -= x.max(axis=1, keepdims=True)
        places = self.begins[: len(h)] + right
        told = x.reshape(-1).take(places)
        np.exp(x, out=x)
        return x, x @ self.ones, places, told


@dataclass
class Network:
    """Embeddings (slot, row, hidden); output weights and bias over groups, and over the members of each group."""

    tables: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    inner_out: np.ndarray
    inner_bias: np.ndarray
    symbols: Symbols

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.out, self.bias, self.inner_out, self.inner_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @staticmethod
    def start(s: Symbols, hidden: int, seed: int) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        groups = len(s.prior) - TAILS
        shares = np.full((groups, MEMBERS), -30.0, dtype=np.float32)
        told = np.flatnonzero(s.member >= 0)
        shares[s.kind[told] - TAILS, s.member[told]] = s.inner[told]
        return Network(normal(2 * SIDE, int(s.row[-1]) + 1, hidden), normal(hidden, len(s.prior)), s.prior.astype(np.float32), normal(groups, hidden, MEMBERS), shares, s)

    def like(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([x.size for x in self.parts()])
        return Network(*(y.reshape(x.shape) for x, y in zip(self.parts(), np.split(flat.astype(np.float32), ends[:-1]), strict=True)), self.symbols)

    def hidden(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hidden values at the positions ``at``, with a last column of ones, and the embedding rows that they come from, by slot."""
        rows = [self.symbols.row[seq[at + move]] for move in range(-SIDE, SIDE + 1) if move]
        total = self.tables[0].take(rows[0], axis=0)  # take is faster than an index by an array
        for table, ids in zip(self.tables[1:], rows[1:], strict=True):
            total += table.take(ids, axis=0)
        h = np.ones((len(at), total.shape[1] + 1), dtype=np.float32)
        np.tanh(total, out=h[:, :-1])
        return h, rows

    def by_kind(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Places in ``at`` in the order of their words' kinds, and (group, slice of these) for each group that has words, of ROWS at most."""
        kind = self.symbols.kind[seq[at]].astype(np.min_scalar_type(len(self.bias)))  # 16 bits or less are sorted by digits
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(TAILS, len(self.bias) + 1))
        return order, [(int(g), slice(a, min(a + ROWS, ends[g + 1]))) for g in np.flatnonzero(np.diff(ends)) for a in range(ends[g], ends[g + 1], ROWS)]

    def log_probs(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the word at each position given the words around it."""
        order, groups = self.by_kind(seq, at)
        at = at[order]
        words, (h, _) = seq[at], self.hidden(seq, at)
        s = self.symbols
        kind, member = s.kind[words], s.member[words]
        value = np.where(member < 0, s.inner[words], 0.0)

        def add(some: slice, softmax: Softmax, right: np.ndarray, group: object = ...) -> None:
            _, total, _, told = softmax.raised(h[some], right[some], group)
            value[some] += told - np.log(total)

        outer, inner = Softmax.of(self.out, self.bias), Softmax.of(self.inner_out, self.inner_bias)
        for a in range(0, len(at), ROWS):
            add(slice(a, a + ROWS), outer, kind)
        for g, some in groups:
            add(some, inner, member, g)
        back = np.empty(len(at))
        back[order] = value
        return back

    def learn(self, seq: np.ndarray, at: np.ndarray, sums: Network, rate: float) -> None:
        """One Adagrad step towards the words at ``at``; ``sums`` has the squares so far."""
        order, groups = self.by_kind(seq, at)
        at = at[order]
        words, (h, rows), n = seq[at], self.hidden(seq, at), np.float32(len(at))
        kind, member = self.symbols.kind[words], self.symbols.member[words]
        into = np.zeros((len(at), h.shape[1] - 1), dtype=np.float32)

        def slopes(some: slice, softmax: Softmax, right: np.ndarray, group: object = ...) -> np.ndarray:
            x, total, places, _ = softmax.raised(h[some], right[some], group)
            x.reshape(-1)[places] -= total
            share = (1 / (total * n))[:, None]  # x by this are the slopes of the logits
            into[some] += (x @ softmax.out[group][:-1].T) * share
            return (h[some] * share).T @ x

        def step(x: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
            s += g * g
            x -= rate * g / np.sqrt(s)

        outer, inner = Softmax.of(self.out, self.bias), Softmax.of(self.inner_out, self.inner_bias)
        slope, inner_slope = np.zeros_like(outer.out), np.zeros_like(inner.out)
        for a in range(0, len(at), ROWS):
            slope += slopes(slice(a, a + ROWS), outer, kind)
        for g, some in groups:
            inner_slope[g] += slopes(some, inner, member, g)
        step(self.out, sums.out, slope[:-1])
        step(self.bias, sums.bias, slope[-1])
        step(self.inner_out, sums.inner_out, inner_slope[:, :-1])
        step(self.inner_bias, sums.inner_bias, inner_slope[:, -1])
        into *= 1 - h[:, :-1] ** 2
        for x, s, ids in zip(self.tables, sums.tables, rows, strict=True):
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            ids, g = ids[new], np.add.reduceat(into.take(order, axis=0), new, axis=0)
            square = s.take(ids, axis=0)
            square += g * g
            s[ids] = square
            x[ids] -= rate * g / np.sqrt(square)


def train(docs: DataFrame, text: str = "text", hidden: int = HIDDEN, rate: float = RATE, seed: int = 3, vocabulary: int = VOCABULARY, known: int = KNOWN) -> tuple[Symbols, Network]:
    """A symbol table and a network trained on all documents."""
    small_batches(docs.sparkSession)
    table = symbols(docs, text, vocabulary, known=known)
    start = Network.start(table, hidden, seed)
    shared = docs.sparkSession.sparkContext.broadcast(start)
    edges = np.linspace(0, len(start.flat()), BLOCKS + 1).astype(int)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = shared.value
        table = begin.symbols
        net, sums = begin.like(begin.flat().copy()), begin.like(np.full(begin.flat().shape, 1e-6))
        seen, turn = 0, 0
        for batch in batches:
            for _, _, part in chunks(batch.column(0)):
                seq, _ = table.of(part)
                at = np.flatnonzero(seq != table.edge)
                turn += 1
                at = np.random.Generator(np.random.PCG64([seed, turn])).permutation(at)
                for a in range(0, len(at), BATCH):
                    some = at[a : a + BATCH]
                    net.learn(seq, some, sums, rate)
                seen += len(at)
        if seen:
            flat, task = net.flat(), TaskContext.get().partitionId()
            pieces = [flat[a:b].astype(np.float32).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array(pieces, pa.binary())], names=["block", "task", "seen", "weights"])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task, total, seen = None, 0, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([task], pa.int32()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], names=["block", "task", "seen", "weights"])
        for batch in batches:
            for r in batch.to_pylist():
                if now != (r["block"], r["part"]):
                    if now is not None:
                        yield row()
                    now, task, total, seen = (r["block"], r["part"]), r["part"], 0.0, 0
                total = total + np.frombuffer(r["weights"], dtype=np.float32).astype(np.float64) * r["seen"]
                seen += r["seen"]
        if now is not None:
            yield row()

    kind = "block int, task int, seen long, weights binary"
    models = docs.select(F.col(text).alias("text")).mapInArrow(local, kind)
    for spread in (64, 1):  # first averages of up to 64 groups of tasks, then theirs
        models = models.withColumn("part", F.pmod("task", F.lit(spread))).repartition("block", "part").sortWithinPartitions("block", "part", "task").select("block", "task", "seen", "weights", "part").mapInArrow(averaged, kind)
    rows = models.collect()  # BLOCKS rows
    if not rows:
        return table, start
    return table, start.like(np.concatenate([np.frombuffer(r["weights"], dtype=np.float32) for r in sorted(rows, key=lambda r: r["block"])]))


def score(docs: DataFrame, model: tuple[Symbols, Network], text: str = "text", out: str = "pseudo", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with struct ``out``: n_words, log_prob (sum over all words) and mean_log_prob.

    A null or empty text has 0 words, the sum 0 and a null mean; repeated rows
    score alike; an empty table gives an empty table. Other columns pass
    unchanged, one named as the result is replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if carry is None else carry) if c != out]
    id_, rare, words_, sum_, gain = (spare(docs, c) for c in ("row_id", "rare", "words", "log_sum", "gain"))
    kind = T._parse_datatype_string("words long, log_sum double, rare array<long>")
    shared = spark.sparkContext.broadcast(model[1])

    def judge(texts: list[bytes]) -> pa.Array:
        net = shared.value
        table = net.symbols
        seq, first, hashes = table.with_hashes(texts)
        value = np.zeros(len(seq) + 1)
        at = np.flatnonzero(seq != table.edge)
        for a in range(0, len(at), BATCH):
            some = at[a : a + BATCH]
            value[some] = net.log_probs(seq, some)
        sums = np.concatenate(([0.0], np.cumsum(value)))
        n = np.diff(first) - SIDE
        # a text's words end SIDE edges before the next text's begin
        total = np.where(n > 0, sums[first[1:] - SIDE] - sums[first[:-1]], 0.0)
        unknown = seq[at] < TAILS
        ends = np.concatenate(([0], np.cumsum(unknown)))[np.concatenate(([0], np.cumsum(n)))]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[unknown].view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(total), lists], names=kind.names)

    one = spare(docs, "judged")
    first = docs.select(*[F.col(f"`{c}`") for c in kept], per_text(spark, judge, kind)(F.col(f"`{text}`")).alias(one))
    first = first.select(*[F.col(f"`{c}`") for c in kept], F.col(one)["words"].alias(words_), F.col(one)["log_sum"].alias(sum_), F.col(one)["rare"].alias(rare))
    first = written(first.withColumn(id_, F.monotonically_increasing_id()), "first-scores")
    # words that aren't in the broadcast table stand as words without a count until here
    counts = spark.read.parquet(model[0].counts).select("h", F.round(F.log(F.col("n") / UNSEEN) * FIXED).cast("long").alias(gain))
    gains = first.select(id_, F.explode(rare).alias("h")).join(counts, "h").groupBy(id_).agg(F.sum(gain).alias(gain))
    total = F.col(sum_) + F.coalesce(F.col(gain) / FIXED, F.lit(0.0))
    n = F.col(words_)
    return first.join(gains, id_, "left").select(*[F.col(f"`{c}`") for c in kept], F.struct(n.alias("n_words"), total.alias("log_prob"), F.when(n > 0, total / n).alias("mean_log_prob")).alias(out))
