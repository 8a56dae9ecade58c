"""Removal of repeated substrings with suffix automata of reference shards.

A window of ``window`` consecutive words is repeated if its words also start
anywhere else in the corpus, the same document included; every word under a
repeated window goes.

The reference here is the corpus itself, which no broadcast can bound, so its
shards go to tasks instead, and only what can match is sent there:

1. Every window names an anchor, the ``gram``-word sequence of least hash in it
   (the leftmost of equals). Equal windows have equal anchors at equal places,
   so a window whose anchor occurs once in the corpus is not repeated. The
   windows of a document that share an anchor position form a unit.
2. Units with an anchor that occurs twice or more are counted by content;
   copies become one reference unit with a weight.
3. The reference units of an anchor meet in one shard. Each shard builds a
   suffix automaton over the words of its units, adds their weights up along
   the suffix links, and streams the units through it for matching statistics:
   a window is repeated if the state that it ends in counts two occurrences.
4. An anchor with more than ``GROUP`` different units (a common line in different
   surroundings) is refined first: a window with its anchor in the right half
   also names the words to the anchor's left, another one those to its right, so
   many that one side always has them. Equal windows name the same, so each unit
   falls into two at most, and units that share a longer context meet. Where
   that still is too common, the context grows again, by half of what is left.
5. The verdicts go back to all copies of a unit, and the spans to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.llm.store import spare, written
from sparkmalt.llm.words import chunks, grams, inside, mix, per_text, powers, small_batches, split

WINDOW, GRAM, GROUP, SHARD_WORDS = 35, 8, 512, 40_000
RADIX = 0xA24BAED4963EE407
RADIX_INVERSE = pow(RADIX, -1, 2**64)


def leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each i, the first position of the least of g[i : i + width]."""
    at, span = np.arange(len(g)), 1
    pick = lambda a, b: np.where(g[b] < g[a], b, a)
    while span * 2 <= width:
        at = pick(at[:-span], at[span:])
        span *= 2
    rest = width - span
    return pick(at[: len(at) - rest], at[rest:]) if rest else at


def units_of(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, content, start, count) of every unit: count windows from word start on, with hashes of the anchor and of all words under them."""
    w = split(texts)
    hashes = w.hashes()
    n = len(hashes)
    valid = np.flatnonzero(inside(w.first, window, n)) if n >= window else np.zeros(0, dtype=np.int64)
    if not len(valid):
        return (np.zeros(0, dtype=np.int64),) * 5
    g = grams(hashes, gram)
    anchor = leftmost_least(g, window - gram + 1)[valid]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))))
    start, count = valid[new], np.diff(np.append(new, len(valid)))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(RADIX, n)[:n], out=sums[1:])
        content = mix((sums[start + count + window - 1] - sums[start]) * powers(RADIX_INVERSE, n)[start])
    text = np.searchsorted(w.first, start, side="right") - 1
    return text, g[anchor[new]].view(np.int64), content.view(np.int64), start - w.first[text], count


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with weighted counts of end positions."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def state(self, length: int, next_: dict[bytes, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def split_off(self, p: int, word: bytes, q: int) -> int:
        """The state that ``word`` leads to from p, of just the right length: q or a copy of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], weight: int) -> None:
        last, next_, link = 0, self.next, self.link
        for word in words:
            q = next_[last].get(word)
            if q is not None:
                last = self.split_off(last, word, q)
            else:
                new, p = self.state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in next_[p]:
                    next_[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self.split_off(p, word, next_[p][word])
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        """Adds up the counts along the suffix links."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list[bytes], window: int) -> list[int]:
        """Starts of the windows of ``words`` that the sequences hold twice or more."""
        out, s, matched = [], 0, 0
        next_, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            while s and word not in next_[s]:
                s = link[s]
                matched = length[s]
            if word in next_[s]:
                s, matched = next_[s][word], min(matched + 1, window)
            while length[link[s]] >= window:
                s = link[s]
            if matched >= window and self.count[s] > 1:
                out.append(i + 1 - window)
        return out


def spans(starts: list[int]) -> list[tuple[int, int]]:
    """Runs (first, length) of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for x in starts:
        if out and x == out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((x, 1))
    return out


RUNS = "array<struct<first:int,length:int>>"
UNIT = "anchor long, content long, weight long, kinds long, words binary, place int, left int, right int"
CUT = "anchor long, content long, weight long, words binary, place int, left int, right int, up_anchor long, up_content long, shift int"


def hashed(words: list[bytes], *marks: int) -> int:
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8, salt=bytes(x % 256 for x in marks)).digest(), "little", signed=True)


def columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), RUNS: pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32())]))}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def halves(words: list[bytes], place: int, left: int, right: int, window: int, gram: int) -> list[tuple]:
    """A unit cut in two: (first window, words, anchor, left, right).

    Its windows hold the ``gram`` words at ``place`` with ``left`` and ``right``
    words around them. Of the other words of a window at least ``more`` stand on
    the left, or else the rest of them on the right.
    """
    free = window - gram - left - right
    more = (free + 1) // 2
    windows = len(words) - window + 1
    cut = min(windows, max(0, place - left - more + 1))  # windows before it have that many on the left
    out = []
    for first, stop, a, b in ((0, cut, left + more, right), (cut, windows, left, right + free - more + 1)):
        if first < stop:
            out.append((first, words[first : stop + window - 1], hashed(words[place - a : place + gram + b], a, b), a, b))
    return out


def judged(units: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """(anchor, content, runs): the repeated windows of ``units`` (as UNIT), by automata over the units of an anchor."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield from shard(held)
                    held, size = [], 0
                if held and row[:2] == held[-1][:2]:
                    continue
                held.append((*row[:3], row[3].split()))
                size += len(held[-1][3])
        yield from shard(held)

    def shard(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for _, _, weight, words in held:
            automaton.add(words, weight)
        automaton.finish()
        out = [(a, c, [{"first": x, "length": n} for x, n in spans(starts)]) for a, c, weight, words in held if weight == 1 and (starts := automaton.repeated(words, window))]
        if out:
            yield columns(out, f"anchor long, content long, runs {RUNS}")

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, content, weight, raw, place, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = raw.split()
                if place < 0:
                    place = int(leftmost_least(grams(split([raw]).hashes(), gram), window - gram + 1)[0])
                for first, part, key, a, b in halves(words, place, left, right, window, gram):
                    out.append((key, hashed(part, place - first, a, b), weight, b" ".join(part), place - first, a, b, anchor, content, first if weight == 1 else None))
            if out:
                yield columns(out, CUT)

    shards = units.where(F.col("kinds").between(2, group)).select("anchor", "content", "weight", "words").repartition("anchor").sortWithinPartitions("anchor", "content")
    found = shards.mapInArrow(matched, f"anchor long, content long, runs {RUNS}")
    hot = units.where(F.col("kinds") > group)
    if not hot.take(1):
        return found
    cuts = written(hot.select("anchor", "content", "weight", "words", "place", "left", "right").mapInArrow(refined, CUT), "cuts")
    least = cuts.groupBy("anchor", "content").agg(F.sum("weight").alias("weight"), F.first("words").alias("words"), *[F.first(c).alias(c) for c in ("place", "left", "right")])
    sizes = written(cuts.select("anchor", "content").distinct().groupBy("anchor").agg(F.count("*").alias("kinds")), "cut-sizes")
    below = written(written(least, "cut-kinds").join(sizes, "anchor").select(*[f.split(" ")[0] for f in UNIT.split(", ")]), "cut-units")
    length = F.size(F.split(F.decode("words", "UTF-8"), " ")) - (window - 1)
    copies = below.where("weight > 1").select("anchor", "content", F.array(F.struct(F.lit(0).alias("first"), length.alias("length"))).alias("runs"))
    verdicts = written(judged(below, window, gram, group).unionByName(copies), "cut-verdicts")
    back = cuts.where("shift IS NOT NULL").select("anchor", "content", "up_anchor", "up_content", "shift").join(verdicts, ["anchor", "content"])
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), r["length"].alias("length")))
    return found.unionByName(back.select(F.col("up_anchor").alias("anchor"), F.col("up_content").alias("content"), moved.alias("runs")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, out: str = "dedup", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with struct ``out``: n_words, n_removed, spans, kept_text.

    Words are runs of characters other than space and U+0009..U+000D. ``spans``
    has the maximal removed runs (start, words), ``kept_text`` the other words
    joined by one space. A null or empty text has no words; repeated rows repeat
    each other's windows; a null key is allowed; an empty table gives an empty
    table. Other columns pass unchanged, one named as the result is replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if carry is None else carry) if c != out]
    kind = docs.schema[key].dataType.simpleString()
    # key and tag tell rows apart; rows that share both have one text
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, part in chunks(batch.column(2)):
                at, anchor, content, start, count = units_of(part, window, gram)
                if len(at):
                    rows_at = pa.array(at + begin)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_at), batch.column(1).take(rows_at), pa.array(anchor), pa.array(content), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["key", "tag", "anchor", "content", "start", "count"])

    units = rows.mapInArrow(cut, f"key {kind}, tag long, anchor long, content long, start int, count int")
    # tables are written where a join follows, so that it reads two plain sides and a hot key can be split
    twice = written(units.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = written(units.join(twice, "anchor"), "units")
    reference = written(found.groupBy("anchor", "content").agg(F.count("*").alias("weight"), F.min(F.struct("key", "tag", "start")).alias("at"), F.min("count").alias("count")), "reference")
    sizes = written(reference.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    mixed = reference.join(sizes, "anchor").select("at.key", "at.tag", F.struct("anchor", "content", "at.start", "count", "weight", "kinds").alias("unit"))
    wanted = written(mixed.groupBy("key", "tag").agg(F.collect_list("unit").alias("units")), "wanted")

    def unit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for row, tag, x, units in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                if before != (now := (row.as_py(), tag.as_py())):  # a repeated row has nothing new
                    words = x.as_py().split()
                    yield columns([(u["anchor"], u["content"], u["weight"], u["kinds"], b" ".join(words[u["start"] : u["start"] + u["count"] + window - 1]), -1, 0, 0) for u in units.as_py()], UNIT)
                before = now

    texts = rows.join(wanted, rows["key"].eqNullSafe(wanted["key"]) & (rows["tag"] == wanted["tag"])).select(wanted["key"], wanted["tag"], "text", "units")
    by_automaton = judged(written(texts.mapInArrow(unit_texts, UNIT), "unit-texts"), window, gram, group)
    copies = reference.where("weight > 1").select("anchor", "content", F.array(F.struct(F.lit(0).alias("first"), F.col("count").alias("length"))).alias("runs"))
    verdicts = written(by_automaton.unionByName(copies), "verdicts")
    placed = found.join(verdicts, ["anchor", "content"]).select("key", "tag", F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), r["length"].alias("length"))).alias("runs"))
    row_, tag_ = spare(docs, "row_key"), spare(docs, "row_tag")
    # a set, so that a row that is repeated a million times has its runs once
    marks = written(placed.groupBy(F.col("key").alias(row_), F.col("tag").alias(tag_)).agg(F.flatten(F.collect_set("runs")).alias("runs")), "marks")

    def removed(texts: list[bytes], runs: pa.ListArray) -> pa.Array:
        counts, gone, where, left = [], [], [], []
        for i, x in enumerate(texts):
            words = x.split()
            counts.append(len(words))
            if not runs[i].is_valid:
                gone.append(0)
                where.append([])
                left.append(b" ".join(words))
                continue
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            inner = runs[i].values
            first, length = inner.field("first").to_numpy(), inner.field("length").to_numpy()
            np.add.at(cover, first, 1)
            np.add.at(cover, first + length + window - 1, -1)
            under = np.cumsum(cover)[:-1] > 0
            gone.append(int(under.sum()))
            edge = np.flatnonzero(np.diff(under, prepend=False, append=False))
            where.append([{"start": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            left.append(b" ".join([word for word, u in zip(words, under, strict=True) if not u]))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))), pa.array(left, pa.binary()).cast(pa.string())],
            names=["n_words", "n_removed", "spans", "kept_text"],
        )

    result = T._parse_datatype_string("n_words long, n_removed long, spans array<struct<start:int,words:int>>, kept_text string")
    full = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])], F.col(f"`{key}`").alias(row_), F.xxhash64(F.col(f"`{text}`")).alias(tag_))
    runs_ = spare(docs, "runs")
    marks = marks.withColumnRenamed("runs", runs_)
    joined = full.join(marks, full[row_].eqNullSafe(marks[row_]) & (full[tag_] == marks[tag_]), "left")
    return joined.select(*[full[f"`{c}`"] for c in kept], per_text(docs.sparkSession, removed, result)(full[f"`{text}`"], marks[f"`{runs_}`"]).alias(out))
