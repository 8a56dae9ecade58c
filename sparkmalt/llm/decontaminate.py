"""Benchmark decontamination: BM25 over the test items, block-max WAND, overlap check.

The test items are the indexed side. Impacts are BM25 scores divided by the
item's score for its own text, so one threshold serves all items. Items are
indexed by classes of length, and every training document is cut into
overlapping passages for each class, each twice as long as the class's longest
item, half a passage apart, so an item lies whole in one of them, and a long
item doesn't make the passages of short ones long. A passage goes through three
steps: a bound from the items' rarest terms, over arrays, says
whether any item can reach the threshold; block-max WAND retrieves all items
that do; and an item counts if enough word triples of its question and of its
answer stand in the passage. The answer of an item is its last sentence (its
last quarter if it has one sentence only), the question what comes before.

The index is broadcast, in blocks of at most ``BLOCK_BYTES`` of item text; more
items than that take several passes, each written to the shared folder. What a
score and a passage hang on (document frequencies, number of items, mean and
longest length) is counted over all items first, so blocks don't change results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkmalt.llm.store import spare, written
from sparkmalt.llm.words import chunks, per_text

BLOCK_BYTES = 32 << 20
THRESHOLD, OVERLAP = 0.5, 0.6
K1, B = 1.2, 0.75
POSTINGS = 32  # per block of a posting list
SHORTEST = 32  # words of the shortest passage step
CLASS_WORDS = 64  # of the longest items of the first class of length
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "array<struct<item:{},score:double,question:double,answer:double,word:int>>"


def terms(text: bytes) -> list[bytes]:
    """Words in small letters; all ASCII signs part words."""
    return text.lower().translate(PLAIN).split()


def triples(words: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(3, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question, answer) of an item."""
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if terms(x.encode())]
    words = terms(text.encode())
    last = len(terms(sentences[-1].encode())) if len(sentences) > 1 else max(1, len(words) // 4)
    return words[: len(words) - last], words[len(words) - last :]


@dataclass
class Index:
    """Posting lists of normalised impacts, with the maxima of their blocks."""

    items: list
    step: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    ids: list[np.ndarray] = field(default_factory=list)
    impacts: list[np.ndarray] = field(default_factory=list)
    tops: list[float] = field(default_factory=list)
    block_tops: list[np.ndarray] = field(default_factory=list)
    halves: list[tuple[set, set]] = field(default_factory=list)
    # rarest terms of each item: lists by term, and the impact that is left beside them
    first: np.ndarray | None = None
    rare_items: np.ndarray | None = None
    rare_impacts: np.ndarray | None = None
    left: np.ndarray | None = None


@dataclass
class Corpus:
    """Figures over all items that have words."""

    n: int
    words: int
    longest: dict[int, int]  # by class of length
    df: dict[bytes, int]  # of the terms that are asked for


def length_class(n: int) -> int:
    """0 up to CLASS_WORDS words, then one class for each fourfold length."""
    c = 0
    while n > CLASS_WORDS * 4**c:
        c += 1
    return c


def indexes(rows: list[tuple], threshold: float, corpus: Corpus | None = None) -> list[Index]:
    """Indexes of items (id, text) by class of length, a block of the items of ``corpus`` or else all there are; items without words are left out."""
    kept = [(i, t, terms(t.encode())) for i, t in rows if t and terms(t.encode())]
    classes: dict[int, list[tuple]] = {}
    for row in kept:
        classes.setdefault(length_class(len(row[2])), []).append(row)
    if corpus is None:
        corpus = Corpus(len(kept), sum(len(w) for _, _, w in kept), {c: max(len(w) for _, _, w in found) for c, found in classes.items()}, Counter(w for _, _, words in kept for w in set(words)))
    return [build(found, threshold, corpus, corpus.longest[c]) for c, found in sorted(classes.items())]


def build(kept: list[tuple], threshold: float, corpus: Corpus, longest: int) -> Index:
    """An index of items (id, text, terms)."""
    out = Index([i for i, _, _ in kept], max(SHORTEST, longest))
    n, mean, df = corpus.n, corpus.words / max(corpus.n, 1), corpus.df
    lists: dict[bytes, list[tuple[int, float]]] = {}
    out.left = np.zeros(len(kept))
    rare: dict[bytes, list[tuple[int, float]]] = {}
    for i, (_, text, words) in enumerate(kept):
        tf = Counter(words)
        raw = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in tf.items()}
        total = sum(raw.values())
        left = 1.0
        for w in sorted(raw, key=lambda w: (df[w], w)):
            lists.setdefault(w, []).append((i, raw[w] / total))
            if left >= threshold / 2:
                rare.setdefault(w, []).append((i, raw[w] / total))
                left -= raw[w] / total
        out.left[i] = max(left, 0.0)
        q, a = parts(text)
        out.halves.append((triples(q), triples(a)))
    out.vocabulary = {w: t for t, w in enumerate(lists)}
    for posts in lists.values():
        out.ids.append(np.array([i for i, _ in posts]))
        out.impacts.append(x := np.array([s for _, s in posts]))
        out.tops.append(float(x.max()))
        out.block_tops.append(np.maximum.reduceat(x, np.arange(0, len(x), POSTINGS)))
    sizes = [len(rare.get(w, ())) for w in lists]
    out.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    flat = [p for w in lists for p in rare.get(w, ())]
    out.rare_items, out.rare_impacts = np.array([i for i, _ in flat], dtype=np.int64), np.array([s for _, s in flat])
    return out


def wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose summed impact over the distinct terms ``query`` reaches the threshold."""
    found = []
    # cursors [item, term, place], in order of the item that they stand at
    cursors = [[int(index.ids[t][0]), t, 0] for t in query]
    slack = threshold - 1e-9

    def move(c: list[int], to: int) -> bool:
        c[2] = int(np.searchsorted(index.ids[c[1]], to))
        if c[2] >= len(index.ids[c[1]]):
            return False
        c[0] = int(index.ids[c[1]][c[2]])
        return True

    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += index.tops[c[1]]
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # the blocks in which the item would stand
        bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(index.items)
        for c in cursors[: pivot + 1]:
            ids = index.ids[c[1]]
            at = int(np.searchsorted(ids, item))
            if at < len(ids):
                block = at // POSTINGS
                bound += index.block_tops[c[1]][block]
                until = min(until, int(ids[min(len(ids), (block + 1) * POSTINGS) - 1]) + 1)
        if bound < slack:
            to = max(item + 1, until)
            cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, to)]
        elif cursors[0][0] == item:
            score = sum(float(index.impacts[c[1]][c[2]]) for c in cursors[: pivot + 1])
            if score >= slack:
                found.append((item, score))
            cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, item + 1)]
        else:
            cursors = [c for c in cursors if c[0] >= item or move(c, item)]
    return found


def candidates(index: Index, ids: np.ndarray, passage: np.ndarray, threshold: float) -> np.ndarray:
    """Passages in which the rarest terms leave room for an item to reach the threshold."""
    count = np.where(ids >= 0, index.first[ids + 1] - index.first[ids], 0)
    at = np.flatnonzero(count)
    count = count[at]
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    start = np.cumsum(count) - count
    place = np.repeat(index.first[ids[at]] - start, count) + np.arange(count.sum())
    n = len(index.items)
    keys = np.repeat(passage[at], count) * n + index.rare_items[place]
    order = np.argsort(keys, kind="stable")
    keys, impact = keys[order], index.rare_impacts[place][order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    bound = np.add.reduceat(impact, new) + index.left[keys[new] % n]
    return np.unique(keys[new][bound >= threshold - 1e-9] // n)


def matches(of: list[Index], texts: list[bytes], threshold: float, overlap: float) -> list[list[dict]]:
    """Verified items of each text, each once with its best passage."""
    words = [terms(t) for t in texts]
    out: list[list[dict]] = [[] for _ in texts]
    for index in of:
        add_matches(index, words, threshold, overlap, out)
    return out


def add_matches(index: Index, words: list[list[bytes]], threshold: float, overlap: float, out: list[list[dict]]) -> None:
    step = index.step
    # a text's passages are numbered on from those of the texts before it; the first half of each text is a passage of its own
    halves = np.array([(len(w) + step - 1) // step + 1 for w in words])
    base = np.concatenate(([0], np.cumsum(halves)))
    ids = np.fromiter((t for w in words for t in map(index.vocabulary.get, w, repeat(-1))), dtype=np.int64, count=sum(map(len, words)))
    half = np.concatenate([base[i] + np.arange(len(w)) // step for i, w in enumerate(words)]) if len(ids) else ids
    # passage p holds the halves p - 1 and p
    for p in candidates(index, np.concatenate((ids, ids)), np.concatenate((half, half + 1)), threshold).tolist():
        i = int(np.searchsorted(base, p, side="right")) - 1
        low = max(0, (p - base[i] - 1) * step)
        part = words[i][low : low + 2 * step] if p > base[i] else words[i][:step]
        got = wand(index, sorted({t for t in map(index.vocabulary.get, part) if t is not None}), threshold)
        if not got:
            continue
        there = {k: {tuple(part[a : a + k]) for a in range(len(part) - k + 1)} for k in (1, 2, 3)}
        inside = lambda s: sum(x in there[len(x)] for x in s) / len(s) if s else 1.0  # noqa: B023, E731
        for item, score in got:
            question, answer = map(inside, index.halves[item])
            if question >= overlap and answer >= overlap:
                row = {"item": index.items[item], "score": float(score), "question": question, "answer": answer, "word": int(low)}
                same = next((r for r in out[i] if r["item"] == row["item"]), None)
                if same is None:
                    out[i].append(row)
                elif (question + answer, score) > (same["question"] + same["answer"], same["score"]):
                    same.update(row)


def item_terms(items: DataFrame, item: str, text: str, blocks: int) -> DataFrame:
    """(block, class, size, term): a row per item that has words, with their number and its class, and one per distinct word of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, texts in chunks(batch.column(1)):
                block = batch.column(0).slice(begin, len(texts)).to_pylist()
                words = [terms(t) for t in texts]
                out = [x for b, w in zip(block, words, strict=True) if w for x in [(b, length_class(len(w)), len(w), None), *((b, None, None, t) for t in set(w))]]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "class", "size", "term"])

    return items.select(block_of(item, text, blocks).alias("block"), F.col(text).alias("text")).mapInArrow(run, "block int, class int, size long, term binary")


def block_of(item: str, text: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(item, text), F.lit(blocks)).cast("int")


def with_matches(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "matches", threshold: float = THRESHOLD, overlap: float = OVERLAP, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with array ``out``: the test items found in each whole text.

    Each entry has the item, its normalised BM25 score, the shares of its
    question's and its answer's word triples in the passage, and the word at
    which that passage starts. Null and empty texts, null and empty items and
    empty tables match nothing; equal items all match; repeated rows each get
    their matches. Other columns pass unchanged, one named as the result is replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if carry is None else carry) if c != out]
    kind = items.schema[item].dataType
    entry = T._parse_datatype_string(MATCH.format(kind.simpleString()))
    arrow = to_arrow_type(entry)
    total = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    text_, found_ = spare(docs, "whole_text"), spare(docs, "found")
    done = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(text_))
    if blocks > 1:
        told = written(item_terms(items, item, item_text, blocks), "item-terms")
        # a row per class of length
        sizes = told.where("size IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("longest")).collect()
        whole = (sum(r["n"] for r in sizes), sum(r["words"] for r in sizes), {r["class"]: r["longest"] for r in sizes})
        # a term's frequency over all items, in the blocks that have the term
        df = told.where("term IS NOT NULL").groupBy("block", "term").agg(F.count("*").alias("df"))
        df = written(df.join(df.groupBy("term").agg(F.sum("df").alias("all")), "term").select("block", "term", "all"), "item-frequencies")
    for b in range(blocks):
        part = items.where(block_of(item, item_text, blocks) == b).select(item, item_text)
        corpus = Corpus(*whole, {bytes(r["term"]): r["all"] for r in df.where(F.col("block") == b).collect()}) if blocks > 1 else None
        shared = spark.sparkContext.broadcast(indexes([tuple(r) for r in part.collect()], threshold, corpus))  # at most about block_bytes of text

        def judge(texts: list[bytes], shared=shared) -> pa.Array:
            return pa.array(matches(shared.value, texts, threshold, overlap), arrow)

        found = per_text(spark, judge, entry)(F.col(text_))
        done = done.select(*[F.col(f"`{c}`") for c in kept], text_, (F.concat(found_, found) if b else found).alias(found_))
        if b + 1 < blocks:
            done = written(done, "contaminated")
    return done.select(*[F.col(f"`{c}`") for c in kept], F.col(found_).alias(out))
