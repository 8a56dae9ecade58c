"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, accents and homoglyphs to plain Latin,
digits and signs that stand for letters inside a word to those letters, all
else to spaces. As an accent can be what tells a toxic word from a clean one,
a second form of the text keeps the accents of Latin letters; terms with
accents are looked for in that one. The lexicon holds whole words and word
beginnings with weights: the log ratio of the share of toxic to the share of
clean documents that contain them. Hits inside an exception phrase (a term with
a neighbour that only clean documents have) don't count. The score is a logistic
function of the summed weight of the hits and of that sum normalised by the
number of words.

The lexicon, its phrases and the logistic curve are learned from a bounded sample of
labelled rows (``TOXIC_ROWS`` and ``CLEAN_ROWS``, those of least hash); scoring
covers every whole text.

Defined cases: null and empty texts have no hits and get the score of a text
without hits; repeated rows are scored each; an empty table gives an empty
table; without labelled rows of both kinds the lexicon is empty and every score
is 0. Other columns pass unchanged, an existing column named as the result is
replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.llm.store import written
from sparkmalt.llm.words import per_text

TOXIC_ROWS, CLEAN_ROWS, TERMS, PHRASES = 3072, 6144, 512, 512
BEGINNINGS = range(4, 9)

# Letters of other scripts that look like Latin ones, and signs used for letters: fixed values.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}


def folding() -> dict[int, str]:
    table = {}
    for code in range(0x250):
        c = chr(code).lower()
        base = unicodedata.normalize("NFKD", c)
        base = "".join(x for x in base if not unicodedata.combining(x))
        table[code] = base if base and all(x.isalpha() for x in base) else base if base.isdigit() else " "
    table |= {ord(a): b for a, b in LOOKALIKES.items()} | {ord(a.upper()): b for a, b in LOOKALIKES.items()}
    table |= {code: chr(code - 0xFEE0).lower() for code in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}
    table |= {code: " " for code in range(0x2000, 0x2070)} | {code: "" for code in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF)}
    return table | {code: "" for code in range(0x300, 0x370)}


FOLD = folding()
#: The same but for Latin letters with accents, which stay.
KEEP = FOLD | {code: chr(code).lower() for code in range(0xC0, 0x250) if chr(code).isalpha()}
SPELLED = re.compile(r"(?<![\w@$!])[0-9@$]?[^\W\d_]+(?:[0-9@$!]{1,2}[^\W\d_]+)+[0-9]?(?![\w@])|(?<![\w@$!])[0-9@$][^\W\d_]+(?![\w@])")
READ = str.maketrans(SIGNS)


def forms(text: str) -> tuple[str, str]:
    """The folded text and the one with accents kept: words of small letters between single or repeated spaces, with a space at both ends."""
    if SPELLED.search(text):
        text = SPELLED.sub(lambda m: m[0].translate(READ), text)
    return " " + text.translate(FOLD) + " ", " " + unicodedata.normalize("NFC", text).translate(KEEP) + " "


def fold(text: str) -> str:
    return forms(text)[0]


@dataclass
class Lexicon:
    """Terms (" word " or " beginning") with weights, exception phrases, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-100.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None, phrase.isascii()))
        for term, weight in self.weights.items():
            a.add_word(term, (len(term), weight, term.isascii()))
        if not self.weights:
            return None
        a.make_automaton()
        return a


def hits(a: ahocorasick.Automaton, text: str, plain: bool) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms in one form of a text that stand in no exception phrase."""
    free, found = [], []
    for end, (size, weight, ascii_) in a.iter(text):
        if ascii_ == plain:
            (free if weight is None else found).append((end - size + 1, end, weight))
    return [h for h in found if not any(x <= h[0] and h[1] <= y for x, y, _ in free)] if free else found


def features(a: ahocorasick.Automaton | None, texts: list[str]) -> np.ndarray:
    """Per text: log of the hits' summed weight, and of that sum per hundred words."""
    out = np.zeros((len(texts), 2))
    if a is None:
        return out
    for i, text in enumerate(texts):
        folded, accented = forms(text)
        total = sum(weight for _, _, weight in hits(a, folded, True))
        if not accented.isascii():
            total += sum(weight for _, _, weight in hits(a, accented, False))
        if total:
            words = folded.count(" ")
            out[i] = np.log1p(total), np.log1p(100 * total / (words + 20))
    return out


def phrases(a: ahocorasick.Automaton, text: str) -> set[str]:
    """The words of each hit with the word before, and with the word after, as " word word "."""
    found = set()
    for form, plain in zip(forms(text), (True, False), strict=True):
        for start, end, _ in hits(a, form, plain):
            first = start + 1
            last = form.find(" ", end if form[end] != " " else end - 1)
            before, after = form[:start].split(" ")[-1:], form[last + 1 : last + 60].split(" ")[:1]
            word = form[first:last]
            found |= {f" {x} {word} " for x in before if x} | {f" {word} {x} " for x in after if x}
    return found


def patterns(text: str) -> set[str]:
    """Whole words and word beginnings of a text, each once."""
    plain, accented = (set(x.split()) for x in forms(text))
    found = lambda words: {f for w in words if len(w) >= 3 for f in (f" {w} ", *(f" {w[:k]}" for k in BEGINNINGS if k <= len(w)))}
    return {f for f in found(plain) if f.isascii()} | {f for f in found(accented) if not f.isascii()}


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[float, ...]:
    """Weights (bias first) by Newton steps with a small ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(b)), a.T @ (y - p) - 0.05 * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def chosen(rows: list, terms: int) -> dict[str, float]:
    """The lexicon: of the candidates (term, toxic, weight) those with most toxic documents, none that another begins."""
    weights: dict[str, float] = {}
    for term, _, weight in sorted(rows, key=lambda r: (-r[1], -len(r[0]), r[0])):
        bare = term.rstrip(" ")
        if len(weights) < terms and not any(bare.startswith(x.rstrip(" ")) and (x[-1] != " " or x == term) or x.startswith(bare) and term[-1] != " " for x in weights):
            weights[term] = weight
    return weights


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, terms: int = TERMS, most_phrases: int = PHRASES, least: float = 3.0) -> Lexicon:
    """A lexicon of at most ``terms`` terms of weight ``least`` or more and at most ``most_phrases`` exception phrases, from at most ``toxic_rows`` + ``clean_rows`` rows of ``labels``.

    An exception is a term with a word beside it that clean rows have at least
    three times as rows and toxic rows never have.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("label"))
    marked = written(marked, "toxic-labels")
    part = lambda y, n: marked.where(F.col("label") == y).orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(n)
    sample = written(part(1, toxic_rows).unionByName(part(0, clean_rows)), "toxic-sample")
    # at most toxic_rows + clean_rows small rows
    texts = written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key").select("text", "label"), "toxic-texts")
    of = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if not (of.get(0) and of.get(1)):
        return Lexicon()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(patterns(x or ""))
            if sum(map(len, counts)) > 200_000:
                yield from given(counts)
                counts = (Counter(), Counter())
        yield from given(counts)

    def given(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for y, c in enumerate(counts):
            names, n = list(c), np.array(list(c.values()), dtype=np.int64)
            for a in range(0, len(names), 50_000):
                part, none = n[a : a + 50_000], np.zeros(len(n[a : a + 50_000]), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 50_000]), pa.array(part if y else none), pa.array(none if y else part)], names=["term", "toxic", "clean"])

    weight = F.log((F.col("toxic") + 0.5) / (of[1] + 1)) - F.log((F.col("clean") + 0.5) / (of[0] + 1))
    found = texts.mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = found.where(F.col("toxic") >= 4).withColumn("weight", weight).where(F.col("weight") >= least).orderBy(F.desc("toxic"), F.desc(F.length("term")), "term").limit(16 * terms).select("term", "toxic", "weight").collect()
    lexicon = Lexicon(chosen([tuple(r) for r in rows], terms))
    bare = docs.sparkSession.sparkContext.broadcast(lexicon)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = bare.value.automaton()
        for batch in batches:
            found = [(p, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in (phrases(a, x or "") if a else ())]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], names=["phrase", "label"])

    told = texts.mapInArrow(beside, "phrase string, label int").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    kept = told.where("toxic = 0 AND n >= 3").orderBy(F.desc("n"), "phrase").limit(most_phrases).collect()
    lexicon.exceptions = tuple(r["phrase"] for r in kept)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value.automaton()
        for batch in batches:
            f = features(a, [x or "" for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column(1)], names=["a", "b", "y"])

    # the bounded sample again
    got = np.array([tuple(r) for r in texts.mapInArrow(measured, "a double, b double, y int").collect()])
    lexicon.curve = logistic(got[:, :2], got[:, 2])
    return lexicon


def apply(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "toxicity", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the score ``out``, 0 to 1."""
    kept = [c for c in (docs.columns if carry is None else carry) if c != out]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    made: list = []

    def judge(texts: list[bytes]) -> pa.Array:
        if not made:
            made.append(shared.value.automaton())
        if made[0] is None:
            return pa.array(np.zeros(len(texts)))
        bias, *slopes = shared.value.curve
        f = features(made[0], [x.decode("utf-8", "replace") for x in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(bias + f @ np.array(slopes), -30, 30))))

    return docs.select(*[F.col(f"`{c}`") for c in kept], per_text(docs.sparkSession, judge, T.DoubleType())(F.col(f"`{text}`")).alias(out))
