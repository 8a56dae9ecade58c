"""SentencePiece BPE encoding and decoding through a prefix table.

For a byte-pair vocabulary every prefix of a text has one valid encoding, and
it is fixed by its last token. So the table holds, per prefix, that token: the
candidates are the pieces that an Aho-Corasick automaton reports as ending
there, and a candidate fits if it may follow the last token of the prefix that
it leaves (the pair, merged on its own, stays two tokens). The ids are read
from the table backwards. Text is first cut where no piece can cross: before a
space mark that follows another character, and around characters that are in
no piece (these become byte tokens). Cuts repeat, so their ids are memoised.

Runs of two or more space marks are the exception: their pieces share one
score, where position and not the pair decides, so such cuts are merged step by
step in the model's own order.
"""

from __future__ import annotations

import heapq
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.llm.store import spare
from sparkmalt.llm.words import per_text

MARK = "▁"
MEMO = 300_000  # cuts in the newer half of the memory of a worker; the older half has as many at most
_loaded: dict[int, "PrefixTable"] = {}


class PrefixTable:
    """Encoder and decoder for one BPE model with byte fallback."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = sp.eos_id()
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.names = names
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [b"" if sp.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self.isbyte = bytearray(int(sp.is_byte(i)) for i in range(n))
        self.unknown = sp.unk_id()
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError("pieces that cross a space mark are not supported")
        self.known = {c for name in self.ids for c in name}
        self.words = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.words.add_word(name, (len(name), i))
        self.words.make_automaton()
        hard = "".join(re.escape(c) for c in "\n\t" if c not in self.known)
        self.cut = re.compile(f"{MARK}*[^{MARK}{hard}]+|{MARK}+" + (f"|[{hard}]" if hard else ""))
        self.alone = {i for name, i in self.ids.items() if self.merged(name) == [i]}
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[int]:
        """Ids by merging neighbours, best score first and leftmost among equals."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = right[a] if a >= 0 else -1
            if b >= 0 and (score := self.score.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-score, a, both))

        for a in range(len(text)):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a] if part[a] is not None else -1
            if b < 0 or part[a] + part[b] != both:
                continue
            part[a], part[b], right[a] = both, None, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(a)
            offer(left[a])
        return [self.ids[x] if x in self.ids else -1 for x in part if x is not None]

    def pair(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 2 * MEMO:
                self.fits.clear()
            ok = self.fits[key] = self.merged(self.names[a] + self.names[b]) == [a, b]
        return ok

    def table(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary, from its prefix table."""
        if text.startswith(MARK * 2):
            return self.merged(text)
        last = [-1] * (len(text) + 1)
        for end, (size, i) in self.words.iter(text):
            # longer pieces come first; the first that fits is the only one
            if last[end + 1] >= 0:
                continue
            at = end + 1 - size
            if i in self.alone if at == 0 else last[at] >= 0 and self.pair(last[at], i):
                last[end + 1] = i
        out, at = [], len(text)
        while at > 0:
            out.append(last[at])
            at -= len(self.names[last[at]])
        return out[::-1]

    def piece(self, cut: str) -> list[int]:
        """Ids of one cut."""
        if all(c in self.known for c in cut):
            return self.table(cut)
        out, part = [], ""
        for c in cut:
            if c in self.known:
                part += c
                continue
            if part:
                out += self.table(part)
                part = ""
            out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        return out + (self.table(part) if part else [])

    def encode(self, text: str, end: bool) -> list[int]:
        out: list[int] = []
        if text:
            memo = self.memo
            for cut in self.cut.findall((MARK + text).replace(" ", MARK)):
                ids = memo.get(cut)
                if ids is None:
                    ids = self.before.get(cut) or self.piece(cut)
                    if len(cut) <= 64:
                        if len(memo) >= MEMO:
                            # what is used again moves on from the older half
                            self.before, self.memo = memo, {}
                            memo = self.memo
                        memo[cut] = ids
                out += ids
        if end:
            out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: one leading space goes, control ids are silent, bytes that form no character become U+FFFD each."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = replaced(raw)
        first = next((i for i in ids if self.raw[i]), None)
        return text[1:] if first is not None and not self.isbyte[first] and text.startswith(" ") else text


def replaced(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def loaded(model: bytes) -> PrefixTable:
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PrefixTable(model)
    return _loaded[key]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", end: bool = True, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with columns ``ids`` (array<int>) and ``decoded``, for every whole text.

    A null or empty text has only the end id (none without ``end``) and decodes
    to the empty text. Other columns pass unchanged; existing columns named as
    the results are replaced. An empty table gives an empty table; repeated rows stay. The model
    file is read on the driver and broadcast (its size is fixed, half a MB).
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    if text in (ids, decoded):
        raise ValueError("the text column can't be a result column")
    both = spare(docs, "encoded")

    def judge(texts: list[bytes]) -> pa.Array:
        table = loaded(model.value)
        got = [table.encode(x.decode("utf-8", "replace"), end) for x in texts]
        return pa.StructArray.from_arrays([pa.array(got, pa.list_(pa.int32())), pa.array([table.decode(x) for x in got], pa.string())], names=["ids", "decoded"])

    kind = T._parse_datatype_string("ids array<int>, decoded string")
    found = docs.select(*[F.col(f"`{c}`") for c in kept], per_text(docs.sparkSession, judge, kind)(F.col(f"`{text}`")).alias(both))
    return found.select(*[F.col(f"`{c}`") for c in kept], F.col(both)["ids"].alias(ids), F.col(both)["decoded"].alias(decoded))
