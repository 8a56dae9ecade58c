"""Repair of conversations whose turns are blank, repeated, cut short or out of order.

A row's first fault counts: blank (no character but spaces), duplicate (role and
text are seen earlier in the conversation) or truncated (the last character that
is no space is none of ``.!?``). Blank and duplicate turns go; any other may be
kept, given the role user or assistant, or deleted, and turns without text may be
put in anywhere, until the initials of roles read ``(s?(ua)+)?``. Costs are in
COSTS; a truncated turn that stays costs 3 more. Of the cheapest ways the one is
taken whose audit (the initials of the edits, in order) is least in ASCII.

The retained turns are the subject of a dynamic programme. What is deleted
between two of them is priced by prefix sums of deletions: a running minimum for
each state (the role retained last) of cost less deletions up to there suffices,
so each turn is looked at once. The pair of roles gives the turns put in between.
As the states' audits mostly agree but for their ends, what they agree on is sure
at once, turn by turn, and only the open end of the audits is carried on.

Rows go by turn (null first), then role, then text. They are dealt by conversation
and sorted there, and stream through one pass: a task holds no texts but those of
``edits`` that are not sure yet. A conversation is one stream because its digest
chains over all its texts.

Null roles and texts count as one space. Null ids are one conversation, null turns
come first and make no gap. Rows that repeat are duplicates of the first; empty
tables give an empty table; other columns are ignored. Edits put in are ``I`` with
an empty text. A role's initial is its first character; other roles than system,
user and assistant can only be given another role or be deleted, but for those
that share an initial.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmalt.llm.words import small_batches

COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
SPACES = r"\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}
# The roles that must be put in between one retained role (or the start, '') and the next (or the end, '').
BETWEEN = {
    "": {"s": "", "u": "", "a": "u", "": ""},
    "s": {"u": "", "a": "u", "": "ua"},
    "u": {"u": "a", "a": "", "": "a"},
    "a": {"u": "", "a": "u", "": ""},
}
LEGAL = ("su", "ua", "au")
BEYOND = 7  # a state this much dearer than another can't win: the other can do all it does for at most 7 more (a deletion and a turn put in)
LATEST = 64  # audits are compared after so many rows
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, step long, edit string, role string, text string"


def fault(text: Column) -> Column:
    """blank, truncated or null, by the text alone."""
    last = F.regexp_extract(text, rf"([^{SPACES}])[{SPACES}]*\z", 1)
    return F.when(~text.rlike(rf"[^{SPACES}]"), "blank").when(~last.isin(".", "!", "?"), "truncated")


def judged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault), dealt by conversation and sorted within it."""
    small_batches(conversations.sparkSession)
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    # the windows below need no other exchange than this one
    w = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = said.repartition("conv_id").withColumn("nth", F.row_number().over(w))
    own = fault(F.col("text"))
    marked = seen.select("conv_id", "turn", "role", "text", F.when(own == "blank", own).when(F.col("nth") > 1, "duplicate").otherwise(own).alias("fault"))
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


class Way(NamedTuple):
    """The cheapest way to a state: cost less deletions up to there, audit from where it is open, digest of the turns so far."""

    value: int
    audit: str
    digest: object


def lines(digest: object, last: str, put: str, *turn: str) -> object:
    """The digest after the turns put in, and one of (role, text)."""
    out = digest.copy()
    for role, text in [(ROLES[x], "") for x in put] + ([turn] if turn else []):
        out.update((("\n" if last else "") + f"{role}:{text}").encode())
        last = role
    return out


class Repair:
    """The repair of one conversation, a row at a time; ``give``, if there is one, gets each edit once it is sure: letter, role, text.

    Without ``give`` no text is held: each state has the digest of its turns.
    """

    def __init__(self, give: Callable[[str, str, str], None] | None = None) -> None:
        self.give = give
        self.deleted = 0  # cost of deleting every row so far
        self.states: dict[str, Way] = {"": Way(0, "", hashlib.sha256())}  # by the initial of the role retained last
        self.held: list[tuple[str, str]] = []  # rows of the open audits, for ``give``
        self.sure: list[str] = []
        self.role, self.rows = "", 0  # initial of the last role given; rows of the open audits

    def add(self, role: str, text: str, fault: str | None) -> None:
        found: dict[str, tuple] = {}
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            for letter, new, named in (("K", role[:1], role), ("R", "u", ROLES["u"]), ("R", "a", ROLES["a"])):
                for last, way in self.states.items():
                    put = BETWEEN[last].get(new) if new else None
                    if put is not None:
                        one = (way.value + self.deleted + COSTS["I"] * len(put) + COSTS[letter] + more, way.audit + "I" * len(put) + letter, last, put, named)
                        found[new] = min(found.get(new, one), one)
        self.deleted += COSTS["D"]
        ways = {last: Way(way.value, way.audit + "D", way.digest) for last, way in self.states.items()}
        for new, (cost, audit, last, put, named) in found.items():
            if new not in ways or (cost - self.deleted, audit) < ways[new][:2]:
                ways[new] = Way(cost - self.deleted, audit, lines(self.states[last].digest, last, put, named, text))
        least = min(way.value for way in ways.values())
        self.states = {last: way for last, way in ways.items() if way.value <= least + BEYOND}
        if self.give:
            self.held.append((role, text))
        self.rows += 1
        if self.rows % LATEST == 0:
            self.settle(os.path.commonprefix([way.audit for way in self.states.values()]))

    def settle(self, audit: str) -> None:
        """What all states agree on is sure."""
        self.sure.append(audit)
        self.states = {last: way._replace(audit=way.audit[len(audit) :]) for last, way in self.states.items()}
        self.rows -= len(audit) - audit.count("I")
        if not self.give:
            return
        rows = 0
        for letter in audit:
            role, text = self.held[rows] if letter != "I" else ("", "")
            rows += letter != "I"
            if letter in "RI":
                role = ROLES["a" if self.role == "u" else "u"]
            self.give(letter, role, text)
            self.role = role[:1] if letter != "D" else self.role
        self.held = self.held[rows:]

    def end(self) -> tuple[int, str, str]:
        """The cost, the whole audit, and the sha256 of the repaired lines."""
        ways = [(way.value + self.deleted + COSTS["I"] * len(BETWEEN[last][""]), way.audit + "I" * len(BETWEEN[last][""]), last) for last, way in self.states.items()]
        cost, audit, last = min(ways)
        digest = lines(self.states[last].digest, last, BETWEEN[last][""])
        self.settle(audit)
        return cost, "".join(self.sure), digest.hexdigest()


class Report:
    """Counts and digest of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.counts, self.illegal, self.before = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        self.first, self.last, self.turns = None, None, 0
        self.repair = Repair()

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault:
            self.counts[fault] += 1
        if self.before is not None:
            self.illegal += (self.before + role[:1]) not in LEGAL
        self.before = role[:1]
        self.repair.add(role, text, fault)

    def row(self) -> dict:
        cost, audit, digest = self.repair.end()
        gaps = 0 if self.first is None else min(2**63 - 1, self.last - self.first + 1 - self.turns)
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(a conversation begins here, row) of sorted rows."""
    before: object = streamed
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield row[0] != before, row
            before = row[0]


def reports(conversations: DataFrame) -> DataFrame:
    """A row per conversation: gaps between turns, faults, pairs of roles that don't belong together, cost, audit and the sha256 of the repaired ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, one = [], None
        for begins, (conv_id, *row) in streamed(batches):
            if begins:
                out += [one.row()] if one else []
                one = Report(conv_id)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
            one.add(*row)
        out += [one.row()] if one else []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    return judged(conversations).mapInArrow(run, REPORT)


def edits(conversations: DataFrame) -> DataFrame:
    """A row per edit, in order by ``step``: K and R with the turn as it stays, I with an empty text, D with the turn that goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        step, conv, one = 0, None, None

        def give(letter: str, role: str, text: str) -> None:
            nonlocal step
            out.append({"conv_id": conv, "step": step, "edit": letter, "role": role, "text": text})
            step += 1

        for begins, (conv_id, _, role, text, fault_) in streamed(batches):
            if begins:
                if one:
                    one.end()
                step, conv, one = 0, conv_id, Repair(give)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out.clear()
            one.add(role, text, fault_)
        if one:
            one.end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return judged(conversations).mapInArrow(run, EDITS)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults for trials, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    left = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumn("n", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", role.alias("role"), left.alias("text"))
