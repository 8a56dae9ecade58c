"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, and joined with array functions:
neighbours of one role share a block, other neighbours get a new one. A long
conversation is first joined in chunks of consecutive turn numbers, so no task
sorts a whole hot conversation; the chunks join in the same way.

Template, per block::

    ### ROLE<says>
    TEXT[<also>
    TEXT...]</turn>

In roles and texts ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``#``
becomes ``\\h``, so no text can hold a control string, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SAYS, ALSO, STOP = "### ", "<says>\n", "<also>\n", "</turn>\n"
CHUNK_TURNS = 128


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def joined(units: Column) -> Column:
    """Segments of sorted units (first, last: roles; body: segments): between two units stands a mark that depends on their roles."""

    def one(unit: Column, i: Column) -> Column:
        before = F.get(units, i - 1)
        mark = F.when(i == 0, F.lit("")).when(before["last"] == unit["first"], F.lit(ALSO)).otherwise(F.concat(F.lit(STOP + HEAD), unit["first"], F.lit(SAYS)))
        return F.concat(F.array(segment(mark, F.lit(False))), unit["body"])

    return F.flatten(F.transform(units, one))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``segments``.

    ``segments`` is an array of (text, loss) whose texts make up ``formatted``;
    loss is true for the texts of the role ``learn``. Rows sort by turn, ties by
    role and text; a null turn comes first, a null role or text is empty,
    repeated rows stay, a null conversation id is a conversation like any other.
    Extra columns are left out. An empty table gives an empty table.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.floor(F.col(turn) / chunk_turns), F.lit(-(2**62))).alias("chunk"),
        escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    units = F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
        lambda x: F.struct(x["role"].alias("first"), x["role"].alias("last"), F.array(segment(x["text"], x["role"] == escape(F.lit(learn)))).alias("body")),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(units.alias("units"))
    chunks = chunks.select("conv_id", F.struct("chunk", F.element_at("units", 1)["first"].alias("first"), F.element_at("units", -1)["last"].alias("last"), joined(F.col("units")).alias("body")).alias("unit"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("unit"), lambda a, b: F.when(a["chunk"] < b["chunk"], -1).when(a["chunk"] > b["chunk"], 1).otherwise(0)).alias("units"))
    ends = F.concat(
        F.array(segment(F.concat(F.lit(HEAD), F.element_at("units", 1)["first"], F.lit(SAYS)), F.lit(False))),
        joined(F.col("units")),
        F.array(segment(F.lit(STOP), F.lit(False))),
    )
    return whole.select("conv_id", ends.alias("segments")).select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), F.filter("segments", lambda s: s["loss"] | (F.length(s["text"]) > 0)).alias("segments"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as an array of structs."""
    blocks = F.filter(F.split(formatted, STOP, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.instr(block, SAYS)
        role = unescape(F.substring(block, F.lit(len(HEAD) + 1), head - len(HEAD) - 1))
        return F.transform(F.split(F.substr(block, head + len(SAYS)), ALSO, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
