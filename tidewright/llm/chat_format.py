"""Chat formatting: turns of a conversation become one string with a loss mask. Spark expressions only.

Template: each run of adjacent turns of one role is a block

    <|turn|>ROLE<|body|>TEXT<|next|>TEXT...<|end|>

with the texts in turn order. Inside roles and texts a backslash is doubled and a backslash is put after the
first character of every control string (the template's own marks and the foreign ones below), so that none
can be forged and all can be restored. The loss mask is a list of spans (start, length) in code points of the
formatted string, one for each text of a trained role.

Defined results: turns are sorted by turn, nulls first; ties by role, then text. A null text or role counts
as empty. An empty text has a span of length 0. Rows with a null conv_id form one conversation. An empty
table gives no rows; other columns are ignored. One conversation is one output row, so its turns meet in one
task by contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks, then control strings of other common chat templates.
TURN, BODY, NEXT, END = "<|turn|>", "<|body|>", "<|next|>", "<|end|>"
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: Turns or pieces that one aggregate collects from.
CHUNK = 256

_CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted string, loss_spans array<struct<start, length>>."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    merged = sorted_turns.withColumn("runs", _runs(F.col("turns"))).withColumn("pieces", _pieces(F.col("turns"), F.col("runs"), trained_roles))
    closed = merged.withColumn("formatted", F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END)))
    return closed.select("conv_id", "formatted", _spans(F.col("pieces")).alias("loss_spans"))


def _chunks(items: Column) -> Column:
    """Where each CHUNK-th item stands: an aggregate that collects is run on parts of bounded size, so that its copying stays linear."""
    return F.sequence(F.lit(0), F.size(items) - 1, F.lit(CHUNK))


def _runs(turns: Column) -> Column:
    """Adjacent turns of one role merged: where each run starts, found by aggregating over the sorted turns."""

    def of_chunk(at: Column) -> Column:
        start = F.struct(F.get(turns, at - 1)["role"].alias("role"), at.alias("at"), F.array().cast("array<int>").alias("starts"))

        def merge(state: Column, turn: Column) -> Column:
            starts = F.when(state["role"].eqNullSafe(turn["role"]), state["starts"]).otherwise(F.array_append(state["starts"], state["at"]))
            return F.struct(turn["role"].alias("role"), (state["at"] + 1).alias("at"), starts.alias("starts"))

        return F.aggregate(F.slice(turns, at + 1, F.lit(CHUNK)), start, merge, lambda state: state["starts"])

    return F.flatten(F.transform(_chunks(turns), of_chunk))


def _pieces(turns: Column, runs: Column, trained_roles: tuple[str, ...]) -> Column:
    """For each turn what stands before its text, its escaped text, and whether it is trained: the first turn of a run opens a block."""

    def of_run(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get(runs, k + 1), F.size(turns)) - start

        def piece(turn: Column, j: Column) -> Column:
            opens = F.concat(F.when(k > 0, END).otherwise(""), F.lit(TURN), escape(turn["role"]), F.lit(BODY))
            return F.struct(F.when(j == 0, opens).otherwise(NEXT).alias("mark"), escape(turn["text"]).alias("text"), turn["role"].isin(*trained_roles).alias("trained"))

        return F.transform(F.slice(turns, start + 1, length), piece)

    return F.flatten(F.transform(runs, of_run))


def _spans(pieces: Column) -> Column:
    """Running code-point offsets, kept where the piece is trained: those of the chunks first, then within each."""
    size = lambda p: (F.length(p["mark"]) + F.length(p["text"])).cast("bigint")
    zero = F.lit(0).cast("bigint")
    totals = F.transform(_chunks(pieces), lambda at: F.aggregate(F.slice(pieces, at + 1, F.lit(CHUNK)), zero, lambda total, p: total + size(p)))
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("bases"))
    bases = F.aggregate(totals, start, lambda state, total: F.struct((state["at"] + total).alias("at"), F.array_append(state["bases"], state["at"]).alias("bases")), lambda state: state["bases"])

    def of_chunk(base: Column, k: Column) -> Column:
        none = F.array().cast("array<struct<start:bigint,length:bigint>>")

        def add(state: Column, p: Column) -> Column:
            span = F.struct((state["at"] + F.length(p["mark"])).alias("start"), F.length(p["text"]).cast("bigint").alias("length"))
            return F.struct((state["at"] + size(p)).alias("at"), F.when(p["trained"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK)), F.struct(base.alias("at"), none.alias("spans")), add, lambda state: state["spans"])

    return F.flatten(F.transform(bases, of_chunk))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> as the formatted string has them, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda _, i: i > 0)

    def texts(block: Column) -> Column:
        body = F.regexp_replace(F.substring_index(block, BODY, -1), r"<\|end\|>$", "")
        role = unescape(F.substring_index(block, BODY, 1))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, texts))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
