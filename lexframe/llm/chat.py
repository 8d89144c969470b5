"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; array expressions merge adjacent turns of one
role to a block, in which a separator parts them; prefixes, escaped texts and ends are concatenated. All of it is expressions,
and takes time in proportion to a conversation's length.

Template: ``<|role:NAME|>`` opens a block, ``<|next|>`` parts turns of one role, ``<|end|>`` closes a block. In names and texts
``~`` is doubled and a ``~`` is put after the first character of anything that could be read as a control string of this or
other common templates; removing it again restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEXT, END = "<|next|>", "<|end|>"
OPEN, SHUT = "<|role:", "|>"
LOSS_ROLE = "assistant"
PART = 512

#: The beginnings of control strings of common chat templates.
_CONTROL = "([<\\[](?=\\||/?s>|</?SYS>|/?INST\\])|\\|(?=>))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "~", "~~"), _CONTROL, "$1~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "~(~?)", "$1")


def _blocks(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role merged. Block starts are found first, then each block is one slice."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
    stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
    bounds = F.arrays_zip(starts.alias("a"), stops.alias("b"))
    return F.transform(bounds, lambda x: F.struct(turns[x["a"]]["role"].alias("role"), F.transform(F.slice(turns, x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("texts")))


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss).

    ``loss`` are the [start, stop) places in ``formatted`` of the assistant's texts, one for each, and of nothing else. Turns are
    ordered by turn, nulls first, ties by role and text; repeated rows are turns of their own; null roles and texts count as
    empty; a null conv_id is a conversation of its own; an empty table gives an empty one; other columns are not read. One
    conversation must fit one row.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    sorted_turns = chats.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    merged = sorted_turns.select("conv_id", _blocks(F.col("turns")).alias("blocks"))

    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        lead = F.concat(F.lit(OPEN), escape(b["role"]), F.lit(SHUT))
        said = F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i == 0, lead).otherwise(F.lit(NEXT)), F.lit(False)), piece(escape(t), b["role"] == LOSS_ROLE)))
        return F.array_append(F.flatten(said), piece(F.lit(END + "\n"), F.lit(False)))

    # Places are running sums over the pieces; conversations are together already, so neither step shuffles again.
    made = merged.select("conv_id", F.posexplode(F.flatten(F.transform("blocks", pieces))).alias("nth", "piece"))
    before = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = made.withColumn("stop", F.sum(F.length("piece.text").cast("long")).over(before))
    ordered = F.array_sort(F.collect_list(F.struct("nth", F.col("piece.text").alias("text"))))
    learnt = F.array_sort(F.collect_list(F.when(F.col("piece.loss"), F.struct("nth", (F.col("stop") - F.length("piece.text")).alias("start"), "stop"))))
    rows = made.groupBy("conv_id").agg(ordered.alias("pieces"), learnt.alias("loss"))
    spans = F.transform("loss", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of the turns, parsed from the formatted text alone."""
    blocks = F.filter(F.split(formatted, "<\\|end\\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        cut_at = F.instr(block, SHUT)
        role = unescape(F.substr(block, F.lit(len(OPEN) + 1), cut_at - len(OPEN) - 1))
        texts = F.split(F.substr(block, cut_at + len(SHUT)), "<\\|next\\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digest(chats: DataFrame, **columns) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted text and its mask."""
    made = format_chats(chats, **columns).withColumn("turns", read_back(F.col("formatted")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # Characters are found by counting from a text's start, so the mask is read from parts of PART characters.
    made = made.withColumn("parts", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))

    def masked(s: Column) -> Column:
        first, length = F.floor(s["start"] / PART).cast("int"), (s["stop"] - s["start"]).cast("int")
        near = F.array_join(F.slice("parts", first + 1, F.floor(s["stop"] / PART).cast("int") - first + 1), "")
        return F.substr(near, (s["start"] % PART + 1).cast("int"), length)

    learnt = F.array_join(F.transform("loss", lambda s: unescape(masked(s))), "")
    rows = made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), spoken.alias("spoken"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", F.sha2("spoken", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
