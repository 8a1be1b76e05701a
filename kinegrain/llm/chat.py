"""Chat formatting in budgeted windows, DataFrame expressions only.

Turns get running sums of their tokens. The sums cut a conversation into
windows that begin and end between turns; each later window repeats the system
turn and a limited history, whose text is outside the loss mask, so every
assistant text is a target exactly once. Control strings inside texts are
escaped reversibly.

A conversation may be longer than a task should hold: sums are made per block
of turns and then over the blocks, and only a window's turns, which the budget
bounds, are ever gathered in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that share one block of the two-level running sum.
BLOCK = 256


def escape(c: Column) -> Column:
    """Leaves no ``<`` or ``>`` in a text; `unescape` gives the text back."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def turn_tokens(text: Column) -> Column:
    """A turn's cost: a token for every four bytes begun, and four for its marks."""
    return (F.floor((F.octet_length(text) + 3) / 4) + 4).cast("bigint")


def most_tokens(text: Column) -> Column:
    """A bound on a turn's cost with any byte-level tokenizer, which never makes more tokens than bytes; as many for its marks."""
    return (F.octet_length(escape(text)) + 24).cast("bigint")


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, system_reserve: int = 128, cost: Callable[[Column], Column] = turn_tokens) -> DataFrame:
    """One row per window: conv_id, window_start, window_part, n_repeated, n_turns, n_tokens, formatted, loss.

    Turns are ordered by (turn, role, text), nulls first; repeated rows stay.
    A null role or text is empty. ``cost`` gives a turn's tokens from its text,
    a positive bigint: `turn_tokens` estimates them, with `most_tokens` no
    window has more than ``budget`` whatever the tokenizer. With ``room = budget - history -
    system_reserve``, a window takes the turns that begin in one half-room bin
    of the running sum; a turn of over half the room is a window of its own, so
    no window exceeds the budget unless a single turn or the system turn does.
    The system turn is the first turn if its role is ``system``. History is
    the longest run of turns just before the window that fits ``history``.
    ``loss`` lists (start, length) in code points of ``formatted``, 0-based.
    Columns other than conv_id, turn, role and text are ignored; a null conv_id
    is a conversation too. An empty table gives no rows.
    """
    half = (budget - history - system_reserve) // 2
    if half < 1 or history > half:
        raise ValueError("history may be at most half of what budget and system_reserve leave")
    # Conversations are told apart by two columns without nulls, so that windows and the join deal rows alike.
    turns = conversations.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("nameless"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", cost(F.col("text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    in_block = Window.partitionBy("c", "nameless", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.withColumn("in_block", F.sum("tokens").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # One row for each block of a conversation: where it begins, and how long the conversation is.
    sums = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("nameless"),
        F.coalesce(F.floor(F.col("turn").cast("bigint") / BLOCK), F.lit(-(1 << 60))).alias("block"), cost(F.coalesce("text", F.lit(""))).alias("tokens"))
    sums = sums.groupBy("c", "nameless", "block").agg(F.sum("tokens").alias("block_tokens"))
    whole = Window.partitionBy("c", "nameless")
    blocks = sums.select(
        "c", "nameless", "block", F.sum("block_tokens").over(whole).alias("total"),
        F.coalesce(F.sum("block_tokens").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    turns = turns.join(blocks, ["c", "nameless", "block"])
    turns = turns.withColumn("end", F.col("base") + F.col("in_block")).withColumn("begin", F.col("end") - F.col("tokens"))
    bin_of = lambda at: F.floor(at / half)
    own_bin = bin_of(F.col("begin"))
    system = (F.col("begin") == 0) & (F.col("role") == "system")
    # Bins a turn may be repeated in: those that begin within `history` tokens of it, and for the system turn all.
    reach = F.when(system, bin_of(F.col("total"))).when(F.col("tokens") <= history, bin_of(F.col("begin") + history)).otherwise(own_bin)
    placed = turns.withColumn("bin", F.explode(F.sequence(own_bin, F.greatest(own_bin, reach))))
    piece = F.struct(
        "begin", "end", "tokens", "role", (F.col("tokens") > half).alias("long"), (F.col("bin") != own_bin).alias("past"), system.alias("system"),
        F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">")).alias("head"), escape(F.col("text")).alias("body"))
    gathered = placed.groupBy("c", "nameless", "bin").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(piece)).alias("all"))

    # A bin has at most two windows: its turns, and one turn that is too long to share a window.
    gathered = gathered.select("conv_id", "all", F.posexplode(F.array(F.lit(False), F.lit(True))).alias("part", "long"))
    own = F.filter("all", lambda x: ~x["past"] & (x["long"] == F.col("long")))
    gathered = gathered.withColumn("own", own).where(F.size("own") > 0).withColumn("start", F.col("own")[0]["begin"])
    near = lambda x: (x["tokens"] <= history) & (F.col("start") - x["begin"] <= history)
    repeated = F.filter("all", lambda x: (x["end"] <= F.col("start")) & (near(x) | x["system"]))
    gathered = gathered.withColumn("repeated", repeated).withColumn("n_repeated", F.size("repeated")).withColumn("p", F.concat("repeated", "own"))
    tail = "</turn>\n"
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        body = acc["at"] + F.length(x["head"])
        target = (x["role"] == "assistant") & (x["begin"] >= F.col("start"))
        span = F.array(F.struct(body.cast("bigint").alias("start"), F.length(x["body"]).cast("bigint").alias("length")))
        return F.struct(
            (body + F.length(x["body"]) + len(tail)).cast("bigint").alias("at"),
            F.when(target, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return gathered.select(
        "conv_id", F.col("start").alias("window_start"), F.col("part").alias("window_part"), "n_repeated", F.size("p").alias("n_turns"),
        F.expr("aggregate(p, 0L, (a, x) -> a + x.tokens)").alias("n_tokens"),
        F.concat_ws("", F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(tail)))).alias("formatted"),
        F.aggregate("p", first, step, lambda acc: acc["spans"]).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per window, what its text says: ``turns`` (role, text) that are new there, and ``targets`` under the mask."""
    heads = F.regexp_extract_all("formatted", F.lit("<turn ([^<>]*)>"), 1)
    bodies = F.regexp_extract_all("formatted", F.lit("<turn [^<>]*>([^<>]*)</turn>\n"), 1)
    turns = F.arrays_zip(heads.alias("role"), bodies.alias("text"))
    fresh = F.slice(turns, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    return windows.select(
        "conv_id", "window_start", "window_part", "formatted",
        F.transform(fresh, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("targets"))
