"""Chat formatting in budgeted windows, in DataFrame operations only.

A conversation becomes windows of whole turns. Prefix sums of turn tokens deal the turns to spans
of ``FRESH`` tokens by the place where a turn ends; the span's own turns are fresh in its window.
Before them stand the conversation's first turn, if that is a system turn, and at most ``HISTORY``
tokens of the turns at the end of the span before; both are repeated only to be read. A window has
a loss mask over the texts of its fresh assistant turns, so each target is learned once.

The template marks each turn by its role and an end mark. The characters that begin a mark, and
the escape character, get an escape character behind them inside texts, so that no text holds a
mark, and reading back gives every text as it was.

Prefix sums go in two levels, blocks of turns first, so that a very long conversation is spread.

Defined results: a null text is empty; a null role is the empty role; a null turn comes first;
rows with equal turns go by role and text; repeated rows are turns of their own; a null
conversation id is a conversation; a turn above the budget stands whole in a window of its own
span; an empty table gives no windows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import WORD, stored

FRESH = 384
HISTORY = 128
BLOCK = 256

#: The control strings of a common chat template.
OPEN, CLOSE = "<s>", "</s>"
USER, ASSISTANT = "[INST]", "[/INST]"
SYSTEM = "<<SYS>>"
OTHER, OTHER_END = "[ROLE]", "[/ROLE]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _head(role: Column) -> Column:
    """How a turn of this role begins."""
    known = F.when(role == "user", USER).when(role == "assistant", ASSISTANT).when(role == "system", SYSTEM)
    return F.concat(F.lit(OPEN), known.otherwise(F.concat(F.lit(OTHER), escape(role), F.lit(OTHER_END))), F.lit(" "))


def _ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with their tokens before and place in the conversation, by two levels of sums.

    A block is a stretch of turn numbers, so it has few rows unless turn numbers repeat.
    """
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.col(conv_id).cast("string"), F.lit("null")).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("long"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long"))
    blocks = turns.groupBy("key", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("key", "block", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.withColumn("n", F.row_number().over(inside) - 1).withColumn("t", before)
    placed = placed.join(offsets, ["key", "block"])
    return placed.select("conv_id", "key", "role", "text", "tokens", (F.col("n0") + F.col("n")).alias("place"), (F.col("t0") + F.col("t")).alias("before"))


def windows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fresh: int = FRESH, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, repeated, mask): one row for each window.

    ``repeated`` is how many turns at its start stand there to be read only; ``mask`` holds
    (start, length) in code points of the texts to learn, as they stand in ``formatted``.
    """
    placed = stored(_ordered(rows, conv_id, turn, role, text), "chat-turns")
    # A turn belongs to the span in which it ends; one without tokens to the span it stands in.
    span = F.floor((F.greatest(F.col("before") + F.col("tokens"), F.lit(1)) - 1) / fresh)
    item = F.struct("place", "role", "text", "tokens")
    spans = placed.withColumn("span", span).groupBy("key", "span").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(item)).alias("own"))
    # Turns at the end of a span whose tokens, up to the span's end, stay within the history.
    tail = F.aggregate(
        F.reverse("own"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<place:bigint,role:string,text:string,tokens:bigint>>").alias("kept")),
        lambda state, t: F.struct(
            (state["sum"] + t["tokens"]).alias("sum"),
            F.when(state["sum"] + t["tokens"] <= history, F.concat(F.array(t), state["kept"])).otherwise(state["kept"]).alias("kept"),
        ),
    )["kept"]
    by_span = Window.partitionBy("key").orderBy("span")
    spans = spans.withColumn("tail", tail)
    spans = spans.select("conv_id", "key", "span", "own", F.lag("tail").over(by_span).alias("recent"), (F.row_number().over(by_span) - 1).alias("window"))
    first = placed.where("place = 0 AND role = 'system'").select(F.col("key").alias("_key"), F.struct("place", "role", "text", "tokens").alias("system"))
    joined = spans.join(first, spans.key == first["_key"], "left")
    none = F.array().cast("array<struct<place:bigint,role:string,text:string,tokens:bigint>>")
    recent = F.filter(F.coalesce("recent", none), lambda t: (t["place"] > 0) | F.col("system").isNull())
    lead = F.concat(F.when(F.col("system").isNotNull() & (F.col("window") > 0), F.array("system")).otherwise(none), F.when(F.col("window") > 0, recent).otherwise(none))
    led = joined.select("conv_id", "window", lead.alias("lead"), "own")
    turns = F.concat("lead", "own")
    parts = led.select(
        "conv_id",
        "window",
        F.size("lead").alias("repeated"),
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), _head(t["role"]).alias("head"), escape(t["text"]).alias("body"))).alias("parts"),
    )
    pieces = F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))

    def step(state: Column, p: Column) -> Column:
        at = state["at"] + F.length(p["head"])
        wanted = (state["k"] >= F.col("repeated")) & (p["role"] == "assistant")
        here = F.array(F.struct(at.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((at + F.length(p["body"]) + len(CLOSE)).alias("at"), (state["k"] + 1).alias("k"), F.when(wanted, F.concat(state["mask"], here)).otherwise(state["mask"]).alias("mask"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    return parts.select("conv_id", "window", F.array_join(pieces, "").alias("formatted"), "repeated", F.aggregate("parts", start, step)["mask"].alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs that a formatted window holds."""
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parsed(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"(?s)^<s>(\[INST\]|\[/INST\]|<<SYS>>|\[ROLE\].*?\[/ROLE\]) ", 1)
        role = F.when(head == USER, "user").when(head == ASSISTANT, "assistant").when(head == SYSTEM, "system")
        role = role.otherwise(unescape(F.regexp_extract(head, r"(?s)^\[ROLE\](.*)\[/ROLE\]$", 1)))
        text = F.substring(piece, F.length(head) + len(OPEN) + 2, F.length(piece))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, parsed)


def read_targets(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"])))
