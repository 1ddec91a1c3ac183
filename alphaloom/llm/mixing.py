"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in the shuffled order of its source (by checksum of its id), and each
time the source is read again another turn in that order. A turn's virtual finish time is the
tokens that the source has given by then, divided by the source's target. All turns in order of
finish time, cut where the running total of tokens passes the budget, are the mix.

Both running totals are made in two levels, so that no task gets a source or the whole queue:
groups that follow the order are summed first, the sums are accumulated, and each group then adds
up its own rows on top of what stands before it. Groups are cells of the order whose number grows
with the rows.

Defined results: a null text has no tokens, and a document without tokens takes no part; a null
source is a source of its own, last in order; a null id is shuffled as the word null; rows that
repeat an id each take part and share its place in the shuffled order, told apart by their size
and text; an empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import WORD, row_key, stored

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size, and no document is used more often.
EPOCHS = 3
#: Parts into which a range of finish times is cut, and turns that are few enough to put in order.
RANGES = 1024
SORTED_TURNS = 10_000
#: The queue's order: ties in finish time go by place in the shuffled order, then by turn.
ORDER = ("finish", "place", "turn", "size", "text_key")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with the target of each source added.

    The budget is the sum of all sizes. A source that would get more than ``epochs`` times its
    size gets just that, and the others share the excess by weight: sources with the least size
    for their weight are capped first, and the first one that stays below its cap shows how many.
    The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fits", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("shares"))
    )
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap").cast("double") / F.col("weight"), F.col("rest"), F.col("shares")))).over(everything)
    ranked = ranked.withColumn("level", first)
    share = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.shares")
    return ranked.select("source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"), "budget")


def _prepared(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        row_key(doc_id, text).alias("text_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
    )
    return rows.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, before, finish, taken) of each document.

    ``before`` is the tokens of the source that come first in its shuffled order, ``finish`` the
    virtual time at which the first use ends; ``taken`` counts a document's tokens as often as the
    mix uses it.
    """
    rows = stored(_prepared(docs, doc_id, text, source), "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(per_source, weights, epochs).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    # As many cells as rows in each: the first 32 bits of the checksum, scaled down, follow its order.
    cells = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("cell", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * cells, 32))
    sums = rows.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0))).drop("cell_size")
    offsets = stored(offsets.join(shares, "source_key"), "mix-offsets")
    inside = Window.partitionBy("source_key", "cell").orderBy("place", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = running.join(offsets, ["source_key", "cell"]).withColumn("before", F.col("offset") + F.col("inside"))
    placed = placed.withColumn("finish", _finish(0)).drop("source_key", "cell", "offset", "inside")
    return _taken(stored(placed, "mix-queue"), epochs)


def _finish(turn) -> Column:
    """Virtual finish time of a document's use in this turn; null where the target is nothing."""
    given = F.col("source_size") * turn + F.col("before") + F.col("size")
    return F.when(F.col("target") > 0, given.cast("double") / F.col("target"))


def _taken(placed: DataFrame, epochs: int) -> DataFrame:
    """Cuts the queue where its running total passes the budget.

    Sums over ranges of finish time show in which range the total passes; that range is parted
    again until it holds few turns, and only these are put in order. Turns of one source never
    finish at the same time, so a single time can't hold more turns than there are sources.
    """
    budget = placed.agg(F.max("budget")).first()[0]
    if not budget:
        return placed.withColumn("taken", F.lit(0).cast("long")).drop("place", "budget")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), _finish(k).alias("finish")) for k in range(epochs))))
    turns = placed.where("size > 0").select("place", "size", "text_key", each.alias("t")).select("t.finish", "place", "t.turn", "size", "text_key")
    turns = turns.where("finish IS NOT NULL")
    low, high, room, edge = 0.0, float("inf"), budget, None
    while True:
        inside = turns.where((F.col("finish") > F.lit(low)) & (F.col("finish") <= F.lit(high)))
        n, least, most = inside.agg(F.count("*"), F.min("finish"), F.max("finish")).first()
        if not n or n <= SORTED_TURNS or least == most:
            break
        step = (most - least) / RANGES
        part = F.least(F.floor((F.col("finish") - F.lit(least)) / F.lit(step)), F.lit(RANGES - 1).cast("long"))
        sums = inside.groupBy(part.alias("part")).agg(F.sum("size").alias("s"), F.max("finish").alias("to"))
        upward = Window.orderBy("part")
        totals = sums.withColumn("upto", F.sum("s").over(upward)).withColumn("below", F.lag("to", 1, low).over(upward))
        passing = totals.where(F.col("upto") > F.lit(room)).orderBy("part").first()
        if passing is None:
            low = most
            break
        room -= passing["upto"] - passing["s"]
        low, high = passing["below"], passing["to"]
    if low < high and n:
        total = F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
        edge = inside.withColumn("upto", total).where(F.col("upto") <= F.lit(room)).orderBy(*(F.col(c).desc() for c in ("upto", *ORDER))).first()
    used = F.lit(0)
    for k in range(epochs):
        taken = _finish(k) <= F.lit(low)
        if edge is not None:
            taken = taken | (F.struct(_finish(k).alias("finish"), "place", F.lit(k).alias("turn"), "size", "text_key") <= F.struct(*(F.lit(edge[c]).alias(c) for c in ORDER)))
        used = used + F.coalesce(taken, F.lit(False)).cast("long")
    return placed.withColumn("taken", (F.col("size") * used).cast("long")).drop("place", "budget")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is used, in queue order.

    Rows that share id and text count as one document, used as often as they are all together.
    """
    found = queue(docs, weights, epochs, doc_id, text, source).where("taken > 0")
    uses = found.groupBy("text_key").agg(F.sum(F.expr("taken div size")).alias("uses"), F.min(F.struct("source_size", "target", "finish")).alias("q"))
    # All columns travel in one, so that their names clash with none here.
    own = docs.select(F.struct(*docs.columns).alias("d"), row_key(doc_id, text).alias("text_key"))
    one = own.join(uses, "text_key").withColumn("row", F.row_number().over(Window.partitionBy("text_key").orderBy("text_key"))).where("row = 1")
    each = one.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    when = F.col("q.finish") + F.col("turn") * F.col("q.source_size") / F.col("q.target")
    return each.orderBy(when, "text_key").select("d.*")
