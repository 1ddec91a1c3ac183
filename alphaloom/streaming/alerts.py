"""Alert rules over metric streams, with no task that holds all points of a rule.

A rule counts hits in a row and fires when the count is reached and its cool-down is over; then
the count starts again. So the next alert after one at place p is the first place that has enough
hits in a row behind it, all of them after p, and lies a cool-down after p: a later p never has an
earlier successor. That makes a rule's alerts a chain of places, which blocks can work on apart:

1. A batch's points are range-partitioned by rule and time into blocks of about ``BLOCK`` rows.
2. Each block tells its length and the hits at both ends; running sums over these few rows give
   every block its offset and the hits in a row that it starts with.
3. Each block follows all its chains to where they leave it. What a chain asks of the blocks after
   it, an earliest place and time, is sent to the one block that can answer.
4. Chains from block to block are put together by doubling: after k rounds, 2^k blocks.
5. Blocks that the rule's chain enters replay it from there, all at the same time.

Between batches two numbers a rule are kept, the hits in a row and the time of the last alert, in
one small table for each epoch. A repeated epoch reads the same table and gives the same alerts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.session import scratch_path, stored
from alphaloom.sources import sinks
from alphaloom.streaming.metrics import drain_batches, rule_hits

#: Points of a block on average.
BLOCK = 200_000
#: Before all times: no alert has been given yet.
NEVER = -(2**62)

STATE = "rule_id string, hits long, last long"
_LINK = "rule_id string, source int, place long, target int, earliest long, first long"
_STEP = "rule_id string, place long, entry long, part int, exit long"


def _runs(hit: np.ndarray, carry: int) -> np.ndarray:
    """Hits in a row up to each place, ``carry`` of them before the first."""
    place = np.arange(len(hit))
    miss = np.maximum.accumulate(np.where(hit, -1, place))
    return np.where(miss < 0, place + 1 + carry, place - miss)


def _local(points: pd.DataFrame, blocks: pd.DataFrame):
    """For each rule of a block: its places, times, hits in a row, who can fire, and each one's successor inside (or -1)."""
    known = blocks.set_index("rule_id")
    for rule, rows in points.groupby("rule_id", sort=False):
        rows = rows.sort_values(["at", "value"], kind="stable")
        block = known.loc[rule]
        at, hit, need, wait = rows["at"].to_numpy(), rows["hit"].to_numpy(bool), int(rows["need"].iloc[0]), int(rows["wait"].iloc[0])
        run = _runs(hit, int(block["carry"]))
        place = np.arange(len(rows)) + int(block["offset"])
        able = np.flatnonzero(hit & (run >= need))
        after = np.maximum(np.searchsorted(at[able], at[able] + wait), np.searchsorted(place[able], place[able] + need))
        yield rule, rows, block, place, at, run, able, np.where(after < len(able), after, -1), need, wait


def _ends(after: np.ndarray) -> np.ndarray:
    """Where each chain stops inside the block: pointers to successors, doubled until they rest."""
    last = np.where(after < 0, np.arange(len(after)), after)
    while True:
        moved = last[last]
        if np.array_equal(moved, last):
            return last
        last = moved


def _summary(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
    out = []
    for rule, rows in points.groupby("rule_id", sort=False):
        hit = rows.sort_values(["at", "value"], kind="stable")["hit"].to_numpy(bool)
        trail = int(_runs(hit, 0)[-1]) if hit[-1] else 0
        out.append((rule, int(key[0]), len(hit), trail, bool(hit.all())))
    return pd.DataFrame(out, columns=["rule_id", "part", "n", "trail", "whole"])


def _reach(key: tuple, points: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The last place and time that can fire in each block of a rule, for those who look for a successor."""
    out = [(rule, int(key[0]), int(place[able[-1]]), int(at[able[-1]])) for rule, _, _, place, at, _, able, _, _, _ in _local(points, blocks) if len(able)]
    return pd.DataFrame(out, columns=["rule_id", "part", "last_place", "last_at"])


def _aim(blocks: pd.DataFrame, part: int, earliest: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of a rule's later blocks that can fire, in order, the first that holds an answer, or -1."""
    later = [r for r in blocks["later"].iloc[0] if r["part"] > part] if blocks["later"].iloc[0] is not None else []
    if not later:
        return np.full(len(first), -1)
    parts = np.array([r["part"] for r in later])
    k = np.maximum(np.searchsorted([r["last_at"] for r in later], earliest), np.searchsorted([r["last_place"] for r in later], first))
    return np.where(k < len(parts), parts[np.minimum(k, len(parts) - 1)], -1)


def _links(key: tuple, points: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Where each chain that stops in this block goes on; the rule's first block also asks for the start."""
    out = []
    for rule, _, block, place, at, _, able, after, need, wait in _local(points, blocks):
        stop = np.unique(_ends(after)) if len(able) else np.zeros(0, np.int64)
        own = blocks[blocks["rule_id"] == rule]
        earliest, first = at[able[stop]] + wait, place[able[stop]] + need
        target = _aim(own, int(key[0]), earliest, first)
        out.append(pd.DataFrame({"rule_id": rule, "source": int(key[0]), "place": place[able[stop]], "target": target, "earliest": earliest, "first": first})[target >= 0])
        if block["offset"] == 0:
            begin = NEVER if block["last"] == NEVER else int(block["last"]) + wait
            target = _aim(own, -1, np.array([begin]), np.array([0]))
            out.append(pd.DataFrame({"rule_id": rule, "source": -1, "place": [-1], "target": target, "earliest": [begin], "first": [0]})[target >= 0])
    return pd.concat(out) if out else pd.DataFrame(columns=["rule_id", "source", "place", "target", "earliest", "first"])


def _steps(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The place where each chain enters the block, and where it stops in it."""
    out = []
    if len(points) and len(asked):
        blocks = points[["rule_id", "offset", "carry"]].drop_duplicates("rule_id")
        by_rule = dict(iter(asked.groupby("rule_id")))
        for rule, _, _, place, at, _, able, after, _, _ in _local(points, blocks):
            if rule in by_rule:
                mine = by_rule[rule]
                entry = np.maximum(np.searchsorted(at[able], mine["earliest"].to_numpy()), np.searchsorted(place[able], mine["first"].to_numpy()))
                out.append(pd.DataFrame({"rule_id": rule, "place": mine["place"].to_numpy(), "entry": place[able[entry]], "part": int(key[0]), "exit": place[able[_ends(after)[entry]]]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["rule_id", "place", "entry", "part", "exit"])


def _replay(key: tuple, points: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The alerts of a block, from where each rule's chain enters it."""
    out = []
    if len(points) and len(entries):
        begin = entries.set_index("rule_id")
        blocks = points[["rule_id", "offset", "carry"]].drop_duplicates("rule_id")
        for rule, rows, _, place, at, run, able, after, _, _ in _local(points, blocks):
            if rule not in begin.index:
                continue
            k, before = int(np.searchsorted(place[able], begin.loc[rule, "entry"])), int(begin.loc[rule, "place"])
            value = rows["value"].to_numpy()
            while k >= 0:
                i = able[k]
                hits = int(run[i]) if before < 0 else min(int(run[i]), int(place[i]) - before)
                out.append((rule, int(place[i]), int(at[i]), value[i], hits))
                before, k = int(place[i]), int(after[k])
    return pd.DataFrame(out, columns=["rule_id", "place", "at", "value", "hits"])


def _with_state(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    """Each block's offset and the hits in a row before it, from the blocks before and the state."""
    before = Window.partitionBy("rule_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    if state is None:
        blocks = blocks.withColumns({"hits": F.lit(0).cast("long"), "last": F.lit(NEVER).cast("long")})
    else:
        blocks = blocks.join(state, "rule_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0).cast("long")), "last": F.coalesce("last", F.lit(NEVER).cast("long"))})
    # A stretch begins after each block with a miss: its trailing hits, and all blocks since.
    stretch = blocks.withColumn("stretch", F.coalesce(F.sum((~F.col("whole")).cast("int")).over(before), F.lit(0)))
    since = Window.partitionBy("rule_id", "stretch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.lag("trail", 1).over(Window.partitionBy("rule_id").orderBy("part"))
    head = Window.partitionBy("rule_id", "stretch").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stretch = stretch.withColumn("begin", F.coalesce(begin, F.col("hits"))).withColumn("begin", F.first("begin").over(head))
    return stretch.select("rule_id", "part", "n", "trail", "whole", "hits", "last", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), (F.col("begin") + F.coalesce(F.sum("n").over(since), F.lit(0))).alias("carry"))


def fire(points: DataFrame, state: DataFrame | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(alerts, new state) of a finite set of points.

    ``points`` has rule_id, at (long, any unit), value, hit, need (hits in a row that fire) and wait
    (cool-down in units of ``at``); need and wait are the same for all points of a rule. Points
    without time or rule are left out; a null hit is a miss. Alerts are (rule_id, place, at, value, hits).
    Points of one rule, time and value are in one block.
    """
    rows = points.where("at IS NOT NULL AND rule_id IS NOT NULL").select("rule_id", "at", "value", F.coalesce("hit", F.lit(False)).alias("hit"), F.greatest("need", F.lit(1)).cast("long").alias("need"), F.greatest("wait", F.lit(0)).cast("long").alias("wait"))
    rows = stored(rows, "alerts-points")
    parts = max(1, -(-rows.count() // block))
    if parts > 1:
        rows = rows.repartitionByRange(parts, "rule_id", "at", "value")
        rows = stored(rows.withColumn("part", F.spark_partition_id()), "alerts-blocks")
    else:
        rows = rows.withColumn("part", F.lit(0))
    told = rows.groupBy("part").applyInPandas(_summary, "rule_id string, part int, n long, trail long, whole boolean")
    blocks = stored(_with_state(told, state), "alerts-offsets")
    by = lambda df: df.groupBy("part")
    reach = by(rows).cogroup(by(blocks)).applyInPandas(_reach, "rule_id string, part int, last_place long, last_at long")
    reach = reach.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("part", "last_place", "last_at"))).alias("later"))
    aimed = blocks.join(reach, "rule_id", "left")
    links = stored(by(rows).cogroup(by(aimed)).applyInPandas(_links, _LINK), "alerts-links")

    # Blocks are as many as sources send them questions: pairs follow each other like a staircase.
    pairs = links.select(F.col("target").alias("part"), F.col("source").alias("asker")).distinct()
    placed = rows.join(blocks.select("rule_id", "part", "offset", "carry"), ["rule_id", "part"])
    asked = links.select("rule_id", F.col("target").alias("part"), "source", "place", "earliest", "first")
    steps = placed.join(pairs, "part").groupBy("part", "asker").cogroup(asked.groupBy("part", "source")).applyInPandas(_steps, _STEP)
    steps = stored(steps, "alerts-steps")

    deepest = blocks.groupBy("rule_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reached = steps.where("place = -1").select("rule_id", "place", "entry", "part", "exit")
    jump = steps.select("rule_id", F.col("place").alias("from"), F.col("exit").alias("to"))
    if deepest > 1:
        reached = stored(_reached(steps, jump, deepest), "alerts-reached")
    found = placed.groupBy("part").cogroup(by(reached)).applyInPandas(_replay, "rule_id string, place long, at long, value double, hits long")
    found = stored(found, "alerts-found")

    newest = found.groupBy("rule_id").agg(F.max_by(F.struct("place", "at"), "place").alias("f"))
    tail = blocks.groupBy("rule_id").agg(F.sum("n").alias("n"), F.max_by(F.struct("whole", "trail", "carry", "n", "last"), "part").alias("b"))
    run = F.when(F.col("b.whole"), F.col("b.carry") + F.col("b.n")).otherwise(F.col("b.trail"))
    own = tail.join(newest, "rule_id", "left").select("rule_id", F.coalesce(F.least(run, F.col("n") - 1 - F.col("f.place")), run).alias("hits"), F.coalesce("f.at", "b.last").alias("last"))
    if state is not None:  # rules without points keep theirs
        own = own.unionByName(state.join(own.select("rule_id"), "rule_id", "left_anti").select("rule_id", "hits", "last"))
    return found, own


def _reached(steps: DataFrame, jump: DataFrame, deepest: int) -> DataFrame:
    """The steps that a rule's own chain takes, out of those of all chains."""
    here = stored(steps.where("place = -1").select("rule_id", F.col("exit").alias("at")), "alerts-here")
    for _ in range(max(1, math.ceil(math.log2(deepest)))):
        ahead = here.join(jump, (here.rule_id == jump.rule_id) & (F.col("at") == F.col("from"))).select(here.rule_id, F.col("to").alias("at"))
        here = stored(here.unionByName(ahead), "alerts-here")
        further = jump.select("rule_id", F.col("from").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(further, ["rule_id", "to"]).select("rule_id", "from", F.col("next").alias("to")), "alerts-jump")
    on = here.select("rule_id", F.col("at").alias("place")).distinct()
    return steps.where("place = -1").unionByName(steps.join(on, ["rule_id", "place"], "left_semi").select(*steps.columns))


def rule_points(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Points of the enabled rules; times in microseconds, cool-downs rounded up to them."""
    on = rules.select("rule_id", F.col("trigger_count").cast("long").alias("need"), F.ceil(F.col("evaluation_window").cast("double") * 1_000_000).alias("wait"))
    matched = rule_hits(metrics, rules).select("rule_id", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"), "hit")
    return matched.join(on, "rule_id")


def suppression_points(alerts: DataFrame, minutes: float) -> DataFrame:
    """Alerts of a title as hits of a rule that fires on each, if more than so many minutes have passed."""
    wait = math.floor(minutes * 60_000_000) + 1
    at = F.unix_micros("fired_at").alias("at")
    return alerts.select(F.col("title").alias("rule_id"), at, F.col("value").cast("double").alias("value"), F.lit(True).alias("hit"), F.lit(1).alias("need"), F.lit(wait).alias("wait"))


def _follow(stream: DataFrame, path: str, points, block: int) -> None:
    """Run ``fire`` on every micro-batch; alerts and state are one folder an epoch."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = f"{path}_state/epoch={epoch - 1}"
        state = spark.read.schema(STATE).parquet(before) if epoch > 0 and sinks.path_exists(spark, before) else None
        found, after = fire(points(batch), state, block)
        found.withColumn("fired_at", F.timestamp_micros("at")).drop("at", "place").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        # State comes last: an epoch that was cut off is repeated from the state before it.
        after.write.mode("overwrite").parquet(f"{path}_state/epoch={epoch}")

    drain_batches(stream, each)


def alerts(metrics: DataFrame, rules: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """(rule_id, fired_at, value, hits) of a metric stream, processed to its end into ``path``."""
    path = path or scratch_path(metrics.sparkSession, "alerts")
    _follow(metrics, path, lambda batch: rule_points(batch, rules), block)
    found = metrics.sparkSession.read.schema("rule_id string, value double, hits long, fired_at timestamp").parquet(path)
    return found.select("rule_id", "fired_at", "value", F.col("hits").cast("int").alias("hits"))


def suppress(fired: DataFrame, minutes: float, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """(title, fired_at, value): alerts of a stream, but for those within so many minutes of the last one let through of their title."""
    path = path or scratch_path(fired.sparkSession, "suppressed")
    _follow(fired, path, lambda batch: suppression_points(batch, minutes), block)
    found = fired.sparkSession.read.schema("rule_id string, value double, hits long, fired_at timestamp").parquet(path)
    return found.select(F.col("rule_id").alias("title"), "fired_at", "value")
