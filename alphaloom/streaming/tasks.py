"""Progress of tasks from a stream of updates: live tasks in state, results in a table.

State holds unfinished tasks only. A task leaves it when an update says that it is completed or
failed, or when event time has passed its last update by the time to live; the table keeps what
became of it. Each trigger writes the tasks that changed as one small change of a versioned table,
so what is written follows the updates and not the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alphaloom.sources.versioned import VersionedTable
from alphaloom.streaming.metrics import drain_batches

FINISHED = ("completed", "failed")
#: Tasks of a folder of the table, on average, before there are more folders.
SLICE_TASKS = 1_000_000
_OUT = "task_id string, status string, progress double, records long, started long, updated long, updates long"
_STATE = "status string, progress double, records long, started long, updated long, updates long"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """Newest update of one task; batches are reduced one after the other."""
    now = state.get if state.exists else None
    if state.hasTimedOut:
        status, progress, records, started, updated, updates = now
        state.remove()
        yield _row(key[0], "expired", progress, records, started, updated, updates)
        return
    for rows in batches:
        at = rows["at"].to_numpy()
        if not len(at):
            continue
        k = at.argmax()
        started, updates = int(at.min()), len(at)
        if now is not None:
            started, updates = min(started, now[3]), updates + now[5]
        if now is None or at[k] >= now[4]:
            new = rows.iloc[k]
            now = (new["status"], float(new["progress"]), int(new["records"]), started, int(at[k]), updates)
        else:
            now = (*now[:3], started, now[4], updates)
    if now is None:
        return
    if now[0] in FINISHED:
        state.remove() if state.exists else None
    else:
        state.update(now)
        # Never at or before the watermark, which has passed late updates already.
        state.setTimeoutTimestamp(max(now[4] // 1000, state.getCurrentWatermarkMs()) + ttl_ms)
    yield _row(key[0], *now)


def _row(task, status, progress, records, started, updated, updates) -> pd.DataFrame:
    return pd.DataFrame({"task_id": [task], "status": [status], "progress": [progress], "records": [records], "started": [started], "updated": [updated], "updates": [updates]})


def progress(updates: DataFrame, ttl: str = "1 day") -> DataFrame:
    """A stream of (task, newest status) for each task that changed in a trigger.

    ``updates`` has task_id, ts (with a watermark), status, progress and records. Progress is held
    to 0 to 100; null numbers count as zero. A finished task that is updated again starts anew.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    held = F.least(F.greatest(F.coalesce("progress", F.lit(0.0)).cast("double"), F.lit(0.0)), F.lit(100.0))
    rows = updates.where("task_id IS NOT NULL AND ts IS NOT NULL").select(F.col("task_id").cast("string"), "ts", F.unix_micros("ts").alias("at"), "status", held.alias("progress"), F.coalesce("records", F.lit(0)).cast("long").alias("records"))

    def each(key, batches, state):
        return _follow(key, batches, state, ttl_ms)

    out = rows.groupBy("task_id").applyInPandasWithState(each, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({"started": F.timestamp_micros("started"), "updated": F.timestamp_micros("updated")})


def table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["task_id", "slice"], "slice")


def _sliced(rows: DataFrame, slices: int) -> DataFrame:
    """A folder for each task by checksum; its name holds how many there are."""
    slot = F.pmod(F.xxhash64("task_id"), F.lit(slices)).cast("string")
    return rows.withColumn("slice", F.concat(F.lit(f"{slices}-"), slot))


def slices_of(own: VersionedTable) -> int:
    """How many folders the table is dealt to: one, until it grows."""
    names = own.partitions()
    return int(names[0].partition("-")[0]) if names else 1


def follow_tasks(updates: DataFrame, path: str, ttl: str = "1 day", compact_every: int = 50, slice_tasks: int = SLICE_TASKS) -> StreamingQuery:
    """Keep the newest status of every task in the versioned table at ``path``.

    Every ``compact_every`` triggers the changes are put together, and a table whose folders hold
    more than ``slice_tasks`` tasks is dealt to more of them.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        own = table(batch.sparkSession, path)
        slices = slices_of(own)
        own.write(_sliced(batch, slices))
        if (epoch + 1) % compact_every == 0:
            wanted = -(-own.read().count() // slice_tasks)
            if wanted > slices:
                own.write(_sliced(own.read(), 2 * wanted), replace=True)
            else:
                own.compact()
            own.expire(keep=2)

    return drain_batches(progress(updates, ttl), each, "update")


def results(spark: SparkSession, path: str) -> DataFrame:
    """The newest status of every task."""
    return table(spark, path).read().drop("slice")
