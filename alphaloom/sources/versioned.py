"""Stored tables that take upserts as small files and swap what readers see in one step.

A table is a folder. ``data/stored_change=<n>/<partition>=<value>`` holds the rows that change ``n`` wrote,
and ``manifests/<n>`` names the pairs of change and partition that belong to the table after it.
A change writes its rows first and its manifest last, under a new number, so that one that is cut
off leaves the table as it was; of two writers that take the same number, one fails. Readers follow
the newest manifest.

Several changes of one partition are merged on read: of each ``unit``, the columns that a change
replaces as a whole, the newest change counts. Partitions that only one change has touched are read
as they are, and a filter on the partition column prunes folders. ``compact`` writes partitions of
several changes as one; ``expire`` removes files that no kept manifest names.

On a file system without atomic rename the swap is as atomic as the rename is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from alphaloom.sources import sinks


#: Folder names of changes; no column of a table may have this name.
CHANGE = "stored_change"


def _number(folder: str) -> int:
    return int(folder.partition("=")[2])


class VersionedTable:
    """A table under ``path``, partitioned by one text column and merged by ``unit``."""

    def __init__(self, spark: SparkSession, path: str, unit: list[str], partition: str):
        if partition not in unit:
            raise ValueError("unit must include the partition column")
        self.spark, self.path, self.unit, self.partition = spark, path.rstrip("/"), list(unit), partition

    # files
    def _hadoop(self, name: str = ""):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._hadoop(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the changes that were completed."""
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def _next(self) -> int:
        begun = [_number(n) for n in self._names("data") if n.startswith(f"{CHANGE}=")]
        return max([0, *self.versions(), *begun]) + 1

    def _manifest(self, version: int | None = None) -> dict:
        """``live``: (change, partition value) pairs; ``schema``: columns of the table."""
        done = [v for v in self.versions() if version is None or v <= version]
        if not done:
            return {"live": [], "schema": None}
        fs, at = self._hadoop(f"manifests/{done[-1]:012d}")
        stream = fs.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, version: int, live: list, schema: StructType) -> None:
        text = json.dumps({"live": sorted(live), "schema": schema.json()})
        fs, draft = self._hadoop(f"manifests/.draft-{version}")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, final = self._hadoop(f"manifests/{version:012d}")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"change {version} was made by another writer")

    # reading
    def _read(self, live: list, schema: StructType) -> DataFrame:
        folders = [f"{self.path}/data/{CHANGE}={v}/{self.partition}={p}" for v, p in live]
        typed = StructType([*schema.fields, StructField(CHANGE, StringType())])
        return self.spark.read.schema(typed).option("basePath", f"{self.path}/data").parquet(*folders)

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None, partitions: list[str] | None = None) -> DataFrame:
        """The table now, or as it was after a change; ``partitions`` names those to read."""
        manifest = self._manifest(version)
        if manifest["schema"] is None:
            raise FileNotFoundError(self.path)
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        live = [(v, p) for v, p in manifest["live"] if partitions is None or p in partitions]
        changes: dict[str, int] = {}
        for _, p in live:
            changes[p] = changes.get(p, 0) + 1
        names = [f.name for f in schema.fields]
        parts = []
        if single := [(v, p) for v, p in live if changes[p] == 1]:
            parts.append(self._read(single, schema).select(*names))
        if several := [(v, p) for v, p in live if changes[p] > 1]:
            rows = self._read(several, schema).withColumn(CHANGE, F.col(CHANGE).cast("long"))
            newest = rows.groupBy(*self.unit).agg(F.max(CHANGE).alias("_newest"))
            on = [rows[c].eqNullSafe(newest[c]) for c in self.unit]
            parts.append(rows.join(newest, [*on, rows[CHANGE] == newest["_newest"]], "left_semi").select(*names))
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def partitions(self) -> list[str]:
        """Partition values that hold rows."""
        return sorted({p for _, p in self._manifest()["live"]})

    def touched(self, rows: DataFrame) -> list[str]:
        """Partition values of some rows: one text each, as many as folders."""
        return sorted(str(r[0]) for r in rows.select(self.partition).distinct().collect())

    # writing
    def write(self, rows: DataFrame, replace: bool = False) -> int:
        """Add a change; its units replace stored ones, or it the whole table. Returns the change's number."""
        version, manifest = self._next(), self._manifest()
        schema = rows.schema if manifest["schema"] is None else StructType.fromJson(json.loads(manifest["schema"]))
        plain = StructType([StructField(f.name, f.dataType) for f in schema.fields])
        folder = f"{self.path}/data/{CHANGE}={version}"
        rows.select(*plain.names).hint("rebalance", self.partition).write.partitionBy(self.partition).parquet(folder)
        prefix = f"{self.partition}="
        fresh = [[version, n[len(prefix) :]] for n in self._names(f"data/{CHANGE}={version}") if n.startswith(prefix)]
        self._commit(version, [*([] if replace else manifest["live"]), *fresh], plain)
        return version

    def upsert(self, rows: DataFrame, update: list[str] | None = None) -> int:
        """Insert new units and change the given columns of stored ones, stamping ``updated_at``.

        Without ``update`` all columns of a stored unit change. With it, and for columns that
        ``rows`` don't have, stored values are read from the partitions that rows fall in.
        """
        if "updated_at" not in rows.columns:
            rows = sinks.stamped(rows)
        if not self.exists():
            return self.write(rows)
        manifest = StructType.fromJson(json.loads(self._manifest()["schema"]))
        rest = [f.name for f in manifest.fields if f.name not in self.unit]
        changed = {c for c in rest if c in rows.columns and (update is None or c in update)} | {"updated_at"}
        if changed >= set(rest):
            return self.write(rows)
        old = self.read(partitions=self.touched(rows))
        old = old.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(self.unit)), F.struct(*rest).alias("_old"))
        on = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(self.unit)]
        both = rows.join(old, on, "left")

        def pick(c: str):
            kept = F.col("_old")[c]
            if c not in rows.columns:
                return kept.alias(c)
            return F.col(c) if c in changed else F.when(F.col("_old").isNotNull(), kept).otherwise(F.col(c)).alias(c)

        return self.write(both.select(*self.unit, *(pick(c) for c in rest)))

    def compact(self, partitions: list[str] | None = None) -> list[str]:
        """Write partitions of several changes as one; returns which."""
        manifest = self._manifest()
        live = [tuple(x) for x in manifest["live"]]
        values = [p for _, p in live]
        many = sorted({p for p in values if values.count(p) > 1 and (partitions is None or p in partitions)})
        if many:
            version = self._next()
            self.read(partitions=many).hint("rebalance", self.partition).write.partitionBy(self.partition).parquet(f"{self.path}/data/{CHANGE}={version}")
            schema = StructType.fromJson(json.loads(manifest["schema"]))
            self._commit(version, [[v, p] for v, p in live if p not in many] + [[version, p] for p in many], schema)
        return many

    def expire(self, keep: int = 1) -> int:
        """Remove manifests but the newest ``keep``, and folders that none of these names; returns how many folders."""
        done = self.versions()
        named = {tuple(x) for v in done[-keep:] for x in self._manifest(v)["live"]}
        removed = 0
        for change in [n for n in self._names("data") if n.startswith(f"{CHANGE}=") and _number(n) <= (done[-1] if done else 0)]:
            for part in self._names(f"data/{change}"):
                value = part.partition("=")[2]
                if part.startswith(f"{self.partition}=") and (_number(change), value) not in named:
                    fs, at = self._hadoop(f"data/{change}/{part}")
                    removed += bool(fs.delete(at, True))
        for v in done[:-keep]:
            fs, at = self._hadoop(f"manifests/{v:012d}")
            fs.delete(at, False)
        return removed
