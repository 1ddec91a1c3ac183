"""Feature store on partitioned Parquet: registry, values, versions, lineage and quality.

Metadata tables hold one row per feature, version or run. Values are partitioned by feature (or
version) and month, so replacing a date range rewrites only its months.
"""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.stats import correlation
from alphaloom.operators import crosssection as X
from alphaloom.operators import preprocess as P
from alphaloom.session import scratch_root
from alphaloom.sources import sinks
from alphaloom.sources.versioned import VersionedTable

CODE, DATE = "ts_code", "trade_date"

FEATURES = "feature_id string, feature_name string, feature_type string, category string, description string, data_type string, update_frequency string, lookback_period int, grp string"
VERSIONS = "version_id string, factor_name string, version string, algorithm_hash string, parameters string, is_active boolean, created_at timestamp, grp string"
LINEAGE = "factor_name string, version_id string, row_count long, first_date date, last_date date, data_hash decimal(38,0), recorded_at timestamp"


def algorithm_hash(code: str, parameters: dict) -> str:
    """SHA-256 of the code and the parameters in key order."""
    return hashlib.sha256((code + json.dumps(parameters, sort_keys=True)).encode()).hexdigest()


def data_hash(df: DataFrame) -> DataFrame:
    """Order-free hash of a table: the sum of the row hashes."""
    return df.agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")).cast("decimal(38,0)").alias("data_hash"), F.count("*").alias("row_count"))


def next_versions(versions: DataFrame) -> DataFrame:
    """Next version number per factor: one above the largest leading number."""
    number = F.regexp_extract("version", r"^[0-9]+", 0).try_cast("int")
    return versions.groupBy("factor_name").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_version"))


def activated(versions: DataFrame, version_id: str) -> DataFrame:
    """Make one version the only active one of its factor."""
    factor = versions.where(F.col("version_id") == version_id).select(F.col("factor_name").alias("_f")).limit(1)
    joined = versions.join(F.broadcast(factor), F.col("factor_name") == F.col("_f"), "left")
    flag = F.when(F.col("_f").isNotNull(), F.col("version_id") == version_id).otherwise(F.col("is_active"))
    return joined.withColumn("is_active", flag).drop("_f")


def compare_versions(old: DataFrame, new: DataFrame, value: str = "factor_value") -> DataFrame:
    """Agreement of two versions on their common keys, one row."""
    a, b = F.col("a"), F.col("b")
    both = old.select(CODE, DATE, F.col(value).alias("a")).join(new.select(CODE, DATE, F.col(value).alias("b")), [CODE, DATE]).where(a.isNotNull() & b.isNotNull())
    d = F.abs(b - a)
    return both.agg(
        F.count("*").alias("common_records"),
        correlation(a, b).alias("correlation"),
        F.avg(d).alias("mean_abs_diff"),
        F.stddev_samp(d).alias("std_abs_diff"),
        F.max(d).alias("max_abs_diff"),
        F.avg(F.try_divide(d, F.abs(a))).alias("mean_relative_diff"),
        F.avg(a).alias("mean_1"),
        F.avg(b).alias("mean_2"),
        F.stddev_samp(a).alias("std_1"),
        F.stddev_samp(b).alias("std_2"),
    )


def feature_matrix(values: DataFrame, feature_ids: list[str], day=None, normalized: bool = False, codes: list | None = None) -> DataFrame:
    """Features as columns for one day, the newest by default."""
    rows = values.where(F.col("feature_id").isin(feature_ids))
    if codes is not None:
        rows = rows.where(F.col(CODE).isin(codes))
    if day is None:
        rows = rows.join(rows.agg(F.max(DATE).alias(DATE)), DATE, "left_semi")
    else:
        rows = rows.where(F.col(DATE) == F.lit(day).cast("date"))
    return rows.groupBy(CODE).pivot("feature_id", feature_ids).agg(F.first("normalized_value" if normalized else "value", ignorenulls=True))


def feature_statistics(values: DataFrame) -> DataFrame:
    """Count, moments and quartiles per feature and day."""
    keys = ["feature_id", DATE]
    base = values.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    quart = X.group_quantiles(values, keys, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(quart, keys)


class FeatureStore:
    """Registry and values under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self._path(name)
        return self.spark.read.schema(schema).parquet(path) if sinks.path_exists(self.spark, path) else self.spark.createDataFrame([], schema)

    # features
    def features(self, feature_type: str | None = None, category: str | None = None) -> DataFrame:
        out = self._table("features", FEATURES).drop("grp")
        if feature_type:
            out = out.where(F.col("feature_type") == feature_type)
        if category:
            out = out.where(F.col("category") == category)
        return out.orderBy("feature_id")

    def register_features(self, rows: DataFrame) -> int:
        """Add features that are not registered yet; existing ones stay as they are."""
        known = self._table("features", FEATURES).select("feature_id")
        fresh = rows.dropDuplicates(["feature_id"]).join(known, "feature_id", "left_anti")
        columns = [c.split()[0] for c in FEATURES.split(", ")][:-1]
        fresh = fresh.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("int" if c == "lookback_period" else "string").alias(c) for c in columns])
        fresh = fresh.withColumn("lookback_period", F.col("lookback_period").cast("int")).withColumn("grp", F.lit("all"))
        n = fresh.count()
        if n:
            sinks.append(fresh, self._path("features"))
        return n

    def update_features(self, rows: DataFrame) -> None:
        """Insert or update features by id."""
        full = rows.withColumn("grp", F.lit("all"))
        for c in [x.split()[0] for x in FEATURES.split(", ")]:
            if c not in full.columns:
                full = full.withColumn(c, F.lit(None).cast("int" if c == "lookback_period" else "string"))
        self._metadata().upsert(full, [c for c in rows.columns if c != "feature_id"])

    def _metadata(self) -> VersionedTable:
        return VersionedTable(self.spark, self._path("feature_metadata"), ["feature_id", "grp"], "grp")

    def feature_metadata(self) -> DataFrame:
        return self._metadata().read()

    # values
    def stored_values(self) -> VersionedTable:
        """Values of all features: a feature's day is replaced as a whole, months are folders."""
        return VersionedTable(self.spark, self._path("values"), ["feature_id", DATE, "month"], "month")

    def store_values(self, feature_id: str, data: DataFrame) -> None:
        """Store (code, day, value) with its per-date statistics, replacing the dates given.

        Only these dates are written; other days stay where they are.
        """
        fresh = P.date_statistics(data.select(CODE, DATE, "value"), "value").withColumn("feature_id", F.lit(feature_id)).withColumn("month", sinks.month_of())
        self.stored_values().write(fresh)

    def values(self, feature_id: str, codes: list | None = None, start=None, end=None, normalized: bool = False) -> DataFrame:
        out = self.stored_values().read().where(F.col("feature_id") == feature_id)
        if codes is not None:
            out = out.where(F.col(CODE).isin(codes))
        if start is not None:
            out = out.where((F.col("month") >= str(start)[:7]) & (F.col(DATE) >= F.lit(start).cast("date")))
        if end is not None:
            out = out.where((F.col("month") <= str(end)[:7]) & (F.col(DATE) <= F.lit(end).cast("date")))
        value = F.col("normalized_value" if normalized else "value").alias("value")
        return out.select(CODE, DATE, value).orderBy(F.desc(DATE), CODE)

    def matrix(self, feature_ids: list[str], day=None, normalized: bool = False, codes: list | None = None) -> DataFrame:
        return feature_matrix(self.stored_values().read(), feature_ids, day, normalized, codes)

    def statistics(self, feature_id: str) -> DataFrame:
        return feature_statistics(self.stored_values().read().where(F.col("feature_id") == feature_id))

    # versions
    def versions(self, factor: str | None = None) -> DataFrame:
        out = self._table("versions", VERSIONS).drop("grp")
        return (out.where(F.col("factor_name") == factor) if factor else out).orderBy("factor_name", F.desc("created_at"))

    def create_version(self, factor: str, code: str, parameters: dict, force: bool = False) -> str:
        """The version of this code and these parameters, made when it does not exist yet."""
        digest = algorithm_hash(code, parameters)
        mine = self.versions(factor)
        same = mine.where(F.col("algorithm_hash") == digest).select("version_id").limit(1).collect()
        if same and not force:
            return same[0][0]
        row = next_versions(mine).collect()  # at most one row
        number = row[0]["next_version"] if row else 1
        version_id = f"{factor}_v{number}"
        new = self.spark.createDataFrame(
            [(version_id, factor, str(number), digest, json.dumps(parameters, sort_keys=True), True)],
            "version_id string, factor_name string, version string, algorithm_hash string, parameters string, is_active boolean",
        ).withColumns({"created_at": F.current_timestamp(), "grp": F.lit("all")})
        self._write_versions(activated(self._table("versions", VERSIONS).unionByName(new), version_id))
        return version_id

    def _write_versions(self, rows: DataFrame) -> None:
        # The new content is cut loose from the folder it replaces.
        scratch_root(self.spark)
        sinks.replace_partitions(rows.checkpoint(), self._path("versions"), ["grp"])

    def activate_version(self, version_id: str) -> None:
        self._write_versions(activated(self._table("versions", VERSIONS), version_id))

    def latest_active(self, factor: str) -> str | None:
        w = W.partitionBy("factor_name").orderBy(F.desc(F.col("version").cast("int")))  # versions of one factor
        row = self.versions(factor).where("is_active").withColumn("i", F.row_number().over(w)).where("i = 1").select("version_id").collect()
        return row[0][0] if row else None

    def store_version_data(self, factor: str, version_id: str, data: DataFrame) -> None:
        """Store a version's values by month and record their lineage."""
        rows = data.select(CODE, DATE, "factor_value").withColumns({"version_id": F.lit(version_id), "month": sinks.month_of()})
        sinks.replace_partitions(rows, self._path("version_values"), ["version_id", "month"])
        self.record_lineage(factor, version_id, self.version_data(factor, version_id))

    def version_data(self, factor: str, version_id: str | None = None, start=None, end=None) -> DataFrame:
        version_id = version_id or self.latest_active(factor)
        out = self.spark.read.parquet(self._path("version_values")).where(F.col("version_id") == version_id)
        if start is not None:
            out = out.where(F.col(DATE) >= F.lit(start).cast("date"))
        if end is not None:
            out = out.where(F.col(DATE) <= F.lit(end).cast("date"))
        return out.select(CODE, DATE, "factor_value")

    def record_lineage(self, factor: str, version_id: str, data: DataFrame) -> None:
        row = data.agg(F.count("*").alias("row_count"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.sum(F.xxhash64(CODE, DATE, "factor_value").cast("decimal(20,0)")).cast("decimal(38,0)").alias("data_hash"))
        row = row.withColumns({"factor_name": F.lit(factor), "version_id": F.lit(version_id), "recorded_at": F.current_timestamp()})
        sinks.append(row.select(*[c.split()[0] for c in LINEAGE.split(", ")]), self._path("lineage"))

    def lineage(self, factor: str) -> DataFrame:
        rows = self._table("lineage", LINEAGE).where(F.col("factor_name") == factor)
        return rows.join(self.versions(factor).select("version_id", "version", "algorithm_hash", "is_active"), "version_id").orderBy(F.desc("recorded_at"))

    def calculate_and_store(self, names: dict, bars: DataFrame, code_of=inspect.getsource) -> dict[str, str]:
        """Compute factors, each under the version of its source text, and store them."""
        ids = {}
        for name, fn in names.items():
            ids[name] = self.create_version(name, code_of(fn), {"factor": name})
            values = fn(bars).select(CODE, DATE, F.col(name).alias("factor_value"))
            self.store_version_data(name, ids[name], values)
        return ids

    def migrate(self, legacy: DataFrame, factor: str, code_col: str, date_col: str, value_col: str) -> str:
        """Bring a legacy table into the store: rename, register, write."""
        version_id = self.create_version(factor, "legacy", {"source": "legacy"})
        rows = legacy.select(F.col(code_col).alias(CODE), F.col(date_col).cast("date").alias(DATE), F.col(value_col).cast("double").alias("factor_value"))
        self.store_version_data(factor, version_id, rows)
        return version_id
