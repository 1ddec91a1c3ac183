"""Sinks, feature store and incremental computation."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog.base import W, query, roll, view
from alphaloom.catalog.quality import rsi_versions
from alphaloom.catalog.selection import scores
from alphaloom.operators import incremental as I
from alphaloom.operators import store as S
from alphaloom.operators import technical as T
from alphaloom.session import scratch_path
from alphaloom.sources import sinks
from alphaloom.sources.tables import bars, calendar, monthly, panel, stock_basic, table
from alphaloom.sources.versioned import VersionedTable

C = '"close"'
FACTORS = ["mom", "rng"]


def long(spark, folder):
    rows = panel(spark, folder).unpivot(["ts_code", "trade_date"], FACTORS, "factor_name", "factor_value").where("factor_value IS NOT NULL")
    return rows.withColumn("month", sinks.month_of())


view("lf", " UNION ALL ".join(f"SELECT ts_code, trade_date, '{c}' AS factor_name, {c} AS factor_value, strftime(trade_date, '%Y-%m') AS month FROM panel WHERE {c} IS NOT NULL" for c in FACTORS), "panel")

# ---- sinks ----------------------------------------------------------------------------------


def _export(fmt):
    def run(spark, folder):
        rows = bars(spark, folder).select("ts_code", "trade_date", "close", "vol")
        path = sinks.export(rows, scratch_path(spark, f"export_{fmt}"), fmt)
        return sinks.read_export(spark, path, fmt, rows.schema)

    return run


for _f in sinks.FORMATS:
    query(f"export_{_f}", "ts_code trade_date", {"close": 7, "vol": 2}, 'SELECT ts_code, trade_date, "close", vol FROM bars')(_export(_f))


@query("export_verification", "format ok", "", "SELECT unnest(['csv', 'json']) AS format, true AS ok", ())
def export_verification(spark, folder):
    rows = table(spark, folder, "supplier")
    n = rows.count()
    done = [(fmt, sinks.verify_export(spark, sinks.export(rows, scratch_path(spark, "verify"), fmt), fmt, rows.schema, n)) for fmt in ("csv", "json")]
    return spark.createDataFrame(done, "format string, ok boolean")


@query(
    "score_history",
    "ts_code trade_date",
    {"score": 8},
    "SELECT ts_code, trade_date, score FROM scores WHERE trade_date BETWEEN DATE '1998-02-10' AND DATE '1998-04-20'",
    ("scores",),
)
def score_history(spark, folder):
    """Append scores by month and load a range of days; the month prunes folders."""
    path = scratch_path(spark, "scores")
    rows = scores(spark, folder).select("ts_code", "trade_date", "score").withColumn("month", sinks.month_of())
    sinks.append(rows.hint("rebalance", "month"), path, ["month"])
    stored = spark.read.schema(rows.schema).parquet(path).where(F.col("month").between("1998-02", "1998-04"))
    return stored.where(F.col("trade_date").between(F.lit("1998-02-10").cast("date"), F.lit("1998-04-20").cast("date")))


@query(
    "batched_append",
    "factor_name n",
    "",
    "SELECT factor_name, count(*) AS n FROM lf GROUP BY 1",
    ("lf",),
)
def batched_append(spark, folder):
    path = scratch_path(spark, "append")
    rows = long(spark, folder)
    for name in FACTORS:
        sinks.append(rows.where(F.col("factor_name") == name), path, ["factor_name"])
    return spark.read.parquet(path).groupBy("factor_name").agg(F.count("*").alias("n"))


@query(
    "upsert_factors",
    "ts_code trade_date month stamped",
    {"factor_value": 7},
    """SELECT ts_code, trade_date, month, factor_value * CASE WHEN trade_date >= DATE '1998-05-15' THEN 2 ELSE 1 END AS factor_value, true AS stamped FROM lf WHERE factor_name = 'mom'""",
    ("lf",),
)
def upsert_factors(spark, folder):
    """Store days up to June 1998, then upsert doubled values from mid-May on."""
    own = VersionedTable(spark, scratch_path(spark, "upsert"), ["ts_code", "trade_date", "month"], "month")
    rows = long(spark, folder).where("factor_name = 'mom'").select("ts_code", "trade_date", "month", "factor_value")
    own.upsert(rows.where(F.col("trade_date") < F.lit("1998-07-01").cast("date")))
    later = rows.where(F.col("trade_date") >= F.lit("1998-05-15").cast("date")).withColumn("factor_value", F.col("factor_value") * 2)
    own.upsert(later)
    return own.read().withColumn("stamped", F.col("updated_at").isNotNull())


@query(
    "replace_partitions",
    "factor_name month n",
    {"total": 4},
    """SELECT factor_name, month, count(*) AS n, sum(factor_value * CASE WHEN factor_name = 'mom' AND month >= '2000-01' THEN 10 ELSE 1 END) AS total FROM lf GROUP BY 1, 2""",
    ("lf",),
)
def replace_partitions(spark, folder):
    """Save twice, the second time only later months of one factor with new values."""
    path = scratch_path(spark, "replace")
    rows = long(spark, folder)
    sinks.replace_partitions(rows, path, ["factor_name", "month"])
    again = rows.where("factor_name = 'mom' AND month >= '2000-01'").withColumn("factor_value", F.col("factor_value") * 10)
    sinks.replace_partitions(again, path, ["factor_name", "month"])
    sinks.replace_partitions(again, path, ["factor_name", "month"])
    return spark.read.schema(rows.schema).parquet(path).groupBy("factor_name", "month").agg(F.count("*").alias("n"), F.sum("factor_value").alias("total"))


def _archived(spark, folder):
    path, target = scratch_path(spark, "live"), scratch_path(spark, "archive")
    rows = long(spark, folder)
    sinks.replace_partitions(rows, path, ["month"])
    log = sinks.archive(spark, path, target, "1997-01")
    return path, target, log, rows.schema


@query("archive_log", "month rows", "", "SELECT month, count(*) AS rows FROM lf WHERE month < '1997-01' GROUP BY 1", ("lf",))
def archive_log(spark, folder):
    return _archived(spark, folder)[2]


@query(
    "archive_restore_retention",
    "month n",
    "",
    "SELECT month, count(*) AS n FROM lf WHERE month = '1996-03' OR (month >= '1997-01') GROUP BY 1",
    ("lf",),
)
def archive_restore_retention(spark, folder):
    """Archive before 1997, restore two months, then keep months from March 1996 on."""
    path, target, _, schema = _archived(spark, folder)
    sinks.restore(spark, target, path, ["1996-02", "1996-03"])
    sinks.apply_retention(spark, path, "1996-03")
    return spark.read.schema(schema).parquet(path).groupBy("month").agg(F.count("*").alias("n"))


@query(
    "backup_before_recalculation",
    "ts_code factor_name n",
    "",
    "SELECT ts_code, factor_name, count(*) AS n FROM lf WHERE factor_name = 'mom' AND ts_code IN (1, 2, 3) AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1, 2",
    ("lf",),
)
def backup_before_recalculation(spark, folder):
    path = scratch_path(spark, "factors")
    sinks.replace_partitions(long(spark, folder), path, ["month"])
    saved = sinks.backup(spark, path, scratch_path(spark, "backup"), [1, 2, 3], ["mom"], "1997-01-01", "1997-12-31")
    return saved.groupBy("ts_code", "factor_name").agg(F.count("*").alias("n"))


# ---- feature store --------------------------------------------------------------------------


@query(
    "feature_registry",
    "feature_id feature_type category",
    "",
    "SELECT 'part_' || p_partkey AS feature_id, CASE WHEN p_size < 20 THEN 'technical' ELSE 'fundamental' END AS feature_type, p_brand AS category FROM part WHERE p_size < 20",
    (),
)
def feature_registry(spark, folder):
    store = S.FeatureStore(spark, scratch_path(spark, "store"))
    rows = table(spark, folder, "part").select(
        F.concat(F.lit("part_"), "p_partkey").alias("feature_id"),
        F.col("p_name").alias("feature_name"),
        F.when(F.col("p_size") < 20, "technical").otherwise("fundamental").alias("feature_type"),
        F.col("p_brand").alias("category"),
    )
    store.register_features(rows.where("feature_type = 'technical'"))
    store.register_features(rows.withColumn("category", F.when(F.col("feature_type") == "technical", "changed").otherwise(F.col("category"))))
    return store.features("technical")


@query(
    "factor_metadata_upsert",
    "feature_id category",
    "",
    "SELECT 'part_' || p_partkey AS feature_id, CASE WHEN p_size < 20 THEN 'small' ELSE p_brand END AS category FROM part",
    (),
)
def factor_metadata_upsert(spark, folder):
    store = S.FeatureStore(spark, scratch_path(spark, "store"))
    rows = table(spark, folder, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("feature_id"), F.col("p_brand").alias("category"), "p_size")
    store.update_features(rows.drop("p_size"))
    store.update_features(rows.where("p_size < 20").select("feature_id", F.lit("small").alias("category")))
    return store.feature_metadata()


def _values(spark, folder):
    """A store holding two features, one of them saved a second time for some days."""
    store = S.FeatureStore(spark, scratch_path(spark, "store"))
    p = panel(spark, folder)
    store.store_values("mom", p.select("ts_code", "trade_date", F.col("mom").alias("value")).where("value IS NOT NULL"))
    store.store_values("rng", p.select("ts_code", "trade_date", F.col("rng").alias("value")))
    late = p.where(F.col("trade_date") >= F.lit("2001-08-15").cast("date"))
    store.store_values("rng", late.select("ts_code", "trade_date", (F.col("rng") + 1).alias("value")))
    return store


_sv = "CASE WHEN trade_date >= DATE '2001-08-15' THEN rng + 1 ELSE rng END"
query(
    "feature_values",
    "ts_code trade_date",
    {"value": 7},
    f"SELECT ts_code, trade_date, {_sv} AS value FROM panel WHERE trade_date >= DATE '2001-01-01'",
    ("panel",),
)(lambda s, f: _values(s, f).values("rng", start="2001-01-01"))
query(
    "feature_values_normalized",
    "ts_code trade_date",
    "value",
    f"""SELECT ts_code, trade_date, CASE WHEN stddev_samp(x) OVER d > 0 THEN (x - avg(x) OVER d) / stddev_samp(x) OVER d ELSE 0 END AS value FROM (SELECT *, {_sv} AS x FROM panel)
        WINDOW d AS (PARTITION BY trade_date)""",
    ("panel",),
)(lambda s, f: _values(s, f).values("rng", normalized=True))
query(
    "feature_matrix",
    "ts_code",
    {"mom": 7, "rng": 7},
    "SELECT ts_code, mom, rng + 1 AS rng FROM panel WHERE trade_date = (SELECT max(trade_date) FROM panel)",
    ("panel",),
)(lambda s, f: _values(s, f).matrix(["mom", "rng"]))
query(
    "feature_statistics",
    "feature_id trade_date count",
    {c: 5 for c in ("mean", "std", "min", "max", "q25", "q50", "q75")},
    """SELECT 'mom' AS feature_id, trade_date, count(mom) AS count, avg(mom) AS mean, stddev_samp(mom) AS std, min(mom) AS min, max(mom) AS max, quantile_cont(mom, 0.25) AS q25,
              quantile_cont(mom, 0.5) AS q50, quantile_cont(mom, 0.75) AS q75 FROM panel WHERE mom IS NOT NULL GROUP BY 2""",
    ("panel",),
)(lambda s, f: _values(s, f).statistics("mom"))


def _versions(spark, folder):
    store = S.FeatureStore(spark, scratch_path(spark, "store"))
    old, new = rsi_versions(spark, folder)
    for n, rows in ((14, old), (13, new)):
        v = store.create_version("rsi", "rolling_mean_rsi", {"window": n})
        store.store_version_data("rsi", v, rows)
    store.create_version("rsi", "rolling_mean_rsi", {"window": 14})
    return store


query(
    "factor_versions",
    "version_id factor_name version is_active",
    "",
    "SELECT 'rsi_v1' AS version_id, 'rsi' AS factor_name, '1' AS version, true AS is_active WHERE (SELECT count(*) FROM bars) > 0 UNION ALL SELECT 'rsi_v2', 'rsi', '2', false",
)(lambda s, f: _activate(s, f))


def _activate(spark, folder):
    store = _versions(spark, folder)
    store.activate_version("rsi_v1")
    return store.versions("rsi")


query(
    "active_version_data",
    "ts_code trade_date",
    "factor_value",
    "SELECT ts_code, trade_date, new_value AS factor_value FROM recalc",
    ("recalc",),
)(lambda s, f: _versions(s, f).version_data("rsi"))
query(
    "version_lineage",
    "version_id version row_count first_date last_date",
    "",
    """SELECT v AS version_id, n AS version, row_count, first_date, last_date FROM (SELECT count(*) AS row_count, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars),
       (SELECT unnest(['rsi_v1', 'rsi_v2']) AS v, unnest(['1', '2']) AS n)""",
)(lambda s, f: _versions(s, f).lineage("rsi"))
query(
    "compare_versions",
    "common_records",
    {"correlation": 6, "mean_abs_diff": 5, "std_abs_diff": 5, "max_abs_diff": 5, "mean_relative_diff": 5, "mean_1": 5, "mean_2": 5, "std_1": 5, "std_2": 5},
    """SELECT count(*) AS common_records, corr(a, b) AS correlation, avg(abs(b - a)) AS mean_abs_diff, stddev_samp(abs(b - a)) AS std_abs_diff, max(abs(b - a)) AS max_abs_diff,
              avg(abs(b - a) / nullif(abs(a), 0)) AS mean_relative_diff, avg(a) AS mean_1, avg(b) AS mean_2, stddev_samp(a) AS std_1, stddev_samp(b) AS std_2
       FROM (SELECT old_value AS a, new_value AS b FROM recalc) WHERE a IS NOT NULL AND b IS NOT NULL""",
    ("recalc",),
)(lambda s, f: S.compare_versions(*rsi_versions(s, f)))


@query(
    "calculate_and_store",
    "version_id n",
    {"total": 2},
    f"""SELECT 'sma_5_v1' AS version_id, count(x) AS n, sum(x) AS total FROM (SELECT {roll('avg', C, 5)} AS x FROM bars)
        UNION ALL SELECT 'momentum_5_v1', count(x), sum(x) FROM (SELECT {C} - lag({C}, 5) OVER ({W}) AS x FROM bars)""",
)
def calculate_and_store(spark, folder):
    store = S.FeatureStore(spark, scratch_path(spark, "store"))
    b = bars(spark, folder)

    def sma_5(df):
        return T.sma(df, 5)

    def momentum_5(df):
        return T.momentum(df, 5)

    ids = store.calculate_and_store({"sma_5": sma_5, "momentum_5": momentum_5}, b)
    parts = [store.version_data(n, v).agg(F.lit(v).alias("version_id"), F.count("factor_value").alias("n"), F.sum("factor_value").alias("total")) for n, v in ids.items()]
    return parts[0].unionByName(parts[1])


@query("legacy_migration", "ts_code trade_date", {"factor_value": 8}, 'SELECT ts_code, trade_date, amount / vol AS factor_value FROM bars')
def legacy_migration(spark, folder):
    store = S.FeatureStore(spark, scratch_path(spark, "store"))
    legacy = bars(spark, folder).select(F.col("ts_code").alias("code"), F.col("trade_date").alias("day"), (F.col("amount") / F.col("vol")).alias("v"))
    return store.version_data("vwap", store.migrate(legacy, "vwap", "code", "day", "v"))


@query("table_hash", "row_count same", "", "SELECT count(*) AS row_count, true AS same FROM lineitem", ())
def table_hash(spark, folder):
    """The hash of a table does not depend on the order of its rows."""
    li = table(spark, folder, "lineitem")
    a = S.data_hash(li)
    b = S.data_hash(li.repartition(7, "l_partkey")).withColumnsRenamed({"data_hash": "h2", "row_count": "n2"})
    return a.crossJoin(F.broadcast(b)).select("row_count", (F.col("data_hash") == F.col("h2")).alias("same"))


# ---- incremental ------------------------------------------------------------------------------

CUT, AS_OF = "2001-06-30", "2001-09-30"
_day = "DATE '{}'"


def _state(spark, folder):
    """Stored values up to the cut, the listed codes and the calendar up to the run day."""
    values = long(spark, folder).where(F.col("trade_date") <= F.lit(CUT).cast("date"))
    codes = stock_basic(spark, folder).select("ts_code", F.when(F.col("acctbal") > 0, F.lit("2001-05-01").cast("date")).alias("list_date"))
    return values, codes, calendar(spark, folder)


view("stored", f"SELECT * FROM lf WHERE trade_date <= DATE '{CUT}'", "lf")
query(
    "last_calculation_dates",
    "ts_code factor_name last_date",
    "",
    "SELECT ts_code, factor_name, max(trade_date) AS last_date FROM stored GROUP BY 1, 2",
    ("stored",),
)(lambda s, f: I.last_dates(_state(s, f)[0]))
view(
    "starts",
    f"""SELECT c.ts_code, f.factor_name, coalesce(CAST(l.last_date + 1 AS DATE), CASE WHEN acctbal > 0 THEN DATE '2001-05-01' END, CAST(DATE '{AS_OF}' - 365 AS DATE)) AS start_date
        FROM basic c CROSS JOIN (SELECT unnest(['mom', 'rng', 'sma_5']) AS factor_name) f LEFT JOIN (SELECT ts_code, factor_name, max(trade_date) AS last_date FROM stored GROUP BY 1, 2) l USING (ts_code, factor_name)""",
    "basic",
    "stored",
)
view(
    "missing",
    f"""SELECT ts_code, factor_name, cal_date AS trade_date FROM starts JOIN calendar ON cal_date BETWEEN start_date AND DATE '{AS_OF}'
        WHERE (ts_code, factor_name, cal_date) NOT IN (SELECT ts_code, factor_name, trade_date FROM stored)""",
    "starts",
    "calendar",
)


def _missing(spark, folder, factors=("mom", "rng", "sma_5")):
    values, codes, days = _state(spark, folder)
    return I.missing_days(codes, list(factors), values, days, AS_OF)


query("missing_days", "ts_code factor_name trade_date", "", "SELECT * FROM missing", ("missing",))(_missing)
query(
    "lookback_scan",
    "ts_code trade_date",
    {"close": 8},
    f"""SELECT b.ts_code, b.trade_date, b."close" FROM bars b JOIN (SELECT ts_code, min(trade_date) AS first FROM missing GROUP BY 1) USING (ts_code) WHERE b.trade_date >= first - 40""",
    ("bars", "missing"),
)(lambda s, f: I.lookback_scan(monthly(s, f), _missing(s, f), 30))


def _computed(spark, folder):
    fns = {"sma_5": (lambda d: T.sma(d, 5), 400), "rsi_14": (lambda d: T.rsi(d, 14), 400)}
    values, codes, days = _state(spark, folder)
    known = T.sma(bars(spark, folder), 5).select("ts_code", "trade_date", F.lit("sma_5").alias("factor_name"), F.col("sma_5").alias("factor_value"))
    known = known.where((F.col("trade_date") <= F.lit(CUT).cast("date")) & F.col("factor_value").isNotNull())
    missing = I.missing_days(codes, list(fns), known, days, AS_OF)
    return I.compute_missing(monthly(spark, folder), missing, fns)


view(
    "sma_stored",
    f"SELECT ts_code, max(trade_date) AS last_date FROM (SELECT ts_code, trade_date, {roll('avg', C, 5)} AS v FROM bars) WHERE v IS NOT NULL AND trade_date <= DATE '{CUT}' GROUP BY 1",
    "bars",
)
view(
    "computed",
    f"""SELECT v.ts_code, v.trade_date, 'sma_5' AS factor_name, v.v AS factor_value FROM (SELECT ts_code, trade_date, {roll('avg', C, 5)} AS v FROM bars) v LEFT JOIN sma_stored s USING (ts_code) LEFT JOIN basic b USING (ts_code)
          WHERE v.v IS NOT NULL AND v.trade_date <= DATE '{AS_OF}' AND v.trade_date >= coalesce(CAST(s.last_date + 1 AS DATE), CASE WHEN acctbal > 0 THEN DATE '2001-05-01' END, DATE '{AS_OF}' - 365)
        UNION ALL SELECT r.ts_code, r.trade_date, 'rsi_14', r.old_value FROM recalc r LEFT JOIN basic b USING (ts_code)
          WHERE r.old_value IS NOT NULL AND r.trade_date <= DATE '{AS_OF}' AND r.trade_date >= coalesce(CASE WHEN acctbal > 0 THEN DATE '2001-05-01' END, CAST(DATE '{AS_OF}' - 365 AS DATE))""",
    "bars",
    "sma_stored",
    "basic",
    "recalc",
)
query("incremental_factors", "ts_code trade_date factor_name", {"factor_value": 7}, "SELECT * FROM computed", ("computed",))(_computed)
query(
    "run_log",
    "ts_code factor_name records calculation_date status",
    "",
    "SELECT ts_code, factor_name, count(*) AS records, max(trade_date) AS calculation_date, 'success' AS status FROM computed GROUP BY 1, 2",
    ("computed",),
)(lambda s, f: I.run_log(_computed(s, f)))
query(
    "calculation_history",
    "ts_code factor_name records calculation_date",
    "",
    "SELECT ts_code, factor_name, count(*) AS records, max(trade_date) AS calculation_date FROM computed GROUP BY 1, 2 ORDER BY calculation_date DESC, ts_code, factor_name LIMIT 15",
    ("computed",),
)(lambda s, f: I.calculation_history(I.run_log(_computed(s, f)), 15))
