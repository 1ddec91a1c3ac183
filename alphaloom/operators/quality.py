"""Data quality: outliers, filling, price checks, scores, rules and reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.frames import backward_fill, forward_fill, history
from alphaloom.functions.scalars import quality_status
from alphaloom.operators import crosssection as X

CODE, DATE = "ts_code", "trade_date"
PRICES = ("open", "high", "low", "close")


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0))


def flag_outliers(df: DataFrame, col: str, method: str = "iqr", by=CODE, out: str = "is_outlier") -> DataFrame:
    """Mark values outside the group's fences: iqr 1.5, zscore or 3sigma beyond three sd."""
    x = F.col(col)
    if method == "iqr":
        work = X.with_quantiles(df, by, col, {"_q1": 0.25, "_q3": 0.75})
        span = F.col("_q3") - F.col("_q1")
        flag = (x < F.col("_q1") - span * 1.5) | (x > F.col("_q3") + span * 1.5)
    elif method in ("zscore", "3sigma"):
        work = X.group_stats(df, by, _m=F.avg(col), _s=F.stddev_samp(col))
        flag = F.abs(x - F.col("_m")) > F.col("_s") * 3
    else:
        raise ValueError(f"unknown method {method}")
    return work.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_q1", "_q3", "_m", "_s")


def fill_missing(df: DataFrame, col: str, method: str = "forward", key: str = CODE) -> DataFrame:
    """Fill nulls along a security's days, by a mean or median, or by the cascade of last value,
    industry mean and overall mean."""
    w = history(key)
    if method == "forward":
        return df.withColumn(col, forward_fill(col, w))
    if method == "backward":
        return df.withColumn(col, backward_fill(col, w))
    if method == "mean":
        return X.group_stats(df, key, _f=F.avg(col)).withColumn(col, F.coalesce(col, "_f")).drop("_f")
    if method == "median":
        return X.with_quantiles(df, key, col, {"_f": 0.5}).withColumn(col, F.coalesce(col, "_f")).drop("_f")
    if method == "industry_mean":
        out = X.group_stats(df, "industry", _f=F.avg(col))
        overall = df.agg(F.avg(col).alias("_g"))  # one row
        out = out.crossJoin(F.broadcast(overall))
        known_industry = F.when(F.col("industry").isNotNull(), F.col("_f"))
        return out.withColumn(col, F.coalesce(forward_fill(col, w), known_industry, F.col("_g"))).drop("_f", "_g")
    raise ValueError(f"unknown method {method}")


def price_flags(df: DataFrame, change_limit: float = 0.2) -> DataFrame:
    """Add one flag per kind of price error."""
    o, h, lo, c = (F.col(x) for x in PRICES)
    broken = (h < o) | (h < c) | (h < lo) | (lo > o) | (lo > c)
    moved = F.abs(F.try_divide(c - F.col("pre_close"), F.col("pre_close")))
    no = F.lit(False)
    return df.withColumns(
        {
            "negative_prices": _sum([F.coalesce(F.col(x) < 0, no).cast("int") for x in PRICES]),
            "invalid_ohlc": F.coalesce(broken, no).cast("int"),
            "extreme_changes": F.coalesce(moved > change_limit, no).cast("int"),
            "zero_volume": F.coalesce(F.col("vol") == 0, no).cast("int"),
        }
    )


ERRORS = ("negative_prices", "invalid_ohlc", "extreme_changes", "zero_volume")


def price_errors(df: DataFrame) -> DataFrame:
    """One row per error found, with its kind."""
    kinds = F.array(*[F.when(F.col(e) > 0, F.struct(F.lit(e).alias("error"), F.col(e).cast("long").alias("hits"))) for e in ERRORS])
    return price_flags(df).select(CODE, DATE, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select(CODE, DATE, "k.*")


def clean_prices(df: DataFrame, key: str = CODE) -> DataFrame:
    """Carry prices over gaps, fill volume and amount by the median, and replace price outliers
    by the last value that is none."""
    w = history(key)
    cols = [c for c in (*PRICES, "pre_close") if c in df.columns]
    filled = [c for c in ("vol", "amount") if c in df.columns]
    df = df.withColumns({c: forward_fill(c, w) for c in cols})
    # One grouping per security finds the medians and the fences of every column.
    wanted = {c: {f"_med_{c}": 0.5} for c in filled} | {c: {f"_q1_{c}": 0.25, f"_q3_{c}": 0.75} for c in cols}
    df = X.with_all_quantiles(df, key, wanted).withColumns({c: F.coalesce(c, f"_med_{c}") for c in filled})

    def kept(c):
        q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
        return F.when((F.col(c) >= q1 - (q3 - q1) * 1.5) & (F.col(c) <= q3 + (q3 - q1) * 1.5), F.col(c))

    df = df.withColumns({c: kept(c) for c in cols}).drop(*[n for names in wanted.values() for n in names])
    return df.withColumns({c: forward_fill(c, w) for c in cols})


def quality_score(df: DataFrame, by: str = CODE, numeric=(*PRICES, "vol", "amount", "pre_close")) -> DataFrame:
    """Completeness, consistency, accuracy, timeliness and their mean, one row per security."""
    columns = df.columns
    fences = df.groupBy(by).agg(
        *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_q_{c}") for c in numeric]
    )
    flagged = price_flags(df).join(fences, by)
    gap = F.datediff(DATE, F.lag(DATE).over(history(by)))
    flagged = flagged.withColumn("_gap", gap)

    def outside(c):
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        return F.coalesce((F.col(c) < q1 - (q3 - q1) * 1.5) | (F.col(c) > q3 + (q3 - q1) * 1.5), F.lit(False)).cast("int")

    rows = F.count("*")
    zero = F.lit(0.0)
    out = flagged.groupBy(by).agg(
        rows.alias("data_count"),
        F.greatest(zero, F.lit(1.0) - F.sum(_sum([F.col(c).isNull().cast("int") for c in columns])) / (rows * len(columns))).alias("completeness"),
        F.greatest(zero, F.lit(1.0) - F.sum(_sum([F.col(e) for e in ERRORS])) / rows).alias("consistency"),
        F.greatest(zero, F.lit(1.0) - F.sum(_sum([outside(c) for c in numeric])) / (rows * len(numeric))).alias("accuracy"),
        F.coalesce(F.try_divide(F.count_if(F.col("_gap").between(1, 3)), F.count("_gap")), F.lit(1.0)).alias("timeliness"),
    )
    parts = ("completeness", "consistency", "accuracy", "timeliness")
    return out.withColumn("overall_score", _sum([F.col(p) for p in parts]) / len(parts))


# The lowest score of each figure that passes.
LIMITS = {"completeness": 0.95, "consistency": 0.98, "accuracy": 0.90, "timeliness": 0.85, "overall_score": 0.90}


def check_recent(df: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Scores of every security over its last ``days`` days with the figures below their limits."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    scores = quality_score(df.where((F.col(DATE) >= since) & (F.col(DATE) <= F.lit(as_of).cast("date"))))
    low = F.filter(F.array(*[F.when(F.col(k) < v, F.lit(k)) for k, v in LIMITS.items()]), lambda x: x.isNotNull())
    return scores.withColumn("alerts", low).withColumn("status", F.when(F.size("alerts") == 0, "PASS").otherwise("ALERT"))


def sample_codes(df: DataFrame, n: int, seed: int = 42, key: str = CODE) -> DataFrame:
    """A random sample of securities, the same for the same seed."""
    return df.select(key).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


# ---- rules ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A check of one table; ``check`` is null, range, outlier, freshness or duplicate."""

    id: str
    check: str
    dimension: str
    column: str | None = None
    threshold: float | None = None
    severity: str = "warning"
    enabled: bool = True
    params: dict = field(default_factory=dict)


def default_rules(time_column: str = DATE) -> list[Rule]:
    """The five standard checks of a bar table."""
    # Names and thresholds of the standard rules.
    return [
        Rule("stock_data_completeness", "null", "completeness", "close", 0.05),
        Rule("price_range_check", "range", "accuracy", "close", None, "error", True, {"min": 0.01, "max": 10000}),
        Rule("volume_outlier_check", "outlier", "accuracy", "vol", None, "warning", True, {"method": "zscore", "threshold": 3}),
        Rule("data_freshness_check", "freshness", "timeliness", time_column, 24, "critical", True, {"unit": "hours"}),
        Rule("duplicate_check", "duplicate", "uniqueness", None, 0.01, "warning", True, {"keys": [CODE, DATE]}),
    ]


def run_rules(df: DataFrame, rules: list[Rule], as_of) -> DataFrame:
    """Results of every enabled rule on one table.

    A first aggregate takes counts and moments of all rules together, a second one counts values
    outside the fences they define. Interquartile fences come from exact quantiles.
    """
    rules = [r for r in rules if r.enabled]
    now = F.lit(as_of).cast("timestamp_ntz")
    first, second, rows = [F.count("*").alias("_n")], [], []
    fences: dict[str, DataFrame] = {}
    for r in rules:
        c = F.col(r.column) if r.column else None
        k = r.id
        if r.check == "null":
            first.append(F.count_if(c.isNull()).alias(f"{k}_bad"))
        elif r.check == "range":
            ok = F.lit(True)
            if r.params.get("min") is not None:
                ok = ok & (c >= r.params["min"])
            if r.params.get("max") is not None:
                ok = ok & (c <= r.params["max"])
            first += [F.count(c).alias(f"{k}_known"), F.count_if(c.isNotNull() & ok).alias(f"{k}_ok")]
        elif r.check == "outlier":
            first += [F.count(c).alias(f"{k}_known"), F.avg(c).alias(f"{k}_m"), F.stddev_pop(c).alias(f"{k}_s")]
            if r.params.get("method", "zscore") == "zscore":
                beyond = F.abs(c - F.col(f"{k}_m")) > F.col(f"{k}_s") * r.params.get("threshold", 3)
            else:
                fences[k] = X.group_quantiles(df.withColumn("_all", F.lit(1)), "_all", r.column, {f"{k}_q1": 0.25, f"{k}_q3": 0.75}).drop("_all")
                span = F.col(f"{k}_q3") - F.col(f"{k}_q1")
                beyond = (c < F.col(f"{k}_q1") - span * 1.5) | (c > F.col(f"{k}_q3") + span * 1.5)
            second.append(F.count_if(F.coalesce(beyond, F.lit(False))).alias(f"{k}_bad"))
        elif r.check == "freshness":
            first.append(F.max(c.cast("timestamp_ntz")).alias(f"{k}_last"))
        elif r.check == "duplicate":
            first.append(F.count_distinct(F.struct(*r.params["keys"])).alias(f"{k}_kinds"))
        else:
            raise ValueError(f"unknown check {r.check}")
    stats = df.agg(*first)
    for f in fences.values():
        stats = stats.crossJoin(F.broadcast(f))  # one row each
    if second:
        needed = sorted({r.column for r in rules if r.check == "outlier"})
        counted = df.select(*needed).crossJoin(F.broadcast(stats)).agg(*second)
        stats = stats.crossJoin(F.broadcast(counted))
    n = F.col("_n")
    for r in rules:
        k = r.id
        hundred, zero = F.lit(100.0), F.lit(0.0)
        if r.check == "null":
            limit = r.threshold or 0.05
            value = F.try_divide(F.col(f"{k}_bad"), n)
            passed, score = value <= limit, hundred * (F.lit(1.0) - value / limit)
        elif r.check == "range":
            value = F.try_divide(F.col(f"{k}_ok"), F.col(f"{k}_known"))
            passed, score = value >= 0.95, hundred * value
        elif r.check == "outlier":
            value = F.try_divide(F.col(f"{k}_bad"), F.col(f"{k}_known"))
            few = F.col(f"{k}_known") < 10
            passed, score = few | (value <= 0.05), F.when(few, hundred).otherwise(hundred * (F.lit(1.0) - value / 0.05))
        elif r.check == "freshness":
            unit = {"minutes": 1 / 60, "hours": 1, "days": 24}[r.params.get("unit", "hours")]
            limit = (r.threshold or 24) * unit
            value = F.timestamp_diff("SECOND", F.col(f"{k}_last"), now) / 3600.0
            passed, score = value <= limit, hundred * (F.lit(1.0) - value / (limit * 2))
        else:
            limit = r.threshold or 0.01
            value = F.try_divide(n - F.col(f"{k}_kinds"), n)
            passed, score = value <= limit, hundred * (F.lit(1.0) - value / limit)
        score = F.coalesce(F.greatest(zero, F.least(hundred, score)), zero)
        rows.append(
            F.struct(
                F.lit(r.id).alias("rule_id"),
                F.lit(r.dimension).alias("dimension"),
                F.lit(r.check).alias("check_type"),
                F.lit(r.severity).alias("rule_severity"),
                value.cast("double").alias("value"),
                F.coalesce(passed, F.lit(False)).alias("passed"),
                score.cast("double").alias("score"),
            )
        )
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def issue_severity(score: str = "score") -> Column:
    return F.when(F.col(score) < 50, "critical").when(F.col(score) < 80, "error").otherwise("warning")


def rule_report(results: DataFrame) -> DataFrame:
    """Mean score per dimension, mean of those, and counts of checks and issues; one row."""
    by_dim = results.groupBy("dimension").agg(
        F.avg("score").alias("s"),
        F.count("*").alias("n"),
        F.count_if("passed").alias("ok"),
        *[F.count_if(~F.col("passed") & (issue_severity() == v)).alias(v) for v in ("critical", "error", "warning")],
    )
    return by_dim.agg(
        F.avg("s").alias("overall_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "s")))).alias("dimension_scores"),  # one entry per dimension
        F.sum("n").alias("total_checks"),
        F.sum("ok").alias("passed_checks"),
        *[F.sum(v).alias(f"{v}_issues") for v in ("critical", "error", "warning")],
    )


def quality_alerts(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed")).select("rule_id", "dimension", "check_type", "score", issue_severity().alias("severity"), F.lit("active").alias("status"))


def quality_history(reports: DataFrame, as_of, table: str | None = None, days: int = 7) -> DataFrame:
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    out = reports.where(F.col("report_date") >= since)
    return (out.where(F.col("table_name") == table) if table else out).orderBy(F.desc("report_date"))


def robust_anomalies(df: DataFrame, cols: list[str], by="_all", limit: float = 6.0) -> DataFrame:
    """Anomaly score per row: the largest robust z of its columns inside the group."""
    work = df.withColumn("_all", F.lit(1)) if by == "_all" else df
    work = X.with_all_median_mad(work, by, {c: (f"_med_{c}", f"_mad_{c}") for c in cols})
    zs = [F.coalesce(F.try_divide(F.abs(F.col(c) - F.col(f"_med_{c}")), F.col(f"_mad_{c}")), F.lit(0.0)) for c in cols]
    score = F.greatest(*zs) if len(zs) > 1 else zs[0]
    out = work.withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("anomaly_score") > limit)
    return out.drop("_all", *[f"_{k}_{c}" for c in cols for k in ("med", "mad")])


def validate_batch(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Completeness, anomalies and date consistency of one batch, one row."""
    judged = robust_anomalies(df, numeric)
    out = judged.agg(
        F.count("*").alias("rows"),
        (F.sum(_sum([F.col(c).isNull().cast("int") for c in df.columns])) / (F.count("*") * len(df.columns))).alias("null_ratio"),
        F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_ratio"),
        (F.count_distinct(CODE, DATE) == F.count("*")).alias("dates_unique"),
    )
    completeness = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("null_ratio") * 100)
    anomaly = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("anomaly_ratio") * 100)
    consistency = F.when(F.col("dates_unique"), 100.0).otherwise(50.0)
    return out.withColumn("overall_score", (completeness + anomaly + consistency) / 3)


# ---- validators -------------------------------------------------------------------------------


def validate_frame(df: DataFrame) -> DataFrame:
    """Rows, duplicates, nulls per column and the tier of the missing share, one row."""
    cols = df.columns
    distinct = df.groupBy(*cols).agg(F.count("*").alias("_c")).agg(F.sum("_c").alias("row_count"), (F.sum("_c") - F.count("*")).alias("duplicate_rows"))
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])
    out = distinct.crossJoin(F.broadcast(nulls))  # single rows
    ratio = F.try_divide(_sum([F.col(f"null_{c}") for c in cols]), F.col("row_count") * len(cols))
    return out.withColumn("missing_ratio", ratio).withColumn("missing_tier", F.when(ratio > 0.5, "severe").when(ratio > 0.1, "warning").otherwise("ok"))


def validate_bars(df: DataFrame, required=(CODE, DATE, *PRICES, "vol")) -> DataFrame:
    """Counts of each kind of problem per security."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    w = history()
    o, h, lo, c = (F.col(x) for x in PRICES)
    no = F.lit(False)
    work = df.withColumns({f"_m_{x}": F.abs(F.try_divide(F.col(x), F.lag(x).over(w)) - 1) for x in PRICES})
    return work.groupBy(CODE).agg(
        *[F.count_if(F.coalesce(F.col(x) < 0, no)).alias(f"negative_{x}") for x in PRICES],
        *[F.count_if(F.coalesce(F.col(f"_m_{x}") > 0.5, no)).alias(f"extreme_{x}") for x in PRICES],
        F.count_if(F.coalesce((h < o) | (h < c) | (h < lo), no)).alias("high_errors"),
        F.count_if(F.coalesce((lo > o) | (lo > c) | (lo > h), no)).alias("low_errors"),
        F.count_if(F.coalesce(F.col("vol") < 0, no)).alias("negative_vol"),
        (F.count(DATE) - F.count_distinct(DATE)).alias("duplicate_dates"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
    )


def validate_factors(df: DataFrame, factors: list[str]) -> DataFrame:
    """Infinities, outlier share and distribution per factor."""
    long = df.select(*factors).unpivot([], factors, "factor_name", "x").where(F.col("x").isNotNull())
    inf = F.abs("x") == float("inf")
    marked = flag_outliers(long, "x", "iqr", "factor_name", "_o")
    return marked.groupBy("factor_name").agg(
        F.count("*").alias("n"),
        F.count_if(inf).alias("infinite"),
        F.count_if("_o").alias("outliers"),
        (F.avg(F.col("_o").cast("double")) > 0.1).alias("many_outliers"),
        F.round(F.avg("x"), 4).alias("mean"),
        F.round(F.stddev_samp("x"), 4).alias("std"),
        F.round(F.min("x"), 4).alias("min"),
        F.round(F.max("x"), 4).alias("max"),
    )


# Allowed ranges of financial figures and factors.
FINANCIAL_RANGES = {"roe": (-1, 1), "roa": (-1, 1), "debt_to_assets": (0, 10), "current_ratio": (0, 100), "quick_ratio": (0, 100)}
FACTOR_RANGES = {
    "rsi": (0, 100),
    "bollinger_position": (0, 1),
    "volatility": (0, None),
    "volume_ratio": (0, None),
    "pe_ratio": (0, 1000),
    "pb_ratio": (0, 100),
    "roe": (-1, 1),
    "debt_ratio": (0, 10),
    "revenue_growth": (-1, 10),
}


def range_violations(df: DataFrame, ranges: dict) -> DataFrame:
    """Values below and above the allowed range per column that is present."""
    cells = []
    for c, (lo, hi) in ranges.items():
        if c in df.columns:
            x = F.col(c)
            cells.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(x).alias("n"),
                    (F.count_if(F.coalesce(x < lo, F.lit(False))) if lo is not None else F.lit(0).cast("long")).alias("below"),
                    (F.count_if(F.coalesce(x > hi, F.lit(False))) if hi is not None else F.lit(0).cast("long")).alias("above"),
                )
            )
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def factor_concentration(df: DataFrame, factors: list[str]) -> DataFrame:
    """Share of distinct values and of values beyond three sd per factor, with both warnings."""
    long = df.select(*factors).unpivot([], factors, "factor_name", "x").where(F.col("x").isNotNull())
    counted = long.groupBy("factor_name", "x").agg(F.count("*").alias("c"))
    work = X.group_stats(long, "factor_name", _m=F.avg("x"), _s=F.stddev_samp("x"))
    extreme = work.groupBy("factor_name").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("x") - F.col("_m")) > F.col("_s") * 3).alias("extreme"))
    kinds = counted.groupBy("factor_name").agg(F.count("*").alias("distinct_values"))
    return extreme.join(kinds, "factor_name").select(
        "factor_name",
        "n",
        "distinct_values",
        "extreme",
        (F.col("distinct_values") / F.col("n") < 0.1).alias("few_distinct"),
        (F.col("extreme") > F.col("n") * 0.05).alias("many_extreme"),
    )


def table_check(df: DataFrame, keys: list[str], not_null: list[str], day: str = DATE) -> DataFrame:
    """Daily record counts, score and status of a table; nulls and duplicates cost up to 50 each."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in not_null])
    per_key = df.groupBy(day, *[k for k in keys if k != day]).agg(F.count("*").alias("c"), F.count_if(bad).alias("b"))
    out = per_key.groupBy(day).agg(
        F.sum("c").alias("total_records"), F.sum("b").alias("null_records"), (F.sum("c") - F.count("*")).alias("duplicate_records")
    )
    score = F.lit(100.0) - F.col("null_records") / F.col("total_records") * 50 - F.col("duplicate_records") / F.col("total_records") * 50
    return out.withColumn("quality_score", score).withColumn("status", quality_status("quality_score"))


# ---- recalculation ----------------------------------------------------------------------------

# Relative change that counts as significant.
CHANGE_LIMITS = {"rsi_14": 0.05, "pe_ttm": 0.2}
VALUE_RANGES = {"rsi_14": (0, 100), "pe_ttm": (-100, 1000), "pb": (0, 50), "roe": (-100, 100)}


def compare_recalculation(old: DataFrame, new: DataFrame, keys=("factor_name", CODE, DATE)) -> DataFrame:
    """Old against new factor values with difference and significance."""
    k = list(keys)
    joined = old.select(*k, F.col("factor_value").alias("old_value")).join(
        new.select(*k, F.col("factor_value").alias("new_value")), k, "full_outer"
    )
    diff = F.col("new_value") - F.col("old_value")
    limit = F.lit(0.1)
    for name, value in CHANGE_LIMITS.items():
        limit = F.when(F.col("factor_name") == name, value).otherwise(limit)
    pct = F.abs(F.try_divide(diff, F.col("old_value")))
    return joined.withColumns({"difference": diff, "pct_change": pct, "is_significant": F.coalesce(pct > limit, F.lit(False))})


def recalculation_status(comparisons: DataFrame, new: DataFrame, null_tolerance: float = 0.05) -> DataFrame:
    """Score and status per factor and security."""
    keys = ["factor_name", CODE]
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (a, b) in VALUE_RANGES.items():
        lo = F.when(F.col("factor_name") == name, float(a)).otherwise(lo)
        hi = F.when(F.col("factor_name") == name, float(b)).otherwise(hi)
    x = F.col("factor_value")
    checked = new.withColumn("_out", F.coalesce((x < lo) | (x > hi), F.lit(False))).groupBy(*keys).agg(
        F.count("*").alias("total_records"), F.count_if(x.isNull()).alias("null_count"), F.count_if("_out").alias("outlier_count")
    )
    null_pct = F.col("null_count") / F.col("total_records") * 100
    score = (
        F.lit(100.0)
        - F.when(null_pct > null_tolerance * 100, F.least(F.lit(50.0), null_pct)).otherwise(0.0)
        - F.when(F.col("outlier_count") > 0, F.least(F.lit(30.0), F.col("outlier_count") / F.col("total_records") * 100)).otherwise(0.0)
    )
    checked = checked.withColumn("quality_score", F.greatest(F.lit(0.0), score))
    changed = comparisons.groupBy(*keys).agg(F.avg(F.col("is_significant").cast("double")).alias("significant_ratio"))
    status = F.when(F.col("quality_score") < 60, "FAILED").when(F.col("significant_ratio") > 0.1, "WARNING").otherwise("PASSED")
    return checked.join(changed, keys, "left").withColumn("validation_status", status)


def recalculation_summary(status: DataFrame) -> DataFrame:
    s = F.col("validation_status")
    return status.groupBy("factor_name").agg(
        F.count("*").alias("total_validations"),
        F.count_if(s == "PASSED").alias("passed_count"),
        F.count_if(s == "WARNING").alias("warning_count"),
        F.count_if(s == "FAILED").alias("failed_count"),
    )


def version_quality(df: DataFrame, by=("factor_name", "version_id"), value: str = "factor_value") -> DataFrame:
    """Completeness, three-sigma accuracy and uniqueness of a factor version; mean of six scores,
    the other three fixed at 100."""
    keys = list(by)
    work = X.group_stats(df, keys, _m=F.avg(value), _s=F.stddev_samp(value))
    x = F.col(value)
    inside = (x >= F.col("_m") - F.col("_s") * 3) & (x <= F.col("_m") + F.col("_s") * 3)
    cells = work.groupBy(*keys, CODE, DATE).agg(
        F.count("*").alias("c"), F.count(x).alias("k"), F.count_if(F.coalesce(inside, F.lit(False))).alias("i"), F.max("_s").alias("s")
    )
    out = cells.groupBy(*keys).agg(
        F.sum("c").alias("total_records"), F.sum("k").alias("_k"), F.sum("i").alias("_i"), F.count("*").alias("_u"), F.max("s").alias("_s")
    )
    total = F.col("total_records")
    out = out.withColumns(
        {
            "completeness_score": F.col("_k") / total * 100,
            "accuracy_score": F.when(F.col("_k") == 0, 0.0).when(F.col("_s") > 0, F.col("_i") / F.col("_k") * 100).otherwise(100.0),
            "uniqueness_score": F.col("_u") / total * 100,
        }
    )
    overall = (F.col("completeness_score") + F.col("accuracy_score") + F.col("uniqueness_score") + 300) / 6
    return out.withColumn("overall_score", overall).drop("_k", "_i", "_u", "_s")


def quality_trend(metrics: DataFrame) -> DataFrame:
    """Change of the score against the report before, per source and type; one row per day."""
    w = W.partitionBy("data_source", "data_type").orderBy("report_date")
    before = F.lag("overall_score").over(w)
    return metrics.withColumns({"prev_score": before, "score_change": F.col("overall_score") - before})
