"""Predictive value of factors: information coefficients, layers, decay and correlation.

Inputs are long: one row per (factor_name, ts_code, trade_date) with ``factor_value``, joined to
returns. Everything is keyed by factor, so many factors share one plan. Tables after the first
aggregation hold one row per factor and day, which the calendar bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.frames import full_frame
from alphaloom.functions.scalars import grade_by_score
from alphaloom.functions.stats import correlation, correlation_p_value, f_p_value, sample_kurtosis, sample_skew, student_t_quantile
from alphaloom.operators import crosssection as X
from alphaloom.session import brief_shuffles, cut, stored, stored_in_turns

FACTOR, CODE, DATE = "factor_name", "ts_code", "trade_date"


def trailing_return(bars: DataFrame, period: int, out: str = "return_rate") -> DataFrame:
    """Return over the last ``period`` rows, null unless the earlier close is positive."""
    before = F.lag("close", period).over(W.partitionBy(CODE).orderBy(DATE))
    return bars.select(CODE, DATE, F.when(before > 0, (F.col("close") - before) / before).alias(out))


def to_long(df: DataFrame, factors: list[str]) -> DataFrame:
    """Wide factor columns to one row per factor, nulls dropped."""
    ids = [c for c in df.columns if c not in factors]
    return df.unpivot(ids, factors, FACTOR, "factor_value").where(F.col("factor_value").isNotNull())


def information_coefficients(pairs: DataFrame, value: str = "factor_value", ret: str = "return_rate", by=(FACTOR, DATE), min_pairs: int = 10, hot: bool | None = None) -> DataFrame:
    """Pearson and Spearman correlation per group with at least ``min_pairs`` complete pairs.

    ``hot`` says whether a group is too large for a task; without it, groups are counted.
    """
    keys = list(by)
    complete = pairs.where(F.col(value).isNotNull() & F.col(ret).isNotNull()).select(*keys, value, ret)
    hot = X.has_hot_group(complete, keys) if hot is None else hot
    ranked = X.with_all_positions(complete, [(keys, value, "_v"), (keys, ret, "_w")], hot)
    ranked = ranked.withColumns({"_rv": X.average_rank("_v"), "_rr": X.average_rank("_w")})
    out = ranked.groupBy(*keys).agg(
        F.round(correlation(value, ret), 12).alias("ic_pearson"),  # an exact zero must not turn into noise
        F.round(correlation("_rv", "_rr"), 12).alias("ic_spearman"),
        F.count("*").alias("sample_size"),
        F.avg(value).alias("factor_mean"),
        F.stddev_samp(value).alias("factor_std"),
        F.avg(ret).alias("return_mean"),
        F.stddev_samp(ret).alias("return_std"),
    )
    return out.where(F.col("sample_size") >= min_pairs)


def with_p_values(ic: DataFrame) -> DataFrame:
    """Two-sided p-values of both coefficients; input is one row per factor and day."""
    return ic.withColumns(
        {f"p_value_{k}": correlation_p_value(F.col(f"ic_{k}"), F.col("sample_size").cast("double")) for k in ("pearson", "spearman")}
    )


def ic_statistics(ic: DataFrame) -> DataFrame:
    """Long table of statistics per factor and kind of coefficient."""
    kinds = ("pearson", "spearman")
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"ic_{k}").alias("ic"), F.col(f"p_value_{k}").alias("p")) for k in kinds])
    long = ic.select(FACTOR, F.explode(rows).alias("r")).select(FACTOR, "r.*")
    return long.groupBy(FACTOR, "kind").agg(
        F.avg("ic").alias("mean"),
        F.stddev_samp("ic").alias("std"),
        F.avg(F.abs("ic")).alias("abs_mean"),
        F.try_divide(F.count_if(F.col("ic") > 0), F.count("ic")).alias("positive_ratio"),
        F.try_divide(F.count_if(F.col("p") < 0.05), F.count("*")).alias("significant_ratio"),
        F.max("ic").alias("max"),
        F.min("ic").alias("min"),
        sample_skew("ic").alias("skewness"),
        sample_kurtosis("ic").alias("kurtosis"),
        F.count("ic").alias("periods"),
    )


def ic_coverage(ic: DataFrame) -> DataFrame:
    return ic.groupBy(FACTOR).agg(F.count("*").alias("total_periods"), F.avg("sample_size").alias("avg_sample_size"), F.min("sample_size").alias("min_sample_size"), F.max("sample_size").alias("max_sample_size"))


def information_ratio(ic: DataFrame, ic_col: str = "ic_pearson", window: int = 20) -> DataFrame:
    """Rolling mean, spread, ratio, cumulative coefficient, t statistic and interval."""
    w = W.partitionBy(FACTOR).orderBy(DATE)  # one row per day
    t = student_t_quantile(0.975, window - 1) / math.sqrt(window)
    out = ic.select(FACTOR, DATE, F.col(ic_col).alias("ic"))
    out = out.withColumns(
        {
            "ic_mean": full_frame(F.avg, "ic", window, w),
            "ic_std": full_frame(F.stddev_samp, "ic", window, w),
            "ic_cumsum": F.when(F.col("ic").isNotNull(), F.sum("ic").over(w.rowsBetween(W.unboundedPreceding, 0))),
        }
    )
    ir = F.try_divide(F.col("ic_mean"), F.col("ic_std"))
    return out.withColumns(
        {"ir": ir, "ic_t_stat": ir * math.sqrt(window), "ir_ci_lower": ir - t, "ir_ci_upper": ir + t}
    )


def ir_statistics(ir: DataFrame) -> DataFrame:
    size = F.avg(F.abs("ir"))
    return ir.groupBy(FACTOR).agg(
        F.avg("ir").alias("ir_mean"),
        F.stddev_samp("ir").alias("ir_std"),
        F.max("ir").alias("ir_max"),
        F.min("ir").alias("ir_min"),
        F.try_divide(F.count_if(F.col("ir") > 0), F.count("ir")).alias("ir_positive_ratio"),
        F.try_divide(F.count_if(F.abs("ir") > 1.96), F.count("ir")).alias("ir_significant_ratio"),
        F.when(size > 0, F.lit(1.0) - F.stddev_samp("ir") / size).otherwise(0.0).alias("ir_stability"),
        F.max_by("ir", F.when(F.col("ir").isNotNull(), F.col(DATE))).alias("final_ir"),
        F.max_by("ic_cumsum", F.when(F.col("ic_cumsum").isNotNull(), F.col(DATE))).alias("ic_cumsum_final"),
        F.max("ic_cumsum").alias("ic_cumsum_max"),
        F.min("ic_cumsum").alias("ic_cumsum_min"),
    )


def layered_returns(pairs: DataFrame, layers: int = 10, value: str = "factor_value", ret: str = "return_rate", hot: bool | None = None) -> DataFrame:
    """Return statistics per factor, day and equal-frequency layer; thin days are left out.

    ``hot`` says whether a day is too large for a task; without it, days are counted.
    """
    keys = [FACTOR, DATE]
    complete = pairs.where(F.col(value).isNotNull() & F.col(ret).isNotNull()).select(*keys, value, ret)
    hot = X.has_hot_group(complete, keys) if hot is None else hot
    bucketed = X.bucket_by_edges(complete, keys, value, layers, "factor_quantile", hot, min_rows=2 * layers)
    cells = [*keys, "factor_quantile"]
    moments = [F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("std"), F.count(ret).alias("count")]
    if not hot:
        return bucketed.groupBy(*cells).agg(*moments, F.percentile(ret, 0.5).alias("median"))
    return bucketed.groupBy(*cells).agg(*moments).join(X.group_quantiles(bucketed, cells, ret, {"median": 0.5}, hot), cells)


def layer_performance(layered: DataFrame) -> DataFrame:
    return layered.groupBy(FACTOR, "factor_quantile").agg(
        F.round(F.avg("mean"), 6).alias("avg_return"),
        F.round(F.stddev_samp("mean"), 6).alias("return_volatility"),
        F.round(F.avg("count"), 6).alias("avg_stock_count"),
    )


def long_short(performance: DataFrame) -> DataFrame:
    """Top against bottom layer, and monotonicity of returns over layers."""
    w = W.partitionBy(FACTOR)  # one row per layer
    ranked = performance.withColumns(
        {
            "_r": F.rank().over(w.orderBy("avg_return")) + (F.count("*").over(W.partitionBy(FACTOR, "avg_return")) - 1) / 2,
            "_i": F.row_number().over(w.orderBy("factor_quantile")),
        }
    )
    out = ranked.groupBy(FACTOR).agg(
        F.max_by("avg_return", "factor_quantile").alias("top_layer_return"),
        F.min_by("avg_return", "factor_quantile").alias("bottom_layer_return"),
        F.max_by("return_volatility", "factor_quantile").alias("_ts"),
        F.min_by("return_volatility", "factor_quantile").alias("_bs"),
        correlation("_i", "_r").alias("monotonicity"),
        F.count("*").alias("layers"),
    )
    gain = F.col("top_layer_return") - F.col("bottom_layer_return")
    risk = F.sqrt(F.col("_ts") * F.col("_ts") + F.col("_bs") * F.col("_bs"))
    return out.withColumns(
        {
            "long_short_return": gain,
            "long_short_volatility": risk,
            "sharpe_ratio": F.when(risk > 0, gain / risk).otherwise(0.0),
            "monotonicity": F.when(F.col("layers") > 2, F.col("monotonicity")),
        }
    ).drop("_ts", "_bs")


def layer_variance_test(layered: DataFrame) -> DataFrame:
    """One-way analysis of variance of daily layer means, from sums per layer."""
    cells = layered.groupBy(FACTOR, "factor_quantile").agg(
        F.count("mean").alias("n"), F.avg("mean").alias("m"), F.var_pop("mean").alias("v")
    )
    total = cells.groupBy(FACTOR).agg(
        F.sum("n").alias("N"),
        F.count("*").alias("k"),
        F.min("n").alias("smallest"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2.0) / F.sum("n")).alias("between"),
    )
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k")))
    usable = (F.col("k") > 1) & (F.col("smallest") > 1)
    return total.where(usable).select(FACTOR, f.alias("f_statistic"), (F.col("k") - 1).alias("df_between"), (F.col("N") - F.col("k")).alias("df_within"))


def with_f_p_value(test: DataFrame) -> DataFrame:
    return test.withColumn("p_value", f_p_value(F.col("f_statistic"), F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def day_number() -> Column:
    return F.datediff(DATE, F.lit("1970-01-01").cast("date"))


def forward_returns(returns: DataFrame, max_periods: int = 20, ret: str = "return_rate", keep=(), first: int = 1) -> DataFrame:
    """Each day's returns ``first`` to ``max_periods`` calendar days later, as a list of (period, return) in ``ahead``.

    ``keep`` names further columns to give.
    A day without a return of its own stays, as a factor may have a value on it. The window looks at
    the security's days only, so bars that are bucketed by security are not exchanged.
    """
    rows = returns.select(CODE, DATE, day_number().alias("_day"), F.col(ret).alias("_ret"), *keep)
    later = W.partitionBy(CODE).orderBy("_day").rangeBetween(first, max_periods)
    held = F.collect_list(F.when(F.col("_ret").isNotNull(), F.struct("_day", "_ret"))).over(later)
    ahead = F.transform(held, lambda x: F.struct((x["_day"] - F.col("_day")).alias("period"), x["_ret"].alias(ret)))
    return rows.withColumn("ahead", ahead).select(CODE, DATE, "ahead", *keep)


DEALT_ROWS = 50_000  # rows, each with its list of later returns, behind a task that opens the lists
TURN_ROWS = 16_000_000  # rows that are exchanged before the disk is free again


def _known(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CODE).isNotNull() & F.col(DATE).isNotNull())


def day_turns(rows: DataFrame, cells: list[str]) -> tuple[list[tuple[int, int, int]], bool]:
    """Runs of days that have up to ``TURN_ROWS`` rows together, or one day, as the first and last day's number and rows.

    Also whether a cell of a day has more rows than a task should take. Only days are collected.
    """
    with brief_shuffles(rows.sparkSession):
        sizes = _known(rows).groupBy(*cells).agg(F.count("*").alias("n"))
        days = sorted(sizes.groupBy(day_number().alias("day")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect())
    turns, most = [], 0
    for day, n, largest in days:
        most = max(most, largest)
        if turns and turns[-1][2] + n <= TURN_ROWS:
            turns[-1] = (turns[-1][0], day, turns[-1][2] + n)
        else:
            turns.append((day, day, n))
    return turns or [(0, 0, 0)], most > X.HOT_ROWS


def dealt_pairs(factors: DataFrame, returns: DataFrame | None, turn: tuple[int, int, int], periods: range, value: str = "factor_value", ret: str = "return_rate", wide=()) -> DataFrame:
    """Each factor value of a turn's days with the returns ``periods`` calendar days later, dealt by day.

    Inputs are those of :func:`factor_decay`. Later returns travel with the row as one list. Rows
    are exchanged once, and lists are opened behind the exchange. A period of 0 is the same day.
    """
    first, last, n = turn
    low, high = periods[0], periods[-1]
    near, reach = day_number().between(first, last), day_number().between(first, last + high)
    if returns is None:
        twice = F.count("*").over(W.partitionBy(CODE, DATE))
        pairs = forward_returns(_known(factors).where(reach).withColumn("_twice", twice), high, ret, ("_twice", *wide), low)
        same, later = F.filter("ahead", lambda x: x["period"] == 0), F.filter("ahead", lambda x: x["period"] > 0)
        repeated = F.concat(same, F.flatten(F.array_repeat(later, F.col("_twice").cast("int"))))
        pairs = pairs.withColumn("ahead", F.when(F.col("_twice") == 1, F.col("ahead")).otherwise(repeated))
        pairs, cells = pairs.where(near & (F.size("ahead") > 0)).select(DATE, "ahead", *wide), [DATE]
    else:
        ahead = forward_returns(returns.where(reach), high, ret, (ret,), max(low, 1)) if high else returns.where(near).select(CODE, DATE, ret).withColumn("ahead", F.array())
        if low == 0:
            own = F.array(F.struct(F.lit(0).alias("period"), F.col(ret)))
            ahead = ahead.withColumn("ahead", F.when(F.col(ret).isNull(), F.col("ahead")).otherwise(F.concat(own, "ahead") if high else own))
        pairs = factors.select(FACTOR, CODE, DATE, value).where(near).join(ahead.where(near).select(CODE, DATE, "ahead"), [CODE, DATE])
        pairs, cells = pairs.where((F.size("ahead") > 0) & F.col(value).isNotNull()).select(FACTOR, DATE, value, "ahead"), [FACTOR, DATE]
    parts = max(int(factors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // DEALT_ROWS)
    dealt = pairs.repartition(parts, *cells)
    if returns is None:
        # An unpivot would lose the exchange's partitioning.
        named = F.array(*[F.struct(F.lit(c).alias(FACTOR), F.col(c).alias(value)) for c in wide])
        dealt = dealt.select(DATE, "ahead", F.explode(named).alias("f")).select(f"f.{FACTOR}", DATE, f"f.{value}", "ahead").where(F.col(value).isNotNull())
    return dealt.select(FACTOR, DATE, value, F.explode("ahead").alias("a")).select(FACTOR, "a.period", DATE, value, f"a.{ret}")


def period_coefficients(factors: DataFrame, returns: DataFrame | None, periods: range, value: str = "factor_value", ret: str = "return_rate", min_pairs: int = 10, wide=()) -> DataFrame:
    """Coefficients of each factor and day against returns ``periods`` calendar days later.

    Days are taken in turns, so that the disk holds the exchanged rows of one turn. The result has
    a row for each factor, period and day.
    """
    # A row has one return per period, so no group that is ranked exceeds its factor's rows of the day.
    turns, hot = day_turns(factors, [DATE] if returns is None else [FACTOR, DATE])
    found = (information_coefficients(dealt_pairs(factors, returns, t, periods, value, ret, wide), value, ret, (FACTOR, "period", DATE), min_pairs, hot) for t in turns)
    return stored_in_turns(factors.sparkSession, (ic.repartition(1) for ic in found), "coefficients")


def layered_by_days(factors: DataFrame, returns: DataFrame | None, layers: int = 10, value: str = "factor_value", ret: str = "return_rate", wide=()) -> DataFrame:
    """:func:`layered_returns` of each factor and the same day's returns, days taken in turns."""
    turns, hot = day_turns(factors, [DATE] if returns is None else [FACTOR, DATE])
    found = (layered_returns(dealt_pairs(factors, returns, t, range(1), value, ret, wide), layers, value, ret, hot) for t in turns)
    return stored_in_turns(factors.sparkSession, (layered.repartition(1) for layered in found), "layered")


def factor_decay(factors: DataFrame, returns: DataFrame | None, max_periods: int = 20, value: str = "factor_value", ret: str = "return_rate", min_pairs: int = 10, wide=()) -> DataFrame:
    """Mean coefficient of a factor against returns ``k`` calendar days later, k = 1..max.

    ``returns`` has a row for each security and day that a factor may have a value on. Without it,
    ``factors`` has the columns ``wide`` and the return beside them, and rows are not joined; a
    security's day that comes twice counts as often as if each row met both.
    """
    return mean_by_period(period_coefficients(factors, returns, range(1, max_periods + 1), value, ret, min_pairs, wide))


def mean_by_period(ic: DataFrame) -> DataFrame:
    return ic.groupBy(FACTOR, "period").agg(
        F.avg("ic_pearson").alias("avg_ic_pearson"),
        F.avg("ic_spearman").alias("avg_ic_spearman"),
        F.stddev_samp("ic_pearson").alias("ic_std_pearson"),
        F.stddev_samp("ic_spearman").alias("ic_std_spearman"),
        F.abs(F.avg("ic_pearson")).alias("abs_avg_ic_pearson"),
        F.abs(F.avg("ic_spearman")).alias("abs_avg_ic_spearman"),
        F.count("*").alias("n_dates"),
    )


# Names of decay patterns.
PATTERNS = {"fast": "fast decay", "slow": "slow decay", "rising": "strengthening", "stable": "stable", "none": "no clear trend"}


def decay_profile(decay: DataFrame) -> DataFrame:
    """Best period, half-life, trend and stability per factor, without the trend's p-value."""
    size = F.col("abs_avg_ic_pearson")
    first = F.min_by("abs_avg_ic_pearson", "period").over(W.partitionBy(FACTOR))  # max_periods rows
    marked = decay.withColumn("_half", size <= first / 2)

    def best(c):
        return F.max_by("period", F.struct(F.col(c), -F.col("period")))

    out = marked.groupBy(FACTOR).agg(
        best("abs_avg_ic_pearson").alias("optimal_period_pearson"),
        F.max("abs_avg_ic_pearson").alias("max_abs_ic_pearson"),
        best("abs_avg_ic_spearman").alias("optimal_period_spearman"),
        F.max("abs_avg_ic_spearman").alias("max_abs_ic_spearman"),
        F.coalesce(F.min(F.when(F.col("_half"), F.col("period"))).cast("long"), F.count("*")).alias("half_life"),
        correlation("period", "abs_avg_ic_pearson").alias("decay_correlation"),
        F.avg("ic_std_pearson").alias("avg_ic_volatility"),
        F.count("*").alias("periods"),
    )
    v = F.col("avg_ic_volatility")
    return out.withColumn("stability_score", F.when(v > 0, F.lit(1.0) / (v + 1)).otherwise(1.0))


def decay_pattern(profile: DataFrame) -> DataFrame:
    """Name the trend; input is one row per factor."""
    tested = profile.withColumn("p_value", correlation_p_value(F.col("decay_correlation"), F.col("periods").cast("double")))
    c = F.col("decay_correlation")
    named = (
        F.when(F.col("p_value") >= 0.05, PATTERNS["none"])
        .when(c < -0.5, PATTERNS["fast"])
        .when(c < -0.2, PATTERNS["slow"])
        .when(c > 0.2, PATTERNS["rising"])
        .otherwise(PATTERNS["stable"])
    )
    return tested.withColumn("pattern", F.when(F.col("periods") >= 3, named))


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlations, long, both directions and the diagonal.

    Pearson is one aggregate over all pairs. Spearman ranks inside each pair's complete rows, as a
    pairwise-complete matrix requires. The number of pairs depends on the columns alone. The ranked
    methods read ``df`` several times and need the same values each time.
    """
    pairs = _pairs(cols)
    if method == "pearson":
        row = df.agg(*[correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    elif method == "spearman":
        ranked = pair_positions(df, cols, lambda below, ties: {"rank": below + (ties + 1) / 2})
        at = {c: i for i, c in enumerate(cols)}
        row = ranked.agg(*[correlation(f"rank_{at[a]}_{at[b]}", f"rank_{at[b]}_{at[a]}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    elif method == "kendall":
        return kendall_matrix(df, cols)
    else:
        raise ValueError(f"unknown method {method}")
    cells = [F.struct(F.lit(a).alias("factor_1"), F.lit(b).alias("factor_2"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    cells += [F.struct(F.lit(b).alias("factor_1"), F.lit(a).alias("factor_2"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    cells += [F.struct(F.lit(c).alias("factor_1"), F.lit(c).alias("factor_2"), F.lit(1.0).alias("correlation")) for c in cols]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def pair_positions(df: DataFrame, cols: list[str], keep: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Positions of each column among the rows that another column is known in as well.

    For columns j and k, ``keep`` maps the number of such rows with a smaller j, and with the same
    one, to output columns, which are named ``<name>_<j>_<k>`` and null outside those rows. Rows
    are exchanged once for each column: its values are cut at quantiles, pieces are sorted apart
    and shifted by the counts of the pieces before them. Quantiles need not be exact. A value that
    is a quantile is a piece of its own, whose counts alone place it, so that its rows, and those
    without a value, may lie anywhere.
    """
    known = [F.col(f"x{j}").isNotNull() for j in range(len(cols))]
    rows = df.select(*[F.col(c).alias(f"x{j}") for j, c in enumerate(cols)]).where(sum((k.cast("int") for k in known), F.lit(0)) >= 2)
    shares = F.array(*[F.lit((i + 1) / X.SPLITS) for i in range(X.SPLITS - 1)])
    splits = cut(rows.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(f"x{j}", shares))).alias(f"s{j}") for j in range(len(cols))]))  # one row
    out = rows
    for j in range(len(cols)):
        x, others = F.col(f"x{j}"), [k for k in range(len(cols)) if k != j]
        below = X._smaller_in(f"s{j}", f"x{j}")
        piece = F.when(x.isNotNull(), below * 2 + F.coalesce(F.get(f"s{j}", below) == x, F.lit(False)).cast("int"))
        cuts = F.broadcast(splits.select(f"s{j}"))
        counts = rows.crossJoin(cuts).groupBy(piece.alias("_piece")).agg(*[F.count_if(x.isNotNull() & known[k]).alias(f"_n{k}") for k in others])
        before = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)  # at most twice SPLITS rows
        counts = counts.where(F.col("_piece").isNotNull()).select("*", *[F.coalesce(F.sum(f"_n{k}").over(before), F.lit(0)).alias(f"_start{k}") for k in others])
        alone = F.col("_piece").isNull() | (F.col("_piece") % 2 == 1)
        kept = [c for c in out.columns if c != f"x{j}"]
        out = out.crossJoin(cuts).withColumn("_piece", piece).drop(f"s{j}")
        out = out.withColumn("_spread", F.when(alone, F.pmod(F.xxhash64(*kept), F.lit(X.SPLITS))).otherwise(0))
        part = W.partitionBy("_piece", "_spread")
        sums = {f"_upto{k}": F.count_if(known[k]).over(part.orderBy(x)) for k in others}
        ties = {f"_ties{k}": F.count_if(known[k]).over(W.partitionBy("_piece", "_spread", x)) for k in others}
        out = out.withColumns(sums | ties).join(F.broadcast(counts), "_piece", "left")
        new = []
        for k in others:
            smaller = F.col(f"_start{k}") + F.when(alone, 0).otherwise(F.col(f"_upto{k}") - F.col(f"_ties{k}"))
            same = F.when(alone, F.col(f"_n{k}")).otherwise(F.col(f"_ties{k}"))
            new += [F.when(x.isNotNull() & known[k], c).alias(f"{name}_{j}_{k}") for name, c in keep(smaller, same).items()]
        out = out.select(*kept, F.when(x.isNotNull(), True).alias(f"x{j}"), *new)
    return out


PIECE = 250_000  # positions per slab


def concordance(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    """Sum of sign(x - x') * sign(y - y') over all pairs, each taken ``weight * weight'`` times.

    Rows in order of x are dealt by the bits of y from the highest down. Two rows with different y
    share all bits above one level and differ there, so that every pair is counted once.
    """
    y = np.unique(y, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], weight[order]
    at = np.arange(len(x))
    score = 0
    for level in range(int(y.max()).bit_length() - 1, -1, -1) if len(x) else ():
        block = y >> (level + 1)
        new_block = np.append(True, block[1:] != block[:-1])
        new_run = new_block | np.append(True, x[1:] != x[:-1])
        start, run = (np.maximum.accumulate(np.where(new, at, 0)) for new in (new_block, new_run))
        one = (y >> level) & 1
        sums = [np.append(0, np.cumsum(w * side)) for side in (1 - one, one)]
        smaller = [s[run] - s[start] for s in sums]  # rows of the block with a smaller x, by their bit
        score += int(np.sum(w * np.where(one == 1, smaller[0], -smaller[1])))
        order = np.argsort(y >> level, kind="stable")
        x, y, w = x[order], y[order], w[order]
    return score


def _concordance_of(group: pd.DataFrame) -> pd.DataFrame:
    score = concordance(group["x"].to_numpy(), group["y"].to_numpy(), group["w"].to_numpy())
    return pd.DataFrame({"i": group["i"].iloc[:1], "score": [score]})


def kendall_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Kendall tau-b of every pair of columns without forming pairs of rows.

    Both columns become positions in sorted order, and positions are cut into slabs of one size.
    Pairs of rows in one slab of ``a`` are counted there, those in one slab of ``b`` but different
    ones of ``a`` there, and the rest from the numbers of rows in each pair of slabs. A value with
    more rows than a slab has a slab to itself, in which nothing is left to count. Every row is
    exchanged twice, and no task sees more than slabs.
    """
    pairs = _pairs(cols)
    at = {c: j for j, c in enumerate(cols)}
    ranked = stored(pair_positions(df, cols, lambda below, ties: {"below": below, "ties": ties}), "positions")
    size = max(PIECE, math.ceil(ranked.count() / X.SPLITS))  # the table of slabs stays small
    names = [(i, at[a], at[b]) for i, (a, b) in enumerate(pairs)]
    both = F.array(
        *[
            F.when(
                F.col(f"below_{j}_{k}").isNotNull(),
                F.struct(F.lit(i).alias("i"), *[F.col(f"{c}_{p}_{q}").alias(n) for c, p, q, n in (("below", j, k, "pa"), ("ties", j, k, "ta"), ("below", k, j, "pb"), ("ties", k, j, "tb"))]),
            )
            for i, j, k in names
        ]
    )
    long = ranked.select(F.explode(F.filter(both, lambda s: s.isNotNull())).alias("s")).select("s.*")
    for side in "ab":
        slab = F.floor(F.col(f"p{side}") / size) * 2 + (F.col(f"t{side}") >= size).cast("int")
        long = long.withColumn(f"slab_{side}", slab.cast("long"))
    half = F.lit(0.5)
    base = long.groupBy("i").agg(
        F.count("*").cast("double").alias("n"), F.sum((F.col("ta") - 1) * half).alias("tied_a"), F.sum((F.col("tb") - 1) * half).alias("tied_b")
    )
    inside = [
        F.when(F.col(f"t{side}") < size, F.struct(F.lit(side).alias("side"), F.col(f"slab_{side}").alias("slab"), F.col(x).alias("x"), F.col("pb").alias("y")))
        for side, x in (("a", "pa"), ("b", "slab_a"))
    ]
    rows = long.select("i", F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s")).select("i", "s.*").withColumn("w", F.lit(1).cast("long"))
    table = long.groupBy("i", F.col("slab_a").alias("x"), F.col("slab_b").alias("y")).agg(F.count("*").alias("w"))
    scores = rows.groupBy("i", "side", "slab").applyInPandas(_concordance_of, "i int, score long")
    scores = scores.unionByName(table.groupBy("i").applyInPandas(_concordance_of, "i int, score long"))
    counted = scores.groupBy("i").agg(F.sum(F.col("score").cast("decimal(38,0)")).cast("double").alias("score"))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.col("score"), F.sqrt((n0 - F.col("tied_a")) * (n0 - F.col("tied_b"))))
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    one_side = base.join(counted, "i").select(F.get(names, F.col("i")).alias("p"), tau.alias("correlation"))
    diagonal = [F.struct(F.lit(c).alias("factor_1"), F.lit(c).alias("factor_2"), F.lit(1.0).alias("correlation")) for c in cols]
    rows = one_side.select(
        F.explode(
            F.array(
                F.struct(F.col("p.x").alias("factor_1"), F.col("p.y").alias("factor_2"), "correlation"),
                F.struct(F.col("p.y").alias("factor_1"), F.col("p.x").alias("factor_2"), "correlation"),
            )
        ).alias("c")
    ).select("c.*")
    return rows.unionByName(df.sparkSession.range(1).select(F.explode(F.array(*diagonal)).alias("c")).select("c.*"))


def rolling_pair_correlation(df: DataFrame, cols: list[str], window: int = 60, key: str = CODE) -> DataFrame:
    """Correlation of each pair over the ``window`` rows before the current one, per security."""
    w = W.partitionBy(key).orderBy(DATE)
    frame = w.rowsBetween(-window, -1)
    enough = F.row_number().over(w) > window
    return df.select(
        key,
        DATE,
        *[
            F.when(enough, correlation(a, b, frame)).alias(f"corr_{a}_{b}")
            for a, b in _pairs(cols)
        ],
    )


def high_correlations(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    one_side = matrix.where((F.col("factor_1") < F.col("factor_2")) & (F.abs("correlation") >= threshold))
    return one_side.withColumn("abs_correlation", F.abs("correlation")).orderBy(F.desc("abs_correlation"), "factor_1", "factor_2")


def independence(matrix: DataFrame) -> DataFrame:
    """One minus the mean absolute correlation to the other factors."""
    return matrix.where(F.col("factor_1") != F.col("factor_2")).groupBy(F.col("factor_1").alias(FACTOR)).agg(
        (F.lit(1.0) - F.avg(F.abs("correlation"))).alias("independence")
    )


def data_summary(factors: DataFrame, returns: DataFrame, ret: str = "return_rate") -> DataFrame:
    """Sizes of both inputs and of their join, one row."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in factors.columns), F.lit(0))
    f = factors.agg(
        F.count("*").alias("factor_records"),
        F.count_distinct(CODE).alias("factor_stocks"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        F.try_divide(nulls, F.count("*") * len(factors.columns)).alias("missing_ratio"),
    )
    r = returns.agg(
        F.count("*").alias("return_records"),
        F.count_distinct(CODE).alias("return_stocks"),
        F.avg(ret).alias("avg_return"),
        F.stddev_samp(ret).alias("return_volatility"),
    )
    both = factors.select(CODE, DATE).join(returns.select(CODE, DATE), [CODE, DATE]).agg(
        F.count("*").alias("matched_records"), F.count_distinct(CODE).alias("effective_stocks"), F.count_distinct(DATE).alias("effective_periods")
    )
    out = f.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(both))  # single rows
    return out.withColumn("coverage_ratio", F.try_divide(F.col("matched_records"), F.greatest("factor_records", "return_records")))


def rating(ic_stats: DataFrame, ir_stats: DataFrame, spread: DataFrame, decay: DataFrame) -> DataFrame:
    """Weighted component scores and grade per factor.

    A component that is missing counts neither in the sum nor in the divisor; the sum is a
    quarter of the weighted score, as the divisor of four components remains in it.
    """
    ic = ic_stats.where(F.col("kind") == "pearson").select(
        FACTOR,
        F.least(F.lit(100.0), F.abs("mean") * 1000 + F.col("positive_ratio") * 20 + F.col("significant_ratio") * 30).alias("ic_score"),
        F.abs("mean").alias("ic_abs_mean"),
        "positive_ratio",
    )
    ir = ir_stats.select(FACTOR, F.least(F.lit(100.0), F.abs("final_ir") * 20 + F.col("ir_positive_ratio") * 50).alias("ir_score"), "final_ir")
    monotone = (F.col("monotonicity") > 0.5) & (F.col("monotonicity_p") < 0.05)
    layer = spread.withColumn("monotonicity_p", correlation_p_value(F.col("monotonicity"), F.col("layers").cast("double"))).select(
        FACTOR,
        (
            F.least(F.lit(50.0), F.abs("sharpe_ratio") * 25)
            + F.when(monotone, 50.0).otherwise(F.coalesce(F.col("monotonicity"), F.lit(0.0)) * 25)
        ).alias("layered_score"),
        "sharpe_ratio",
    )
    period = F.col("optimal_period_pearson")
    trend = (
        F.when(F.col("pattern").isin(PATTERNS["stable"], PATTERNS["rising"]), 50)
        .when(F.col("pattern") == PATTERNS["slow"], 30)
        .otherwise(10)
    )
    fade = decay.select(FACTOR, (F.when(period <= 5, 50).when(period <= 10, 30).otherwise(10) + trend).cast("double").alias("decay_score"))
    joined = ic.join(ir, FACTOR, "full_outer").join(layer, FACTOR, "full_outer").join(fade, FACTOR, "full_outer")
    weights = {"ic_score": 0.3, "ir_score": 0.25, "layered_score": 0.25, "decay_score": 0.2}
    total = sum((F.coalesce(F.col(c) * v, F.lit(0.0)) for c, v in weights.items()), F.lit(0.0)) / len(weights)
    return joined.withColumn("score", F.round(total, 2)).withColumn("grade", grade_by_score(total))


def rank_factors(ratings: DataFrame) -> DataFrame:
    """Number factors by score; one row per factor, so the order is small."""
    return ratings.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), FACTOR)))


def recommendation(ranked: DataFrame, top_n: int = 10) -> DataFrame:
    """The first factors with the count of their grade and the mean score of the selection."""
    top = ranked.where(F.col("rank") <= top_n)
    every = W.partitionBy()
    mean: Column = F.avg("score").over(every)
    return top.select(
        FACTOR,
        "rank",
        "score",
        "grade",
        F.round(mean, 2).alias("average_score"),
        F.count("*").over(W.partitionBy("grade")).alias("grade_count"),
        F.when(mean >= 70, "use directly").when(mean >= 50, "combine with others").otherwise("use with care").alias("advice"),
    )
