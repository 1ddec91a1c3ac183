"""Cross-sectional cleaning, standardisation, neutralisation and composition of factors.

``by`` names the group a cross-section is taken over, usually the trade date or the date and the
industry. Columns are replaced in place unless an output name is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.scalars import clip, inverse_normal, row_mean
from alphaloom.functions.stats import correlation, sample_kurtosis, sample_skew
from alphaloom.operators import crosssection as X

DATE = "trade_date"


def _keep_if(cond: Column, value: Column, original: Column) -> Column:
    """``value`` where the condition holds, the original otherwise (null conditions included)."""
    return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(original)


def winsorize(df: DataFrame, cols: str | list[str], method: str = "quantile", by=DATE, lower=0.01, upper=0.99, k=3.0) -> DataFrame:
    """Limit columns to bounds of their cross-section, all columns by the same groupings.

    quantile: interpolated quantiles; mad: median +/- k unscaled MAD; zscore: mean +/- k sd.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    lo, hi = "_lo_{}".format, "_hi_{}".format
    if method == "quantile":
        out = X.with_all_quantiles(df, by, {c: {lo(c): lower, hi(c): upper} for c in cols})
        bounds = {c: (F.col(lo(c)), F.col(hi(c))) for c in cols}
    elif method == "mad":
        out = X.with_all_median_mad(df, by, {c: (lo(c), hi(c)) for c in cols})
        bounds = {c: (F.col(lo(c)) - F.col(hi(c)) * k, F.col(lo(c)) + F.col(hi(c)) * k) for c in cols}
    elif method == "zscore":
        out = X.group_stats(df, by, **{lo(c): F.avg(c) for c in cols}, **{hi(c): F.stddev_samp(c) for c in cols})
        bounds = {c: (F.col(lo(c)) - F.col(hi(c)) * k, F.col(lo(c)) + F.col(hi(c)) * k) for c in cols}
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumns({c: clip(c, *bounds[c]) for c in cols}).drop(*[f(c) for c in cols for f in (lo, hi)])


def standardize(df: DataFrame, cols: str | list[str], method: str = "zscore", by=DATE) -> DataFrame:
    """Cross-sectional scores; a group without spread keeps its values."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    m, s = "_m_{}".format, "_s_{}".format
    if method in ("zscore", "robust"):
        if method == "zscore":
            out = X.group_stats(df, by, **{m(c): F.avg(c) for c in cols}, **{s(c): F.stddev_samp(c) for c in cols})
        else:
            out = X.with_all_median_mad(df, by, {c: (m(c), s(c)) for c in cols})
        scores = {c: _keep_if(F.col(s(c)) > 0, F.try_divide(F.col(c) - F.col(m(c)), F.col(s(c))), F.col(c)) for c in cols}
        return out.withColumns(scores).drop(*[f(c) for c in cols for f in (m, s)])
    if method == "rank":
        out = X.with_all_positions(df, [(by, c, f"_{c}_") for c in cols])
        for c in cols:
            share = clip((X.average_rank(f"_{c}_") - 0.5) / F.col(f"_{c}_n"), 0.001, 0.999)
            out = out.withColumn(c, _keep_if(F.col(f"_{c}_n") > 1, inverse_normal(share), F.col(c)))
        return out.drop(*[f"_{c}_{k}" for c in cols for k in ("below", "ties", "n")])
    raise ValueError(f"unknown method {method}")


def neutralize(
    df: DataFrame, cols: str | list[str], cap: str | None = "market_cap", industry: str | None = "industry", by: str = DATE, min_rows: int = 10
) -> DataFrame:
    """Replace factors by their regression residual on log cap and industry, per date.

    With industry dummies the regression equals one on values centred inside the industry. Sums
    per (date, industry) give the means, and added up over the industries of a date the slope, so
    one grouping of the rows serves every factor. Rows with a missing value keep the raw factor,
    and so do dates with too few rows. Rows without an industry form a group of their own.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    work = df.withColumn("_c", F.when(F.col(cap) > 0, F.log(cap)) if cap else F.lit(0.0))
    if not industry:
        work = work.withColumn("_industry", F.lit("all"))
    group = industry or "_industry"
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(cols):
        use = F.col(c).isNotNull() & F.col("_c").isNotNull()
        x, z = F.when(use, F.col(c)), F.when(use, F.col("_c"))
        aggs += [
            F.count(x).alias(f"_n{i}"),
            F.avg(x).alias(f"_mx{i}"),
            F.avg(z).alias(f"_mc{i}"),
            (F.covar_pop(x, z) * F.count(x)).alias(f"_sxc{i}"),
            (F.var_pop(z) * F.count(x)).alias(f"_scc{i}"),
        ]
    small = work.groupBy(by, group).agg(*aggs)
    day = W.partitionBy(by)  # one row per industry of the date
    regressors = F.lit(1 if cap else 0)
    if industry:
        kinds = df.agg(F.count_distinct(industry).alias("_kinds"))  # one row
        small = small.crossJoin(F.broadcast(kinds))
        regressors = regressors + F.col("_kinds")
    stats = [F.sum("_rows").over(day).alias("_rows")]
    for i in range(len(cols)):
        slope = F.try_divide(F.sum(f"_sxc{i}").over(day), F.sum(f"_scc{i}").over(day))
        stats += [
            f"_mx{i}",
            f"_mc{i}",
            F.coalesce(slope, F.lit(0.0)).alias(f"_b{i}"),
            (F.coalesce(F.sum(f"_n{i}").over(day), F.lit(0)) > regressors + 1).alias(f"_ok{i}"),
        ]
    small = small.select(by, group, *stats)
    out = X.attach(work, small, [by, group])
    for i, c in enumerate(cols):
        residual = F.col(c) - F.col(f"_mx{i}") - F.col(f"_b{i}") * (F.col("_c") - F.col(f"_mc{i}"))
        out = out.withColumn(c, _keep_if((F.col("_rows") > min_rows) & F.col(f"_ok{i}") & residual.isNotNull(), residual, F.col(c)))
    extra = ["_c", "_rows", "_industry"] + [f"_{k}{i}" for i in range(len(cols)) for k in ("mx", "mc", "b", "ok")]
    return out.drop(*extra)


def limit_outliers(df: DataFrame, col: str, treatment: str = "clip", by=DATE, lower=0.01, upper=0.99) -> DataFrame:
    """none, clip, winsorize (the same as clip) or remove (to null) outside the quantiles."""
    treatment = treatment.lower()
    if treatment == "none":
        return df
    out = X.with_quantiles(df, by, col, {"_lo": lower, "_hi": upper})
    x = F.col(col)
    if treatment == "remove":
        value = F.when((x >= F.col("_lo")) & (x <= F.col("_hi")), x)
    elif treatment in ("clip", "winsorize"):
        value = clip(x, F.col("_lo"), F.col("_hi"))
    else:
        raise ValueError(f"unknown treatment {treatment}")
    return out.withColumn(col, value).drop("_lo", "_hi")


def zscore_standardize(df: DataFrame, col: str, by=DATE, treatment: str = "clip") -> DataFrame:
    return standardize(limit_outliers(df, col, treatment, by), col, "zscore", by)


def quantile_standardize(df: DataFrame, col: str, by=DATE) -> DataFrame:
    """Share of the group's values at or below the value."""
    out = X.with_positions(df, by, col)
    return out.withColumn(col, X.cumulative_share()).drop("_below", "_ties", "_n")


def rank_standardize(df: DataFrame, col: str, by=DATE, ascending: bool = True) -> DataFrame:
    """Mean rank scaled to [0, 1] between the smallest and largest rank; 0.5 when all tie."""
    out = X.with_positions(df, by, col).withColumn("_r", X.average_rank(ascending=ascending))
    out = X.group_stats(out, by, _lo=F.min("_r"), _hi=F.max("_r"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(F.col("_r").isNotNull(), F.when(span > 0, (F.col("_r") - F.col("_lo")) / span).otherwise(0.5))
    return out.withColumn(col, value).drop("_below", "_ties", "_n", "_r", "_lo", "_hi")


def minmax_standardize(df: DataFrame, col: str, by=DATE, feature_range=(0.0, 1.0)) -> DataFrame:
    a, b = feature_range
    out = X.group_stats(df, by, _lo=F.min(col), _hi=F.max(col))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, (F.col(col) - F.col("_lo")) / span * (b - a) + a).otherwise((a + b) / 2)
    return out.withColumn(col, F.when(F.col(col).isNotNull(), value)).drop("_lo", "_hi")


def robust_standardize(df: DataFrame, col: str, by=DATE) -> DataFrame:
    """(x - median) / MAD, with the standard deviation in place of a zero MAD."""
    out = X.group_stats(X.with_median_mad(df, by, col), by, _s=F.stddev_samp(col))
    x = F.col(col)
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_s") > 0, F.col("_s"))
    return out.withColumn(col, _keep_if(scale.isNotNull(), F.try_divide(x - F.col("_med"), scale), x)).drop("_med", "_mad", "_s")


METHODS = {
    "zscore": zscore_standardize,
    "quantile": quantile_standardize,
    "rank": rank_standardize,
    "minmax": minmax_standardize,
    "robust": robust_standardize,
}


def standardize_with(df: DataFrame, col: str, method: str, by=DATE) -> DataFrame:
    """Score by method name; an unknown name leaves the column as it is."""
    return METHODS[method](df, col, by) if method in METHODS else df


def industry_standardize(df: DataFrame, col: str, method: str = "zscore", industry: str = "industry", by: str = DATE) -> DataFrame:
    """Score inside the industry of the date; single members stay raw, unmapped rows are null."""
    keys = [by, industry]
    known = df.withColumn("_raw", F.col(col))
    scored = standardize_with(known, col, method, keys)
    scored = X.group_stats(scored, keys, _members=F.count("*"))
    value = F.when(F.col(industry).isNull(), F.lit(None)).when(F.col("_members") < 2, F.col("_raw")).otherwise(F.col(col))
    return scored.withColumn("standardized_value", value.cast("double")).withColumn(col, F.col("_raw")).drop("_raw", "_members")


def industry_rank(df: DataFrame, col: str, industry: str = "industry", by: str = DATE, ascending: bool = False) -> DataFrame:
    keys = [by, industry]
    out = X.group_stats(X.with_positions(df, keys, col), keys, _members=F.count("*"))
    known = F.col(industry).isNotNull()
    rank = F.when(known, X.average_rank(ascending=ascending))
    return out.withColumns(
        {
            "industry_rank": rank,
            "industry_rank_pct": rank / F.col("_n"),
            "industry_stock_count": F.when(known, F.col("_members")),
        }
    ).drop("_below", "_ties", "_n", "_members")


def industry_neutralize(df: DataFrame, col: str, industry: str = "industry", by: str = DATE) -> DataFrame:
    """Subtract the industry mean; rows without an industry subtract nothing."""
    out = X.group_stats(df, [by, industry], _m=F.avg(col))
    shift = F.when(F.col(industry).isNotNull(), F.coalesce("_m", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("neutralized_value", F.col(col) - shift).drop("_m")


def market_quantiles(df: DataFrame, col: str, n: int = 10, by=DATE) -> DataFrame:
    """Equal-frequency bucket 1..n and its rank inside the market."""
    out = X.bucket_by_edges(df, by, col, n, "quantile")
    return out.withColumn("quantile_rank", F.col("quantile") / n)


def quantile_stats(df: DataFrame, col: str, by=DATE) -> DataFrame:
    keys = [by] if isinstance(by, str) else list(by)
    return df.where(F.col("quantile").isNotNull()).groupBy(*keys, "quantile").agg(
        F.count(col).alias("count"),
        F.min(col).alias("min_value"),
        F.max(col).alias("max_value"),
        F.avg(col).alias("mean_value"),
        F.stddev_samp(col).alias("std_value"),
    )


def industry_quantiles(df: DataFrame, col: str, n: int = 5, industry: str = "industry", by: str = DATE, tie: str = "ts_code") -> DataFrame:
    """Buckets inside the industry; a group smaller than n uses its own order instead.

    The order fallback only ever numbers groups of fewer than n rows, so the window over them is
    bounded; larger groups never enter it.
    """
    keys = [by, industry]
    out = X.group_stats(X.bucket_by_edges(df.where(F.col(industry).isNotNull()), keys, col, n, "_q"), keys, _members=F.count("*"))
    big = out.where(F.col("_members") >= n).select(
        *df.columns, F.col("_q").alias("industry_quantile"), (F.col("_q") / n).alias("industry_quantile_rank")
    )
    w = W.partitionBy(*keys).orderBy(F.col(col).asc_nulls_last(), tie)
    small = out.where(F.col("_members") < n).withColumn("_r", F.when(F.col(col).isNotNull(), F.row_number().over(w)))
    small = small.select(*df.columns, F.col("_r").alias("industry_quantile"), (F.col("_r") / F.col("_members")).alias("industry_quantile_rank"))
    none = df.where(F.col(industry).isNull()).select(
        "*", F.lit(None).cast("int").alias("industry_quantile"), F.lit(None).cast("double").alias("industry_quantile_rank")
    )
    return big.unionByName(small).unionByName(none)


def update_quantiles(current: DataFrame, history: DataFrame, keys=("quantile",), decay: float = 0.95, keep: bool = False) -> DataFrame:
    """Blend bucket statistics with the stored ones; a new bucket is taken as it is.

    ``keep`` also returns the buckets that only the stored statistics hold, as they are.
    """
    stats = ("min_value", "max_value", "mean_value", "std_value")
    rest = [c for c in current.columns if c not in (*keys, *stats) and keep]
    old = history.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*stats, *rest)])
    joined = current.join(old, list(keys), "full" if keep else "left")

    def blended(c: str) -> Column:
        both = F.col("_mean_value").isNotNull() & F.col("mean_value").isNotNull()
        return F.when(both, F.col(f"_{c}") * decay + F.col(c) * (1 - decay)).when(F.col("mean_value").isNull(), F.col(f"_{c}")).otherwise(F.col(c))

    new = {c: blended(c) for c in stats} | {c: F.coalesce(c, f"_{c}") for c in rest}
    return joined.withColumns(new).select(*current.columns)


def equal_weight(df: DataFrame, cols: list[str], out: str = "composite") -> DataFrame:
    return df.withColumn(out, row_mean(cols))


def weighted(df: DataFrame, weights: dict[str, float], out: str = "composite") -> DataFrame:
    """Weighted sum with weights scaled by the sum of their sizes; a null factor gives null."""
    total = sum(abs(v) for v in weights.values())
    if total == 0:
        return equal_weight(df, list(weights), out)
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) * (v / total) for c, v in weights.items()]))


def weighted_by(df: DataFrame, cols: list[str], weights: DataFrame, out: str = "composite") -> DataFrame:
    """Weighted sum with weights from a (factor_name, weight) table, by size of the weight.

    The table holds one row per factor, so its pivot is a single row.
    """
    row = weights.where(F.col("factor_name").isin(cols)).groupBy().pivot("factor_name", cols).agg(F.first(F.abs("weight")))
    row = row.select(*[F.col(c).alias(f"_w_{c}") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_w_{c}"), F.lit(0.0)) for c in cols])
    joined = df.crossJoin(F.broadcast(row))
    value = reduce(lambda a, b: a + b, [F.col(c) * F.coalesce(F.col(f"_w_{c}"), F.lit(0.0)) for c in cols])
    return joined.withColumn(out, F.try_divide(value, total)).drop(*[f"_w_{c}" for c in cols])


def pca_compose(df: DataFrame, cols: list[str], out: str = "composite") -> DataFrame:
    """First principal component of the standardised complete rows; null elsewhere.

    The sign is set so that the loadings sum to a positive number.
    """
    if len(cols) < 2:
        return equal_weight(df, cols, out)
    complete = df.dropna(subset=cols)
    assembled = VectorAssembler(inputCols=cols, outputCol="_raw").transform(complete)
    scaler = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(assembled)
    scaled = scaler.transform(assembled)
    model = PCA(k=1, inputCol="_z", outputCol="_pc").fit(scaled)
    sign = 1.0 if sum(model.pc.toArray()[:, 0]) >= 0 else -1.0
    done = model.transform(scaled).withColumn(out, vector_to_array("_pc")[0] * sign).drop("_raw", "_z", "_pc")
    rest = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))
    return done.unionByName(rest.withColumn(out, F.lit(None).cast("double")))


def validate_composition(df: DataFrame, cols: list[str], composite: str = "composite") -> DataFrame:
    """One row: correlation to each input, retained variance and shape of the composite."""
    corr = {c: F.coalesce(correlation(composite, c), F.lit(0.0)) for c in cols}
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    spread = reduce(lambda a, b: a + b, [F.var_samp(F.when(complete, F.col(c))) for c in cols])
    return df.agg(
        *[v.alias(f"corr_{c}") for c, v in corr.items()],
        (reduce(lambda a, b: a + b, corr.values()) / len(cols)).alias("avg_correlation"),
        F.try_divide(F.var_samp(composite), spread).alias("information_retention"),
        F.avg(composite).alias("mean"),
        F.stddev_samp(composite).alias("std"),
        sample_skew(composite).alias("skewness"),
        sample_kurtosis(composite).alias("kurtosis"),
        F.count(composite).alias("valid_count"),
        F.count_if(F.col(composite).isNull()).alias("missing_count"),
    )


def score_stability(scores: DataFrame, lookback_days: int, value: str = "standardized_value") -> DataFrame:
    """Stability of scores per security and over time, one row."""
    per_code = scores.groupBy("ts_code").agg(F.stddev_samp(value).alias("sd"), F.avg(value).alias("m"), F.count("*").alias("n"))
    per_code = per_code.where(F.col("n") >= 2).withColumn(
        "cv", F.when(F.abs("m") > 1e-6, F.col("sd") / F.abs("m")).otherwise(F.lit(float("inf")))
    )
    overall = per_code.agg(
        F.avg("sd").alias("avg_std"),
        F.avg((F.col("cv") < 0.5).cast("double")).alias("stable_stocks_ratio"),
        F.count("*").alias("total_stocks"),
    )
    daily = scores.groupBy("trade_date").agg(F.round(F.stddev_samp(value), 4).alias("sd"), F.count(value).alias("n"))
    temporal = daily.agg(
        F.stddev_samp("sd").alias("daily_mean_std"),
        F.stddev_samp("n").alias("daily_count_std"),
        (F.count("*") / lookback_days).alias("data_coverage"),
    )
    return overall.crossJoin(F.broadcast(temporal))


def scoring_normalize(df: DataFrame, cols: list[str], method: str = "zscore", by=(DATE, "industry"), min_group: int = 5, limit: float = 3.0) -> DataFrame:
    """Scores for selection: inside industries of five or more, then limited to +/-3.

    Smaller groups and groups without spread keep raw values before the limit.
    """
    keys = [by] if isinstance(by, str) else list(by)
    floor = min_group if len(keys) > 1 else 0
    known = F.col(keys[-1]).isNotNull() if len(keys) > 1 else F.lit(True)
    a, b = "_a_{}".format, "_b_{}".format
    if method == "zscore":
        out = X.group_stats(df, keys, _rows=F.count("*"), **{a(c): F.avg(c) for c in cols}, **{b(c): F.stddev_samp(c) for c in cols})
        scale = {c: F.col(b(c)) for c in cols}
    elif method == "minmax":
        out = X.group_stats(df, keys, _rows=F.count("*"), **{a(c): F.min(c) for c in cols}, **{b(c): F.max(c) for c in cols})
        scale = {c: F.col(b(c)) - F.col(a(c)) for c in cols}
    elif method == "robust":
        out = X.with_all_median_mad(X.group_stats(df, keys, _rows=F.count("*")), keys, {c: (a(c), b(c)) for c in cols})
        scale = {c: F.col(b(c)) * 1.4826 for c in cols}
    else:
        raise ValueError(f"unknown method {method}")
    big = known & (F.col("_rows") >= floor)
    values = {c: clip(_keep_if(big & (scale[c] > 0), F.try_divide(F.col(c) - F.col(a(c)), scale[c]), F.col(c)), -limit, limit) for c in cols}
    return out.withColumns(values).drop("_rows", *[f(c) for c in cols for f in (a, b)])


def impute_median(df: DataFrame, cols: list[str], by=DATE) -> DataFrame:
    """Fill nulls with the median of the cross-section."""
    out = X.with_all_quantiles(df, by, {c: {f"_med_{c}": 0.5} for c in cols})
    return out.withColumns({c: F.coalesce(c, f"_med_{c}") for c in cols}).drop(*[f"_med_{c}" for c in cols])


def date_statistics(df: DataFrame, value: str = "value", by=DATE) -> DataFrame:
    """z score (0 without spread), the normalised value and the percentile rank per date."""
    out = X.with_positions(X.group_stats(df, by, _m=F.avg(value), _s=F.stddev_samp(value)), by, value)
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return out.withColumns(
        {"z_score": z, "normalized_value": z, "percentile_rank": X.average_rank() / F.col("_n")}
    ).drop("_m", "_s", "_below", "_ties", "_n")
