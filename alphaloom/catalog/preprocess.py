"""Cross-sectional preprocessing queries over the factor panel."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog.base import query, view
from alphaloom.operators import preprocess as P
from alphaloom.sources.tables import panel

KEYS = "ts_code trade_date"
D = "OVER (PARTITION BY trade_date)"
DI = "OVER (PARTITION BY trade_date, industry)"
NEED = ("panel",)


def _over(fn):
    return lambda spark, folder: fn(panel(spark, folder))


def _sel(expr, source="panel", name="x", cols=""):
    return f"SELECT ts_code, trade_date, {cols} {expr} AS {name} FROM {source}"


def _clip(x, lo, hi):
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {hi}), {lo}) END"


def _as_x(fn, col="mom"):
    return _over(lambda df: fn(df).withColumn("x", F.col(col)))


def _mad(col, by, name):
    """A view with the group's median and MAD."""
    o = f"OVER (PARTITION BY {by})"
    return view(name, f"SELECT *, median(dev) {o} AS mad FROM (SELECT *, abs({col} - med) AS dev FROM (SELECT *, median({col}) {o} AS med FROM panel))", "panel")


_mad("mom", "trade_date", "mad_d")
_mad("mom", "trade_date, industry", "mad_di")

_q = f"quantile_cont(mom, {{}}) {D}"
query("winsorize_quantile", KEYS, "x", _sel(_clip("mom", _q.format(0.01), _q.format(0.99))), NEED)(_as_x(lambda d: P.winsorize(d, "mom", "quantile")))
query("winsorize_mad", KEYS, "x", _sel(_clip("mom", "med - 3 * mad", "med + 3 * mad"), "mad_d"), ("mad_d",))(_as_x(lambda d: P.winsorize(d, "mom", "mad")))
query("winsorize_zscore", KEYS, "x", _sel(_clip("mom", f"avg(mom) {D} - 3 * stddev_samp(mom) {D}", f"avg(mom) {D} + 3 * stddev_samp(mom) {D}")), NEED)(
    _as_x(lambda d: P.winsorize(d, "mom", "zscore"))
)
_z = "CASE WHEN stddev_samp({c}) {o} > 0 THEN ({c} - avg({c}) {o}) / stddev_samp({c}) {o} ELSE {c} END"
query("standardize_zscore", KEYS, "x", _sel(_z.format(c="mom", o=D)), NEED)(_as_x(lambda d: P.standardize(d, "mom")))
query("standardize_robust", KEYS, "x", _sel("CASE WHEN mad > 0 THEN (mom - med) / mad ELSE mom END", "mad_d"), ("mad_d",))(
    _as_x(lambda d: P.standardize(d, "mom", "robust"))
)

view(
    "ranked",
    """SELECT *, CASE WHEN mom IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY mom NULLS LAST)
                + (count(*) OVER (PARTITION BY trade_date, mom) - 1) / 2.0 END AS r,
              count(mom) OVER (PARTITION BY trade_date) AS n FROM panel""",
    "panel",
)


def _ppf_sql(p):
    # The published coefficients of the normal quantile approximation.
    tail = (
        "(((((-7.784894002430293e-03*{q}-3.223964580411365e-01)*{q}-2.400758277161838e+00)*{q}-2.549732539343734e+00)*{q}+4.374664141464968e+00)*{q}+2.938163982698783e+00)"
        "/((((7.784695709041462e-03*{q}+3.224671290700398e-01)*{q}+2.445134137142996e+00)*{q}+3.754408661907416e+00)*{q}+1)"
    )
    mid = (
        "(((((-3.969683028665376e+01*{r}+2.209460984245205e+02)*{r}-2.759285104469687e+02)*{r}+1.383577518672690e+02)*{r}-3.066479806614716e+01)*{r}+2.506628277459239e+00)*({p}-0.5)"
        "/(((((-5.447609879822406e+01*{r}+1.615858368580409e+02)*{r}-1.556989798598866e+02)*{r}+6.680131188771972e+01)*{r}-1.328068155288572e+01)*{r}+1)"
    )
    lo, hi, r = f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-{p}))", f"(({p}-0.5)*({p}-0.5))"
    return f"CASE WHEN {p} < 0.02425 THEN {tail.format(q=lo)} WHEN {p} > 0.97575 THEN -({tail.format(q=hi)}) ELSE {mid.format(r=r, p=p)} END"


query(
    "standardize_normal_scores",
    KEYS,
    "x",
    f"SELECT ts_code, trade_date, CASE WHEN n > 1 AND mom IS NOT NULL THEN {_ppf_sql('p')} ELSE mom END AS x FROM (SELECT *, greatest(least((r - 0.5) / n, 0.999), 0.001) AS p FROM ranked)",
    ("ranked",),
)(_as_x(lambda d: P.standardize(d, "mom", "rank")))


def _neutral_sql(source: str, c: str) -> str:
    """The residual of a column on log cap and industry per date, as ``x``."""
    return f"""SELECT ts_code, trade_date, CASE WHEN rows > 10 AND valid > kinds + 2 AND dx IS NOT NULL
               THEN dx - coalesce(sxc / nullif(scc, 0), 0) * dc ELSE {c} END AS x FROM (
          SELECT *, sum(dx * dc) {D} AS sxc, sum(dc * dc) {D} AS scc, count(dx) {D} AS valid, count(*) {D} AS rows,
                 (SELECT count(DISTINCT industry) FROM panel) AS kinds FROM (
            SELECT *, fx - avg(fx) {DI} AS dx, fc - avg(fc) {DI} AS dc FROM (
              SELECT *, CASE WHEN lc IS NOT NULL THEN {c} END AS fx, CASE WHEN {c} IS NOT NULL THEN lc END AS fc FROM (
                SELECT *, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS lc FROM {source}))))"""


query("neutralize_cap_industry", KEYS, "x", _neutral_sql("panel", "mom"), NEED)(_as_x(lambda d: P.neutralize(d, "mom")))


def _processed_sql(c: str) -> str:
    lo, hi = f"quantile_cont({c}, 0.01) {D}", f"quantile_cont({c}, 0.99) {D}"
    cut = f"(SELECT ts_code, trade_date, industry, market_cap, {_clip(c, lo, hi)} AS w FROM panel)"
    z = f"(SELECT *, CASE WHEN stddev_samp(w) {D} > 0 THEN (w - avg(w) {D}) / stddev_samp(w) {D} ELSE w END AS z FROM {cut})"
    return f"SELECT '{c}_processed' AS factor_name, ts_code, trade_date, x AS factor_value FROM ({_neutral_sql(z, 'z')}) WHERE x IS NOT NULL"


view("processed", _processed_sql("mom") + " UNION ALL " + _processed_sql("rng"), "panel")

query(
    "limit_outliers_remove",
    KEYS,
    "x",
    _sel(f"CASE WHEN mom >= {_q.format(0.01)} AND mom <= {_q.format(0.99)} THEN mom END"),
    NEED,
)(_as_x(lambda d: P.limit_outliers(d, "mom", "remove")))

view("clipped", _sel(_clip("mom", _q.format(0.01), _q.format(0.99)), name="mom", cols="industry,"), "panel")
query("score_zscore_clipped", KEYS, "x", _sel(_z.format(c="mom", o=D), "clipped"), ("clipped",))(_as_x(lambda d: P.standardize_with(d, "mom", "zscore")))
query("score_quantile", KEYS, "x", _sel("CASE WHEN mom IS NOT NULL THEN CAST(cume AS DOUBLE) END", "(SELECT *, (r - 1 - (t - 1) / 2.0 + t) / n AS cume FROM (SELECT *, count(*) OVER (PARTITION BY trade_date, mom) AS t FROM ranked))"), ("ranked",))(
    _as_x(lambda d: P.standardize_with(d, "mom", "quantile"))
)
query(
    "score_rank",
    KEYS,
    "x",
    _sel(f"CASE WHEN r IS NOT NULL THEN CASE WHEN max(r) {D} > min(r) {D} THEN (r - min(r) {D}) / (max(r) {D} - min(r) {D}) ELSE 0.5 END END", "ranked"),
    ("ranked",),
)(_as_x(lambda d: P.standardize_with(d, "mom", "rank")))
query(
    "score_minmax",
    KEYS,
    "x",
    _sel(f"CASE WHEN mom IS NOT NULL THEN CASE WHEN max(mom) {D} > min(mom) {D} THEN (mom - min(mom) {D}) / (max(mom) {D} - min(mom) {D}) ELSE 0.5 END END"),
    NEED,
)(_as_x(lambda d: P.standardize_with(d, "mom", "minmax")))
query(
    "score_robust",
    KEYS,
    "x",
    _sel(f"CASE WHEN mad > 0 THEN (mom - med) / mad WHEN stddev_samp(mom) {D} > 0 THEN (mom - med) / stddev_samp(mom) {D} ELSE mom END", "mad_d"),
    ("mad_d",),
)(_as_x(lambda d: P.standardize_with(d, "mom", "robust")))

query(
    "industry_standardize",
    KEYS,
    "standardized_value",
    f"""SELECT ts_code, trade_date, CASE WHEN industry IS NULL THEN NULL WHEN members < 2 THEN raw
          WHEN stddev_samp(y) {DI} > 0 THEN (y - avg(y) {DI}) / stddev_samp(y) {DI} ELSE y END AS standardized_value FROM (
          SELECT ts_code, trade_date, industry, mom AS raw, count(*) {DI} AS members,
                 {_clip('mom', f'quantile_cont(mom, 0.01) {DI}', f'quantile_cont(mom, 0.99) {DI}')} AS y FROM panel)""",
    NEED,
)(_over(lambda d: P.industry_standardize(d, "mom")))

query(
    "industry_rank",
    "ts_code trade_date industry_stock_count",
    "industry_rank industry_rank_pct",
    f"""SELECT *, industry_rank / nullif(n, 0) AS industry_rank_pct FROM (
          SELECT ts_code, trade_date, count(*) {DI} AS industry_stock_count, count(mom) {DI} AS n,
                 CASE WHEN mom IS NOT NULL THEN rank() OVER (PARTITION BY trade_date, industry ORDER BY mom DESC NULLS LAST)
                   + (count(*) OVER (PARTITION BY trade_date, industry, mom) - 1) / 2.0 END AS industry_rank FROM panel)""",
    NEED,
)(_over(lambda d: P.industry_rank(d, "mom")))

query("industry_neutralize", KEYS, "neutralized_value", _sel(f"mom - coalesce(avg(mom) {DI}, 0)", name="neutralized_value"), NEED)(
    _over(lambda d: P.industry_neutralize(d, "mom"))
)


def _bucket_sql(col, n, by):
    edges = ", ".join(f"quantile_cont({col}, {i / n!r}) OVER (PARTITION BY {by})" for i in range(n + 1))
    return f"""SELECT *, CASE WHEN {col} IS NOT NULL THEN CAST(1 + len(list_filter(inner_edges, lambda e: e < {col})) AS INTEGER) END AS bucket FROM (
        SELECT *, CASE WHEN len(edges) > 2 THEN edges[2:len(edges) - 1] ELSE [] END AS inner_edges FROM (
            SELECT *, list_sort(list_distinct([{edges}])) AS edges FROM panel))"""


view("bucket10", _bucket_sql("mom", 10, "trade_date"), "panel")
view("bucket5", _bucket_sql("mom", 5, "trade_date"), "panel")
view("bucket_ind", _bucket_sql("mom", 5, "trade_date, industry"), "panel")

query(
    "market_quantiles",
    "ts_code trade_date quantile",
    "quantile_rank",
    "SELECT ts_code, trade_date, bucket AS quantile, bucket / 10.0 AS quantile_rank FROM bucket10",
    ("bucket10",),
)(_over(lambda d: P.market_quantiles(d, "mom", 10)))

_QS = """SELECT trade_date, bucket AS quantile, count(mom) AS "count", min(mom) AS min_value, max(mom) AS max_value, avg(mom) AS mean_value,
       stddev_samp(mom) AS std_value FROM bucket5 WHERE bucket IS NOT NULL GROUP BY 1, 2"""
query("market_quantile_stats", "trade_date quantile count", "min_value max_value mean_value std_value", _QS, ("bucket5",))(
    _over(lambda d: P.quantile_stats(P.market_quantiles(d, "mom", 5), "mom"))
)

view("qstats", _QS, "bucket5")
view("qhist", "SELECT quantile, avg(min_value) AS min_value, avg(max_value) AS max_value, avg(mean_value) AS mean_value, avg(std_value) AS std_value FROM qstats WHERE quantile < 5 GROUP BY 1", "qstats")


@query(
    "update_dynamic_quantiles",
    "trade_date quantile count",
    "min_value max_value mean_value std_value",
    "SELECT q.trade_date, quantile, q.count, "
    + ", ".join(f"CASE WHEN h.mean_value IS NOT NULL THEN 0.95 * h.{c} + 0.05 * q.{c} ELSE q.{c} END AS {c}" for c in ("min_value", "max_value", "mean_value", "std_value"))
    + " FROM qstats q LEFT JOIN qhist h USING (quantile)",
    ("qstats", "qhist"),
)
def update_dynamic_quantiles(spark, folder):
    """Each day's bucket statistics blended with the long-run ones; the top bucket has none."""
    stats = P.quantile_stats(P.market_quantiles(panel(spark, folder), "mom", 5), "mom")
    cols = ("min_value", "max_value", "mean_value", "std_value")
    past = stats.where(F.col("quantile") < 5).groupBy("quantile").agg(*[F.avg(c).alias(c) for c in cols])
    return P.update_quantiles(stats, past)


query(
    "industry_quantiles",
    "ts_code trade_date industry_quantile",
    "industry_quantile_rank",
    f"""SELECT ts_code, trade_date, CAST(q AS INTEGER) AS industry_quantile, q / d AS industry_quantile_rank FROM (
        SELECT ts_code, trade_date, CASE WHEN members >= 5 THEN 5.0 ELSE members END AS d,
               CASE WHEN members >= 5 THEN bucket WHEN mom IS NOT NULL THEN
                 row_number() OVER (PARTITION BY trade_date, industry ORDER BY mom NULLS LAST, ts_code) END AS q
        FROM (SELECT *, count(*) {DI} AS members FROM bucket_ind))""",
    ("bucket_ind",),
)(_over(lambda d: P.industry_quantiles(d, "mom", 5)))

query(
    "compose_equal_weight",
    KEYS,
    "composite",
    "SELECT ts_code, trade_date, (coalesce(mom,0)+coalesce(volr,0)+coalesce(rng,0)) / nullif((mom IS NOT NULL)::INT+(volr IS NOT NULL)::INT+(rng IS NOT NULL)::INT, 0) AS composite FROM panel",
    NEED,
)(_over(lambda d: P.equal_weight(d, ["mom", "volr", "rng"])))
query("compose_weighted", KEYS, "composite", "SELECT ts_code, trade_date, (mom * 0.5 + volr * -0.3 + rng * 0.4) / 1.2 AS composite FROM panel", NEED)(
    _over(lambda d: P.weighted(d, {"mom": 0.5, "volr": -0.3, "rng": 0.4}))
)

query(
    "compose_ic_weighted",
    KEYS,
    "composite",
    """SELECT ts_code, trade_date, (mom * a + volr * b + rng * c) / (a + b + c) AS composite
       FROM (SELECT *, abs(corr(mom, return_1d) OVER ()) AS a, abs(corr(volr, return_1d) OVER ()) AS b, abs(corr(rng, return_1d) OVER ()) AS c FROM panel)""",
    NEED,
)(
    _over(
        lambda d: P.weighted_by(
            d,
            ["mom", "volr", "rng"],
            d.agg(*[F.corr(c, "return_1d").alias(c) for c in ("mom", "volr", "rng")]).unpivot([], ["mom", "volr", "rng"], "factor_name", "weight"),
        )
    )
)
def _pca_sql(cols: list[str], steps: int = 200) -> str:
    """The first component of the correlations by repeated multiplication, its sign set by the sum of loadings."""
    z = {c: f"({c} - m_{c}) / s_{c}" for c in cols}
    whole = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in cols)
    pairs = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a in cols for b in cols if a != b)
    times = {a: " + ".join(f"w_{b}" if a == b else f"r_{a}_{b} * w_{b}" for b in cols) for a in cols}
    length = "sqrt(" + " + ".join(f"x_{c} * x_{c}" for c in cols) + ")"
    # A start that no component is at right angles to by chance.
    start = ", ".join(f"{1 + k / 10}::DOUBLE AS w_{c}" for k, c in enumerate(cols))
    return f"""WITH RECURSIVE used AS MATERIALIZED (SELECT {moments}, {pairs} FROM panel WHERE {whole}),
        steps AS (SELECT 0 AS k, {start} UNION ALL
          SELECT k + 1, {', '.join(f'x_{c} / {length}' for c in cols)} FROM (SELECT k, {', '.join(f'{times[c]} AS x_{c}' for c in cols)} FROM steps, used WHERE k < {steps})),
        axis AS (SELECT {', '.join(f'w_{c} * CASE WHEN {" + ".join(f"w_{d}" for d in cols)} >= 0 THEN 1 ELSE -1 END AS w_{c}' for c in cols)} FROM steps WHERE k = {steps})
        SELECT ts_code, trade_date, {' + '.join(f'w_{c} * {z[c]}' for c in cols)} AS composite FROM panel, used, axis"""


query("compose_pca", KEYS, "composite", _pca_sql(["mom", "volr", "rng"]), NEED, digits=5)(_over(lambda d: P.pca_compose(d, ["mom", "volr", "rng"])))

_skew, _kurt = "skewness(c)", "kurtosis(c)"
query(
    "validate_composition",
    "valid_count missing_count",
    "corr_mom corr_volr corr_rng avg_correlation information_retention mean std skewness kurtosis",
    f"""SELECT *, (corr_mom + corr_volr + corr_rng) / 3 AS avg_correlation FROM (
        SELECT corr(c, mom) AS corr_mom, corr(c, volr) AS corr_volr, corr(c, rng) AS corr_rng,
               var_samp(c) / (var_samp(mom) FILTER (full_row) + var_samp(volr) FILTER (full_row) + var_samp(rng) FILTER (full_row)) AS information_retention,
               avg(c) AS mean, stddev_samp(c) AS std, {_skew} AS skewness, {_kurt} AS kurtosis, count(c) AS valid_count, count(*) - count(c) AS missing_count
        FROM (SELECT *, mom IS NOT NULL AND volr IS NOT NULL AND rng IS NOT NULL AS full_row, (mom * 0.5 + volr * -0.3 + rng * 0.4) / 1.2 AS c FROM panel))""",
    NEED,
)(_over(lambda d: P.validate_composition(P.weighted(d, {"mom": 0.5, "volr": -0.3, "rng": 0.4}), ["mom", "volr", "rng"])))

view("spread_scores", "SELECT ts_code, trade_date, rng AS x FROM panel", "panel")

query(
    "score_stability",
    "total_stocks",
    "avg_std stable_stocks_ratio daily_mean_std daily_count_std data_coverage",
    f"""SELECT * FROM (SELECT avg(sd) AS avg_std, avg(CASE WHEN abs(m) > 1e-6 AND sd / abs(m) < 0.5 THEN 1.0 ELSE 0.0 END) AS stable_stocks_ratio, count(*) AS total_stocks
          FROM (SELECT ts_code, stddev_samp(x) AS sd, avg(x) AS m FROM spread_scores GROUP BY 1 HAVING count(*) >= 2)),
        (SELECT stddev_samp(sd) AS daily_mean_std, stddev_samp(n) AS daily_count_std, count(*) / 3000.0 AS data_coverage
          FROM (SELECT trade_date, round(stddev_samp(x), 4) AS sd, count(x) AS n FROM spread_scores GROUP BY 1))""",
    ("spread_scores",),
    digits=5,
)(_over(lambda d: P.score_stability(d.select("ts_code", "trade_date", F.col("rng").alias("standardized_value")), 3000)))


def _limited(x):
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(least(({x}), 3), -3) END"


query(
    "scoring_normalize_industry",
    KEYS,
    "x",
    _sel(_limited(f"CASE WHEN industry IS NOT NULL AND count(*) {DI} >= 5 AND stddev_samp(mom) {DI} > 0 THEN (mom - avg(mom) {DI}) / stddev_samp(mom) {DI} ELSE mom END")),
    NEED,
)(_as_x(lambda d: P.scoring_normalize(d, ["mom"])))
query(
    "scoring_normalize_robust",
    KEYS,
    "x",
    _sel(_limited("CASE WHEN mad > 0 THEN (mom - med) / (1.4826 * mad) ELSE mom END"), "mad_d"),
    ("mad_d",),
)(_as_x(lambda d: P.scoring_normalize(d, ["mom"], "robust", "trade_date")))
query("impute_median", KEYS, "x", _sel(f"coalesce(mom, median(mom) {D})"), NEED)(_as_x(lambda d: P.impute_median(d, ["mom"])))
query(
    "date_statistics",
    KEYS,
    "z_score normalized_value percentile_rank",
    f"""SELECT ts_code, trade_date, z AS z_score, z AS normalized_value, r / n AS percentile_rank FROM (
        SELECT *, CASE WHEN stddev_samp(mom) {D} > 0 THEN (mom - avg(mom) {D}) / stddev_samp(mom) {D} ELSE 0 END AS z FROM ranked)""",
    ("ranked",),
)(_over(lambda d: P.date_statistics(d, "mom")))
