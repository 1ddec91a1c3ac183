"""Factor effectiveness queries over the factor panel."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog.base import W, query, view
from alphaloom.operators import effectiveness as E
from alphaloom.plans import reports
from alphaloom.sources.tables import bars, panel

FACTORS = ["mom", "volr", "rng"]


def returns(spark, folder):
    return panel(spark, folder).select("ts_code", "trade_date", F.col("return_1d").alias("return_rate"))


def pairs(spark, folder):
    frame = panel(spark, folder).select("ts_code", "trade_date", F.col("return_1d").alias("return_rate"), *FACTORS)
    return E.to_long(frame, FACTORS)


def coefficients(spark, folder):
    return E.information_coefficients(pairs(spark, folder))


view(
    "fpairs",
    " UNION ALL ".join(f"SELECT '{f}' AS factor_name, ts_code, trade_date, {f} AS v, return_1d AS r FROM panel WHERE {f} IS NOT NULL" for f in FACTORS),
    "panel",
)


def _ic_sql(source, keys):
    k = ", ".join(keys)
    return f"""SELECT {k}, CASE WHEN isfinite(corr(v, r)) THEN round(corr(v, r), 12) END AS ic_pearson, CASE WHEN isfinite(corr(rv, rr)) THEN round(corr(rv, rr), 12) END AS ic_spearman, count(*) AS sample_size, avg(v) AS factor_mean,
                      stddev_samp(v) AS factor_std, avg(r) AS return_mean, stddev_samp(r) AS return_std FROM (
                 SELECT *, rank() OVER (PARTITION BY {k} ORDER BY v) + (count(*) OVER (PARTITION BY {k}, v) - 1) / 2.0 AS rv,
                           rank() OVER (PARTITION BY {k} ORDER BY r) + (count(*) OVER (PARTITION BY {k}, r) - 1) / 2.0 AS rr
                 FROM {source} WHERE v IS NOT NULL AND r IS NOT NULL) GROUP BY {k} HAVING count(*) >= 10"""


view("ic", _ic_sql("fpairs", ["factor_name", "trade_date"]), "fpairs")

query(
    "trailing_returns",
    "ts_code trade_date",
    "return_1d return_5d return_20d return_60d",
    "SELECT ts_code, trade_date, "
    + ", ".join(f'("close" - lag("close", {n}) OVER ({W})) / nullif(lag("close", {n}) OVER ({W}), 0) AS return_{n}d' for n in (1, 5, 20, 60))
    + " FROM bars",
)(
    lambda spark, folder: E.trailing_return(bars(spark, folder), 1, "return_1d")
    .join(E.trailing_return(bars(spark, folder), 5, "return_5d"), ["ts_code", "trade_date"])
    .join(E.trailing_return(bars(spark, folder), 20, "return_20d"), ["ts_code", "trade_date"])
    .join(E.trailing_return(bars(spark, folder), 60, "return_60d"), ["ts_code", "trade_date"])
)

query(
    "information_coefficient",
    "factor_name trade_date sample_size",
    {"ic_pearson": 6, "ic_spearman": 6, "factor_mean": 4, "factor_std": 5, "return_mean": 4, "return_std": 5},
    "SELECT * FROM ic",
    ("ic",),
)(coefficients)



def beta_integral_sql(y: str, p: str, q: str, terms: int = 600) -> str:
    """The regularised incomplete beta integral up to y, as its power series; y below 1."""
    # Logarithms are added before exp, as the factor may be too small and the terms too large for a double.
    term = f"exp(({p} + n) * ln({y}) + {q} * ln(1 - {y}) + lgamma({p} + {q} + n) - lgamma({q}) - lgamma({p} + 1 + n))"
    return f"CASE WHEN {y} <= 0 THEN 0 ELSE list_sum(list_transform(generate_series(0, {terms}), lambda n: {term})) END"


def correlation_p_sql(r: str, n: str) -> str:
    """Two-sided p-value of a correlation of n pairs; that of exactly 1 is 0."""
    square, half = f"({r} * {r})", f"(({n} - 2) / 2.0)"
    # Each series where it is short: the lower one for small squares, the upper tail's for large ones.
    low, high = beta_integral_sql(square, "0.5", half, 300), beta_integral_sql(f"(1 - {square})", half, "0.5", 300)
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {square} >= 1 THEN 0 WHEN {square} < 0.5 THEN 1 - {low} ELSE {high} END"


view("ic_p", f"SELECT *, {correlation_p_sql('ic_pearson', 'sample_size')} AS p_value_pearson, {correlation_p_sql('ic_spearman', 'sample_size')} AS p_value_spearman FROM ic", "ic")
query("information_coefficient_p_values", "factor_name trade_date", "ic_pearson ic_spearman p_value_pearson p_value_spearman", "SELECT * FROM ic_p", ("ic_p",))(
    lambda spark, folder: E.with_p_values(coefficients(spark, folder))
)

_skew, _kurt = "skewness(ic)", "kurtosis(ic)"
query(
    "ic_statistics",
    "factor_name kind periods",
    "mean std abs_mean positive_ratio max min skewness kurtosis",
    f"""SELECT factor_name, kind, count(ic) AS periods, avg(ic) AS mean, stddev_samp(ic) AS std, avg(abs(ic)) AS abs_mean,
               count(*) FILTER (ic > 0) / count(ic) AS positive_ratio, max(ic) AS max, min(ic) AS min, {_skew} AS skewness, {_kurt} AS kurtosis
        FROM (SELECT factor_name, 'pearson' AS kind, ic_pearson AS ic FROM ic UNION ALL SELECT factor_name, 'spearman', ic_spearman FROM ic) GROUP BY 1, 2""",
    ("ic",),
)(lambda spark, folder: E.ic_statistics(E.with_p_values(coefficients(spark, folder))))

query(
    "ic_coverage",
    "factor_name total_periods min_sample_size max_sample_size",
    "avg_sample_size",
    "SELECT factor_name, count(*) AS total_periods, avg(sample_size) AS avg_sample_size, min(sample_size) AS min_sample_size, max(sample_size) AS max_sample_size FROM ic GROUP BY 1",
    ("ic",),
)(lambda spark, folder: E.ic_coverage(coefficients(spark, folder)))

_wf = "(PARTITION BY factor_name ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_full = f"CASE WHEN count(ic_pearson) OVER {_wf} = 20 THEN"
view(
    "ir",
    f"""SELECT *, m / nullif(s, 0) AS ir FROM (SELECT factor_name, trade_date, ic_pearson AS ic,
               {_full} avg(ic_pearson) OVER {_wf} END AS m, {_full} stddev_samp(ic_pearson) OVER {_wf} END AS s,
               CASE WHEN ic_pearson IS NOT NULL THEN sum(ic_pearson) OVER (PARTITION BY factor_name ORDER BY trade_date ROWS UNBOUNDED PRECEDING) END AS c FROM ic)""",
    "ic",
)
query(
    "information_ratio",
    "factor_name trade_date",
    "ic_mean ic_std ir ic_cumsum ic_t_stat ir_ci_lower ir_ci_upper",
    """SELECT factor_name, trade_date, m AS ic_mean, s AS ic_std, ir, c AS ic_cumsum, ir * sqrt(20) AS ic_t_stat,
              ir - 2.0930240544 / sqrt(20) AS ir_ci_lower, ir + 2.0930240544 / sqrt(20) AS ir_ci_upper FROM ir""",
    ("ir",),
)(lambda spark, folder: E.information_ratio(coefficients(spark, folder)))
query(
    "ir_statistics",
    "factor_name",
    "ir_mean ir_std ir_max ir_min ir_positive_ratio ir_significant_ratio ir_stability final_ir ic_cumsum_final ic_cumsum_max ic_cumsum_min",
    """SELECT factor_name, avg(ir) AS ir_mean, stddev_samp(ir) AS ir_std, max(ir) AS ir_max, min(ir) AS ir_min,
              count(*) FILTER (ir > 0) / count(ir) AS ir_positive_ratio, count(*) FILTER (abs(ir) > 1.96) / count(ir) AS ir_significant_ratio,
              1 - stddev_samp(ir) / avg(abs(ir)) AS ir_stability, arg_max(ir, trade_date) FILTER (ir IS NOT NULL) AS final_ir,
              arg_max(c, trade_date) FILTER (c IS NOT NULL) AS ic_cumsum_final, max(c) AS ic_cumsum_max, min(c) AS ic_cumsum_min FROM ir GROUP BY 1""",
    ("ir",),
)(lambda spark, folder: E.ir_statistics(E.information_ratio(coefficients(spark, folder))))

_o = "OVER (PARTITION BY factor_name, trade_date)"
_edges = ", ".join(f"quantile_cont(v, {i / 5!r}) {_o}" for i in range(6))
view(
    "layers",
    f"""SELECT factor_name, trade_date, CAST(1 + len(list_filter(inner_edges, lambda e: e < v)) AS INTEGER) AS factor_quantile, r FROM (
        SELECT *, CASE WHEN len(edges) > 2 THEN edges[2:len(edges) - 1] ELSE [] END AS inner_edges FROM (
          SELECT *, list_sort(list_distinct([{_edges}])) AS edges, count(*) {_o} AS n FROM fpairs WHERE v IS NOT NULL AND r IS NOT NULL) WHERE n >= 10)""",
    "fpairs",
)
view(
    "layered",
    'SELECT factor_name, trade_date, factor_quantile, avg(r) AS mean, stddev_samp(r) AS std, count(r) AS "count", median(r) AS median FROM layers GROUP BY 1, 2, 3',
    "layers",
)
view(
    "layer_perf",
    """SELECT factor_name, factor_quantile, round(avg(mean), 6) AS avg_return, round(stddev_samp(mean), 6) AS return_volatility,
              round(avg("count"), 6) AS avg_stock_count FROM layered GROUP BY 1, 2""",
    "layered",
)


def layered(spark, folder):
    return E.layered_returns(pairs(spark, folder), 5)


query("layered_backtest", "factor_name trade_date factor_quantile count", "mean std median", "SELECT * FROM layered", ("layered",))(layered)
query("layer_performance", "factor_name factor_quantile", "avg_return return_volatility avg_stock_count", "SELECT * FROM layer_perf", ("layer_perf",), digits=5)(
    lambda spark, folder: E.layer_performance(layered(spark, folder))
)
query(
    "long_short",
    "factor_name layers",
    "long_short_return long_short_volatility sharpe_ratio monotonicity top_layer_return bottom_layer_return",
    """SELECT *, long_short_return / long_short_volatility AS sharpe_ratio FROM (
         SELECT factor_name, count(*) AS layers, arg_max(avg_return, factor_quantile) AS top_layer_return, arg_min(avg_return, factor_quantile) AS bottom_layer_return,
                arg_max(avg_return, factor_quantile) - arg_min(avg_return, factor_quantile) AS long_short_return,
                sqrt(pow(arg_max(return_volatility, factor_quantile), 2) + pow(arg_min(return_volatility, factor_quantile), 2)) AS long_short_volatility,
                corr(factor_quantile, rk) AS monotonicity
         FROM (SELECT *, rank() OVER (PARTITION BY factor_name ORDER BY avg_return) AS rk FROM layer_perf) GROUP BY 1)""",
    ("layer_perf",),
    digits=4,
)(lambda spark, folder: E.long_short(E.layer_performance(layered(spark, folder))))
query(
    "layer_variance_test",
    "factor_name df_between df_within",
    "f_statistic p_value",
    # The upper tail of F is one less the incomplete beta integral of d1 F / (d1 F + d2), here as its power series.
    """SELECT factor_name, df_between, df_within, f_statistic,
              1 - """
    + beta_integral_sql("y", "b", "a", 3000)
    + """ AS p_value
       FROM (SELECT *, df_within / 2.0 AS a, df_between / 2.0 AS b, df_between * f_statistic / (df_between * f_statistic + df_within) AS y FROM (
         SELECT factor_name, k - 1 AS df_between, CAST(nn - k AS BIGINT) AS df_within, (ssb / (k - 1)) / (ssw / (nn - k)) AS f_statistic FROM (
         SELECT factor_name, count(*) AS k, sum(n) AS nn, sum(n * pow(m - g, 2)) AS ssb, sum(ss) AS ssw FROM (
           SELECT factor_name, factor_quantile, count(*) AS n, avg(mean) AS m, sum(pow(mean, 2)) - count(*) * pow(avg(mean), 2) AS ss FROM layered GROUP BY 1, 2)
         JOIN (SELECT factor_name, avg(mean) AS g FROM layered GROUP BY 1) USING (factor_name) GROUP BY 1)))""",
    ("layered",),
    digits=5,
)(lambda spark, folder: E.with_f_p_value(E.layer_variance_test(layered(spark, folder))))

view(
    "shifted",
    """SELECT f.factor_name, k AS period, f.trade_date, f.v, p.return_1d AS r FROM (SELECT unnest(generate_series(1, 20)) AS k) ks, fpairs f
       JOIN panel p ON p.ts_code = f.ts_code AND p.trade_date = f.trade_date + CAST(k AS INTEGER) WHERE p.return_1d IS NOT NULL""",
    "fpairs",
)
view("decay_ic", _ic_sql("shifted", ["factor_name", "period", "trade_date"]), "shifted")
view(
    "decay",
    """SELECT factor_name, CAST(period AS INTEGER) AS period, avg(ic_pearson) AS avg_ic_pearson, avg(ic_spearman) AS avg_ic_spearman, stddev_samp(ic_pearson) AS ic_std_pearson,
              stddev_samp(ic_spearman) AS ic_std_spearman, abs(avg(ic_pearson)) AS abs_avg_ic_pearson, abs(avg(ic_spearman)) AS abs_avg_ic_spearman, count(*) AS n_dates
       FROM decay_ic GROUP BY 1, 2""",
    "decay_ic",
)


def wide_panel(spark, folder):
    return panel(spark, folder).select("ts_code", "trade_date", F.col("return_1d").alias("return_rate"), *FACTORS)


def decay(spark, folder):
    return E.factor_decay(wide_panel(spark, folder), None, min_pairs=10, wide=FACTORS)


query(
    "factor_decay",
    "factor_name period n_dates",
    "avg_ic_pearson avg_ic_spearman ic_std_pearson ic_std_spearman abs_avg_ic_pearson abs_avg_ic_spearman",
    "SELECT * FROM decay",
    ("decay",),
)(decay)
query(
    "decay_profile",
    "factor_name optimal_period_pearson optimal_period_spearman half_life",
    "max_abs_ic_pearson max_abs_ic_spearman decay_correlation avg_ic_volatility stability_score",
    """SELECT factor_name, arg_max(period, a) AS optimal_period_pearson, arg_max(period, b) AS optimal_period_spearman,
              coalesce(CAST(min(period) FILTER (a <= first / 2) AS BIGINT), count(*)) AS half_life, max(a) AS max_abs_ic_pearson, max(b) AS max_abs_ic_spearman,
              corr(period, a) AS decay_correlation, avg(ic_std_pearson) AS avg_ic_volatility, 1 / (1 + avg(ic_std_pearson)) AS stability_score
       FROM (SELECT *, abs_avg_ic_pearson AS a, abs_avg_ic_spearman AS b, first_value(abs_avg_ic_pearson) OVER (PARTITION BY factor_name ORDER BY period) AS first FROM decay)
       GROUP BY 1""",
    ("decay",),
)(lambda spark, folder: E.decay_profile(decay(spark, folder)))


def _matrix_sql(cells):
    body = " UNION ALL ".join(f"SELECT '{a}' AS factor_1, '{b}' AS factor_2, {e} AS correlation FROM {src}" for a, b, e, src in cells)
    return body


_cells = [(a, b, f"corr({a}, {b})" if a != b else "any_value(1.0)", "panel") for a in FACTORS for b in FACTORS]
view("cmatrix", _matrix_sql(_cells), "panel")


def _rank_src(a, b):
    return f"""(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y
               FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


_scells = [(a, b, "corr(x, y)" if a != b else "any_value(1.0)", _rank_src(a, b)) for a in FACTORS for b in FACTORS]
query("correlation_pearson", "factor_1 factor_2", "correlation", "SELECT * FROM cmatrix", ("cmatrix",))(lambda s, f: E.correlation_matrix(panel(s, f), FACTORS))
query("correlation_spearman", "factor_1 factor_2", "correlation", _matrix_sql(_scells), ("panel",))(lambda s, f: E.correlation_matrix(panel(s, f), FACTORS, "spearman"))


def _kendall_sql(a: str, b: str) -> str:
    """Tau-b by bits: of two rows, the highest bit in which their places of b differ counts them, once."""
    return f"""SELECT '{a}' AS factor_1, '{b}' AS factor_2, (agree - against) / sqrt((n * (n - 1) / 2 - tied_a) * (n * (n - 1) / 2 - tied_b)) AS correlation FROM (
        SELECT sum(c1 * coalesce(sum_c0, 0)) AS agree, sum(c0 * coalesce(sum_c1, 0)) AS against FROM (
          SELECT c0, c1, sum(c0) OVER w AS sum_c0, sum(c1) OVER w AS sum_c1 FROM (
            SELECT l, pb >> (l + 1) AS block, pa, count(*) FILTER ((pb >> l) & 1 = 0)::DOUBLE AS c0, count(*) FILTER ((pb >> l) & 1 = 1)::DOUBLE AS c1
            FROM places_{a}_{b}, (SELECT unnest(generate_series(0, 40)) AS l) levels WHERE l <= (SELECT ceil(log2(max(pb) + 1)) FROM places_{a}_{b}) GROUP BY ALL)
          WINDOW w AS (PARTITION BY l, block ORDER BY pa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) c,
        (SELECT count(*)::DOUBLE AS n, sum(ta - 1) / 2 AS tied_a, sum(tb - 1) / 2 AS tied_b FROM places_{a}_{b}) t"""


_kpairs = [(a, b) for k, a in enumerate(FACTORS) for b in FACTORS[k + 1 :]]
for _a, _b in _kpairs:
    view(
        f"places_{_a}_{_b}",
        f"""SELECT rank() OVER (ORDER BY {_a}) - 1 AS pa, rank() OVER (ORDER BY {_b}) - 1 AS pb, count(*) OVER (PARTITION BY {_a}) AS ta, count(*) OVER (PARTITION BY {_b}) AS tb
            FROM panel WHERE {_a} IS NOT NULL AND {_b} IS NOT NULL""",
        "panel",
    )
view("kendall", " UNION ALL ".join(_kendall_sql(a, b) for a, b in _kpairs), *(f"places_{a}_{b}" for a, b in _kpairs))
query(
    "correlation_kendall",
    "factor_1 factor_2",
    "correlation",
    "SELECT * FROM kendall UNION ALL SELECT factor_2, factor_1, correlation FROM kendall UNION ALL SELECT f, f, 1.0 FROM (SELECT unnest(" + str(FACTORS) + ") AS f) x",
    ("kendall",),
)(lambda s, f: E.correlation_matrix(panel(s, f), FACTORS, "kendall"))
_wr = f"({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
query(
    "rolling_correlation",
    "ts_code trade_date",
    "corr_volr_rng",
    f"SELECT ts_code, trade_date, CASE WHEN row_number() OVER ({W}) > 60 THEN corr(volr, rng) OVER {_wr} END AS corr_volr_rng FROM panel",
    ("panel",),
)(lambda s, f: E.rolling_pair_correlation(panel(s, f), ["volr", "rng"]))
query(
    "high_correlations",
    "factor_1 factor_2",
    "correlation abs_correlation",
    "SELECT *, abs(correlation) AS abs_correlation FROM cmatrix WHERE factor_1 < factor_2 AND abs(correlation) >= 0.01",
    ("cmatrix",),
)(lambda s, f: E.high_correlations(E.correlation_matrix(panel(s, f), FACTORS), 0.01))
query(
    "factor_independence",
    "factor_name",
    "independence",
    "SELECT factor_1 AS factor_name, 1 - avg(abs(correlation)) AS independence FROM cmatrix WHERE factor_1 <> factor_2 GROUP BY 1",
    ("cmatrix",),
)(lambda s, f: E.independence(E.correlation_matrix(panel(s, f), FACTORS)))
query(
    "effectiveness_data_summary",
    "factor_records factor_stocks first_date last_date return_records return_stocks matched_records effective_stocks effective_periods",
    "missing_ratio avg_return return_volatility coverage_ratio",
    """SELECT *, matched_records / greatest(factor_records, return_records) AS coverage_ratio FROM
        (SELECT count(*) AS factor_records, count(DISTINCT ts_code) AS factor_stocks, min(trade_date) AS first_date, max(trade_date) AS last_date,
                (count(*) - count(mom)) / (3.0 * count(*)) AS missing_ratio FROM panel),
        (SELECT count(*) AS return_records, count(DISTINCT ts_code) AS return_stocks, avg(return_1d) AS avg_return, stddev_samp(return_1d) AS return_volatility FROM panel WHERE return_1d IS NOT NULL),
        (SELECT count(*) AS matched_records, count(DISTINCT ts_code) AS effective_stocks, count(DISTINCT trade_date) AS effective_periods FROM panel WHERE return_1d IS NOT NULL)""",
    ("panel",),
)(lambda s, f: E.data_summary(panel(s, f).select("ts_code", "trade_date", "mom"), returns(s, f).where(F.col("return_rate").isNotNull())))


def report(spark, folder):
    return reports.factor_report(wide_panel(spark, folder), None, layers=5, wide=FACTORS)


_long_short_sql = """SELECT *, long_short_return / nullif(long_short_volatility, 0) AS sharpe_ratio FROM (
         SELECT factor_name, count(*) AS layers, arg_max(avg_return, factor_quantile) - arg_min(avg_return, factor_quantile) AS long_short_return,
                sqrt(pow(arg_max(return_volatility, factor_quantile), 2) + pow(arg_min(return_volatility, factor_quantile), 2)) AS long_short_volatility, corr(factor_quantile, rk) AS monotonicity
         FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY factor_name, avg_return) - 1) / 2.0 AS rk FROM layer_perf WINDOW w AS (PARTITION BY factor_name ORDER BY avg_return)) GROUP BY 1)"""
view(
    "fades",
    f"""SELECT *, {correlation_p_sql('trend', 'periods')} AS p FROM (
          SELECT factor_name, count(*) AS periods, arg_max(period, a) AS best, corr(period, a) AS trend FROM (SELECT factor_name, period, abs_avg_ic_pearson AS a FROM decay) GROUP BY 1)""",
    "decay",
)
view(
    "rated",
    f"""SELECT factor_name, ic_score, ir_score, layered_score, decay_score, round(total, 2) AS score,
               CASE WHEN total >= 80 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 50 THEN 'D' ELSE 'F' END AS grade FROM (
          SELECT *, (ic_score * 0.3 + ir_score * 0.25 + layered_score * 0.25 + decay_score * 0.2) / 4 AS total
          FROM (SELECT factor_name, least(100, abs(avg(ic_pearson)) * 1000 + count(*) FILTER (ic_pearson > 0) / count(ic_pearson) * 20 + count(*) FILTER (p_value_pearson < 0.05) / count(*) * 30) AS ic_score FROM ic_p GROUP BY 1) i
          JOIN (SELECT factor_name, least(100, abs(arg_max(ir, trade_date) FILTER (ir IS NOT NULL)) * 20 + count(*) FILTER (ir > 0) / count(ir) * 50) AS ir_score FROM ir GROUP BY 1) r USING (factor_name)
          JOIN (SELECT factor_name, least(50, abs(sharpe_ratio) * 25) + CASE WHEN monotonicity > 0.5 AND {correlation_p_sql('monotonicity', 'layers')} < 0.05 THEN 50 ELSE coalesce(monotonicity, 0) * 25 END AS layered_score
                FROM ({_long_short_sql})) l USING (factor_name)
          JOIN (SELECT factor_name, CASE WHEN best <= 5 THEN 50 WHEN best <= 10 THEN 30 ELSE 10 END
                       + CASE WHEN p >= 0.05 THEN 10 WHEN trend < -0.5 THEN 10 WHEN trend < -0.2 THEN 30 ELSE 50 END AS decay_score FROM fades) d USING (factor_name))""",
    "ic_p",
    "ir",
    "layer_perf",
    "fades",
)
query("factor_rating", "factor_name grade", "ic_score ir_score layered_score decay_score score", "SELECT * FROM rated", ("rated",), digits=2)(report)
query(
    "factor_ranking",
    "factor_name rank grade grade_count advice",
    "score average_score",
    """SELECT *, count(*) OVER (PARTITION BY grade) AS grade_count, round(avg(score) OVER (), 2) AS average_score,
              CASE WHEN avg(score) OVER () >= 70 THEN 'use directly' WHEN avg(score) OVER () >= 50 THEN 'combine with others' ELSE 'use with care' END AS advice
       FROM (SELECT factor_name, grade, score, CAST(row_number() OVER (ORDER BY score DESC, factor_name) AS INTEGER) AS rank FROM rated) WHERE rank <= 2""",
    ("rated",),
    digits=2,
)(lambda s, f: E.recommendation(E.rank_factors(report(s, f)), 2))
query("processed_factors", "factor_name ts_code trade_date", "factor_value", "SELECT * FROM processed", ("processed",))(
    lambda s, f: reports.processed_long(reports.process_factors(panel(s, f), ["mom", "rng"]), ["mom", "rng"])
)
