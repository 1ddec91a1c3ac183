"""Statement factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.catalog.base import query, roll, view
from alphaloom.operators import fundamental as Fu
from alphaloom.operators import joins as J
from alphaloom.sources.tables import daily_basic, statements

KEYS = "ts_code end_date"
Q = "PARTITION BY ts_code ORDER BY end_date"
EQ = "total_hldr_eqy_exc_min_int"


def _band(x, lo, hi, op=">"):
    return f"CASE WHEN ({x}) {op} {lo} AND ({x}) < {hi} THEN ({x}) END"


def _over(fn):
    return lambda spark, folder: fn(statements(spark, folder))


def _exprs(e):
    return f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in e.items())} FROM statements"


_ttm = {f"{c}_ttm": roll("sum", c, 4, Q) for c in ("net_profit", "revenue", "operating_cash_flow", "ebitda")}
query("fundamental_ttm", KEYS, {c: 4 for c in _ttm}, _exprs(_ttm), needs=("statements",))(_over(Fu.with_ttm))


def _chg(c, n):
    return f"({c} / nullif(lag({c}, {n}) OVER ({Q}), 0) - 1) * 100"


def _cagr(c):
    base = f"lag({c}, 12) OVER ({Q})"
    return f"CASE WHEN {base} > 0 AND {c} / {base} >= 0 THEN (pow({c} / {base}, 4.0 / 12.0) - 1) * 100 END"


_growth = {
    "revenue_yoy": _band(_chg("revenue", 4), -100, 1000),
    "revenue_qoq": _band(_chg("revenue", 1), -100, 1000),
    "net_profit_yoy": _band(_chg("net_profit", 4), -1000, 1000),
    "net_profit_qoq": _band(_chg("net_profit", 1), -1000, 1000),
    "revenue_cagr_3y": _cagr("revenue"),
    "net_profit_cagr_3y": _cagr("net_profit"),
}
query("fundamental_growth", KEYS, list(_growth), _exprs(_growth), needs=("statements",))(_over(Fu.growth))


def _clip(x):
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(-100, least(100, ({x}))) END"


_profit = {
    "roe": _clip(f"net_profit / nullif({EQ}, 0) * 100"),
    "roa": _clip("net_profit / nullif(total_assets, 0) * 100"),
    "roic": _band("operate_profit / nullif(total_assets - total_cur_liab * 0.5, 0) * 100", -50, 50),
    "gross_margin": _band("(revenue - oper_cost) / nullif(revenue, 0) * 100", -100, 100),
    "net_margin": _band("net_profit / nullif(revenue, 0) * 100", -100, 100),
    "operating_margin": _band("operate_profit / nullif(revenue, 0) * 100", -100, 100),
}
query("fundamental_profitability", KEYS, list(_profit), _exprs(_profit), needs=("statements",))(_over(Fu.profitability))

_sound = {
    "debt_to_equity": _band(f"total_liab / nullif({EQ}, 0)", 0, 10, ">="),
    "current_ratio": _band("total_cur_assets / nullif(total_cur_liab, 0)", 0, 20, ">="),
    "quick_ratio": _band("(total_cur_assets - coalesce(inventories, 0)) / nullif(total_cur_liab, 0)", 0, 20, ">="),
    "cash_ratio": _band("money_cap / nullif(total_cur_liab, 0)", 0, 10, ">="),
    "asset_turnover": _band("revenue / nullif(total_assets, 0)", 0, 10, ">="),
    "interest_coverage": _band("operate_profit / nullif(abs(fin_exp), 0)", 0, 1000),
}
query("fundamental_soundness", KEYS, list(_sound), _exprs(_sound), needs=("statements",))(_over(Fu.soundness))

query(
    "fundamental_percent_ratios",
    KEYS,
    "gross_margin_pct net_margin_pct debt_to_equity_pct current_ratio_raw quick_ratio_raw",
    _exprs(
        {
            "gross_margin_pct": "(revenue - oper_cost) / nullif(revenue, 0) * 100",
            "net_margin_pct": "net_profit / nullif(revenue, 0) * 100",
            "debt_to_equity_pct": f"total_liab / nullif({EQ}, 0) * 100",
            "current_ratio_raw": "total_cur_assets / nullif(total_cur_liab, 0)",
            "quick_ratio_raw": "(total_cur_assets - coalesce(inventories, 0)) / nullif(total_cur_liab, 0)",
        }
    ),
    needs=("statements",),
)(_over(Fu.percent_ratios))

view("ttm", _exprs({**_ttm, "net_profit_yoy": _growth["net_profit_yoy"]}), "statements")
_val = {
    "pe_ttm": _band("total_mv / nullif(net_profit_ttm, 0)", 0, 1000),
    "pb": _band(f"total_mv / nullif({EQ}, 0)", 0, 100),
    "ps_ttm": _band("total_mv / nullif(revenue_ttm, 0)", 0, 100),
    "pcf_ttm": _band("total_mv / nullif(operating_cash_flow_ttm, 0)", 0, 1000),
    "ev_ebitda": _band("total_mv / nullif(ebitda_ttm, 0)", 0, 1000),
}
_peg = "SELECT *, {} AS peg FROM (".format(_band("pe_ttm / nullif(net_profit_yoy * 100, 0)", 0, 10))
_valued = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in _val.items())} FROM "


@query(
    "fundamental_valuation",
    "ts_code trade_date end_date",
    "pe_ttm pb ps_ttm pcf_ttm ev_ebitda peg",
    _peg + _valued + """(SELECT v.ts_code, v.trade_date, v.total_mv, t.* EXCLUDE (ts_code) FROM valued v
        ASOF LEFT JOIN ttm t ON v.ts_code = t.ts_code AND v.trade_date >= t.ann_date))""",
    needs=("valued", "ttm"),
)
def valuation_point_in_time(spark, folder):
    """Multiples of each day against the latest report announced by then."""
    market = daily_basic(spark, folder).select("ts_code", "trade_date", "total_mv")
    reports = Fu.growth(Fu.with_ttm(statements(spark, folder)))
    return Fu.valuation(J.as_of(market, reports, "trade_date", "ann_date"))


@query(
    "fundamental_valuation_all_reports",
    "ts_code end_date n_days",
    {"mean_pb": 6, "max_pe": 6},
    f"""SELECT ts_code, end_date, count(*) AS n_days, avg(pb) AS mean_pb, max(pe_ttm) AS max_pe FROM (
        {_valued} (SELECT v.ts_code, v.trade_date, v.total_mv, t.* EXCLUDE (ts_code) FROM valued v LEFT JOIN ttm t ON v.ts_code = t.ts_code))
        GROUP BY 1, 2""",
    needs=("valued", "ttm"),
)
def valuation_every_report(spark, folder):
    """The fan-out form: every day against every report, rolled up per report."""
    market = daily_basic(spark, folder).select("ts_code", "trade_date", "total_mv")
    pairs = Fu.valuation(J.every_report(market, Fu.with_ttm(statements(spark, folder))))
    return pairs.groupBy("ts_code", "end_date").agg(
        F.count("*").alias("n_days"), F.avg("pb").alias("mean_pb"), F.max("pe_ttm").alias("max_pe")
    )


@query(
    "statement_scan",
    "ts_code end_date report_type",
    {"revenue": 4, "total_assets": 4},
    """SELECT i.ts_code, i.end_date, i.report_type, i.revenue, b.total_assets
       FROM (SELECT * FROM statements WHERE report_type = '1') i
       LEFT JOIN (SELECT * FROM statements WHERE total_assets > 3000000) b USING (ts_code, end_date, report_type)""",
    needs=("statements",),
)
def statement_scan(spark, folder):
    """Income statements with the balance sheet of the same code, period and type when there is one."""
    st = statements(spark, folder)
    income = st.where(F.col("report_type") == "1").select("ts_code", "end_date", "report_type", "revenue")
    balance = st.where(F.col("total_assets") > 3000000).select("ts_code", "end_date", "report_type", "total_assets")
    return income.join(balance, ["ts_code", "end_date", "report_type"], "left")
