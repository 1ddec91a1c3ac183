"""Registry of named queries with the SQL that states the same result.

A registered function returns a DataFrame over whole tables; results are rounded here, and only
here, so that sums taken in different orders compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

W = "PARTITION BY ts_code ORDER BY trade_date"

# Views over the base tables, in SQL, in order of dependence.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trades": (
        (),
        """SELECT l_suppkey AS ts_code, CAST(l_shipdate AS DATE) AS trade_date,
                  l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS e,
                  l_orderkey * 100 + l_linenumber AS seq FROM lineitem""",
    ),
    "daily": (
        ("trades",),
        """SELECT ts_code, trade_date, arg_min(p, seq) AS open, max(p) AS high, min(p) AS low,
                  arg_max(p, seq) AS "close", sum(q) AS vol, sum(e) AS amount
           FROM trades GROUP BY 1, 2""",
    ),
    "bars": (("daily",), f'SELECT *, lag("close") OVER ({W}) AS pre_close FROM daily'),
    "rets": (
        ("bars",),
        f'SELECT *, "close" / nullif(lag("close") OVER ({W}), 0) - 1 AS ret FROM bars',
    ),
    "basic": (
        (),
        """SELECT s_suppkey AS ts_code, s_name AS name, r_name AS industry, n_name AS area,
                  CASE WHEN s_acctbal < 0 THEN 'D' ELSE 'L' END AS list_status, s_acctbal AS acctbal
           FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) nr
             ON s_nationkey = n_nationkey""",
    ),
    "valued": (
        ("bars",),
        f"""SELECT *, sum(amount) OVER ({W} ROWS UNBOUNDED PRECEDING) AS total_mv,
                   0.6 * sum(amount) OVER ({W} ROWS UNBOUNDED PRECEDING) AS circ_mv,
                   vol * 100 / sum(vol) OVER ({W} ROWS UNBOUNDED PRECEDING) AS turnover_rate FROM bars""",
    ),
    "calendar": ((), "SELECT DISTINCT CAST(l_shipdate AS DATE) AS cal_date, 1 AS is_open FROM lineitem"),
    "quarterly": (
        (),
        """SELECT o_custkey % (SELECT count(*) FROM supplier) AS ts_code,
                  last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS end_date,
                  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) AS f,
                  sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END) AS o,
                  sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.0 END) AS p
           FROM orders GROUP BY 1, 2""",
    ),
    "statements": (
        ("quarterly",),
        """SELECT *, total_assets - total_liab AS total_hldr_eqy_exc_min_int, total_liab * -0.02 AS fin_exp FROM (
           SELECT ts_code, end_date, CAST(end_date + 30 AS DATE) AS ann_date, '1' AS report_type,
                  f + o + p AS revenue, f * 0.7 + o * 0.6 + p * 0.65 AS oper_cost,
                  f * 0.2 + o * 0.3 + p * 0.25 AS operate_profit, f * 0.2 + o * 0.1 - p * 0.15 AS net_profit,
                  (f + o + p) * 3 + 500000.0 AS total_assets, (f + o + p) * 1.2 + o * 0.4 + 100000.0 AS total_liab,
                  (f + o + p) * 1.1 AS total_cur_assets, f * 0.8 + o * 0.5 + p * 0.3 AS total_cur_liab,
                  CASE WHEN o > 0 THEN o * 0.2 END AS inventories, f * 0.25 AS money_cap,
                  f * 0.3 - p * 0.05 AS operating_cash_flow, f * 0.28 + o * 0.38 + p * 0.33 AS ebitda FROM quarterly)""",
    ),
}


def view(name: str, sql: str, *needs: str) -> str:
    """Add a view to the SQL side."""
    VIEWS[name] = (needs, sql)
    return name


def with_views(body: str, needs) -> str:
    order: list[str] = []

    def visit(n):
        for m in VIEWS[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED (\n{VIEWS[n][1]}\n)" for n in order)
    return f"WITH {head}\n{body}"


def joined(*names: str, using: str = "ts_code, trade_date") -> str:
    """The SQL of several queries side by side."""
    first, *rest = names
    return f"SELECT * FROM ({ORACLES[first]}) " + " ".join(f"JOIN ({ORACLES[n]}) USING ({using})" for n in rest)


def roll(agg: str, x: str, n: int, w: str = W) -> str:
    """A rolling aggregate that is null until its frame is full."""
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


def _digits(vals, digits: int) -> dict[str, int]:
    return dict(vals) if isinstance(vals, dict) else {v: digits for v in vals}


def publish(df: DataFrame, keys: list[str], vals, digits: int = 6) -> DataFrame:
    rounded = [(F.round(F.col(c).cast("double"), d) + F.lit(0.0)).alias(c) for c, d in _digits(vals, digits).items()]
    return df.select(*keys, *rounded)


def cells(pivoted: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """A pivoted table as one row for each cell, empty ones included, so that its columns can come from the data."""
    rest = [c for c in pivoted.columns if c not in keys]
    return pivoted.unpivot(keys, rest, column, value).withColumn(column, F.col(column).cast("int"))


def query(name: str, keys: str, vals="", body: str | None = None, needs=("bars",), digits: int = 6):
    """Register a query; ``body`` is SQL over ``needs`` that yields at least the same columns."""
    key_list = keys.split()
    val_map = _digits(vals.split() if isinstance(vals, str) else vals, digits)

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: publish(fn(spark, folder), key_list, val_map)
        if body is not None:
            cols = ", ".join([f'"{k}"' for k in key_list] + [f'CASE WHEN isfinite(CAST("{c}" AS DOUBLE)) THEN round(CAST("{c}" AS DOUBLE), {d}) + 0.0 END AS "{c}"' for c, d in val_map.items()])
            ORACLES[name] = with_views(f"SELECT {cols} FROM (\n{body}\n) AS result", needs)
        return fn

    return add
