"""Scans, filters, limits, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog.base import query, view
from alphaloom.functions import scalars as C
from alphaloom.functions import sqlfuncs
from alphaloom.operators import joins as J
from alphaloom.sources import scans as S
from alphaloom.sources.pages import Pages
from alphaloom.sources.tables import bars, calendar, daily_basic, industry_members, panel, statements, stock_basic, table

CLOSE = '"close"'
BAR = {c: 8 for c in ("open", "high", "low", "close")}

query(
    "daily_bars",
    "ts_code trade_date",
    {**BAR, "vol": 2, "amount": 2, "pre_close": 8},
    "SELECT * FROM bars",
)(bars)
query(
    "stock_data_scan",
    "ts_code trade_date",
    {"close": 8, "vol": 2},
    "SELECT ts_code, trade_date, \"close\", vol FROM bars WHERE ts_code = 7 AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' ORDER BY trade_date, ts_code LIMIT 50",
)(lambda s, f: S.stock_data(bars(s, f), 7, "1997-01-01", "1998-12-31", 50, ["close", "vol"]))
query("stock_list", "ts_code", "", "SELECT DISTINCT ts_code FROM basic WHERE list_status = 'L'", ("basic",))(lambda s, f: S.stock_list(stock_basic(s, f)))
query("open_trading_days", "cal_date", "", "SELECT cal_date FROM calendar WHERE is_open = 1 AND cal_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", ("calendar",))(
    lambda s, f: S.open_days(calendar(s, f), "1997-01-01", "1997-12-31")
)


def long(spark, folder):
    return panel(spark, folder).unpivot(["ts_code", "trade_date"], ["mom", "volr", "rng"], "factor_name", "factor_value").where("factor_value IS NOT NULL")


query(
    "factor_scan",
    "ts_code trade_date",
    {"mom": 8, "rng": 8},
    "SELECT ts_code, trade_date, mom, rng FROM panel WHERE (mom IS NOT NULL OR rng IS NOT NULL) AND trade_date >= DATE '1997-01-01' AND ts_code IN (1, 2, 3, 5, 8)",
    ("panel",),
)(lambda s, f: S.factor_data(long(s, f), ["mom", "rng"], "1997-01-01", None, [1, 2, 3, 5, 8]))
query("market_cap_scan", "ts_code trade_date", {"market_cap": 2}, "SELECT ts_code, trade_date, total_mv AS market_cap FROM valued WHERE trade_date >= DATE '2000-01-01'", ("valued",))(
    lambda s, f: S.market_caps(daily_basic(s, f), "2000-01-01")
)
query(
    "optional_predicates",
    "ts_code trade_date",
    {"close": 8},
    "SELECT ts_code, trade_date, \"close\" FROM bars WHERE ts_code IN (3, 9) AND trade_date <= DATE '1999-12-31'",
)(lambda s, f: S.where_given(bars(s, f), {"ts_code": None}, {"ts_code": [3, 9]}, {"trade_date": None}, {"trade_date": "1999-12-31"}))
query(
    "stock_attributes",
    "ts_code trade_date industry area",
    {"mom": 8},
    "SELECT p.ts_code, p.trade_date, p.mom, b.industry, b.area FROM panel p LEFT JOIN (SELECT * FROM basic WHERE list_status = 'L') b USING (ts_code)",
    ("panel", "basic"),
)(lambda s, f: panel(s, f).drop("industry").join(stock_basic(s, f).where(F.col("list_status") == "L").select("ts_code", "industry", "area"), "ts_code", "left"))
query("range_to_null", "ts_code trade_date", {"x": 8}, "SELECT ts_code, trade_date, CASE WHEN mom > -50 AND mom < 50 THEN mom END AS x FROM panel", ("panel",))(
    lambda s, f: panel(s, f).withColumn("x", C.band("mom", -50, 50))
)
query("clip_bounds", "ts_code trade_date", {"x": 8}, "SELECT ts_code, trade_date, CASE WHEN mom IS NOT NULL THEN greatest(least(mom, 50), -50) END AS x FROM panel", ("panel",))(
    lambda s, f: panel(s, f).withColumn("x", C.clip("mom", -50.0, 50.0))
)
query("drop_null_rows", "ts_code trade_date", "", "SELECT ts_code, trade_date FROM panel WHERE mom IS NOT NULL AND volr IS NOT NULL", ("panel",))(
    lambda s, f: panel(s, f).dropna(how="any", subset=["mom", "volr"])
)
query("drop_empty_rows", "ts_code trade_date", "", "SELECT ts_code, trade_date FROM panel WHERE mom IS NOT NULL OR return_5d IS NOT NULL OR volr IS NOT NULL", ("panel",))(
    lambda s, f: panel(s, f).dropna(how="all", subset=["mom", "return_5d", "volr"])
)
query(
    "prediction_inputs",
    "ts_code trade_date",
    {"mom": 8, "volr": 9, "absent": 1},
    "SELECT ts_code, trade_date, coalesce(mom, 0) AS mom, coalesce(volr, 0) AS volr, 0.0 AS absent FROM panel",
    ("panel",),
)(lambda s, f: S.missing_columns(panel(s, f), ["mom", "volr", "absent"]))


def catalogue(spark, folder):
    """Parts as a factor catalogue: brand as category, words of the type as tags."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("factor_id"),
        F.col("p_name").alias("factor_name"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("category"),
        F.when(F.col("p_size") < 20, "technical").otherwise("fundamental").alias("factor_type"),
        F.split("p_type", " ").alias("tags"),
    )


@query(
    "search_factors",
    "factor_id factor_name",
    "",
    """SELECT p_partkey AS factor_id, p_name AS factor_name FROM part WHERE (p_name ILIKE '%a%' OR p_type ILIKE '%a%') AND p_size < 20
       AND list_has_any(string_split(p_type, ' '), (SELECT list(w) FROM (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS w FROM part ORDER BY w LIMIT 2)))""",
    (),
)
def _search(spark, folder):
    words = catalogue(spark, folder).select(F.explode("tags").alias("w")).distinct().orderBy("w").limit(2)
    return S.search_factors(catalogue(spark, folder), "A", "technical", None, [r[0] for r in words.collect()])


query("grade_by_score", "ts_code trade_date grade", "", "SELECT ts_code, trade_date, CASE WHEN rng >= 80 THEN 'A' WHEN rng >= 70 THEN 'B' WHEN rng >= 60 THEN 'C' WHEN rng >= 50 THEN 'D' ELSE 'F' END AS grade FROM panel", ("panel",))(
    lambda s, f: panel(s, f).withColumn("grade", C.grade_by_score("rng"))
)
query(
    "rule_comparison",
    "event_id rule triggered",
    "",
    """SELECT event_id, rule, CASE rule WHEN '>' THEN value > 50 WHEN '<' THEN value < 50 WHEN '>=' THEN value >= 50 WHEN '<=' THEN value <= 50 WHEN '==' THEN value = 50 WHEN '!=' THEN value <> 50 ELSE false END AS triggered
       FROM (SELECT *, CASE event_type WHEN 'error' THEN '>' WHEN 'click' THEN '<' WHEN 'view' THEN '>=' WHEN 'signup' THEN '!=' ELSE '??' END AS rule FROM events)""",
    (),
)(
    lambda s, f: table(s, f, "events").withColumn(
        "rule", F.when(F.col("event_type") == "error", ">").when(F.col("event_type") == "click", "<").when(F.col("event_type") == "view", ">=").when(F.col("event_type") == "signup", "!=").otherwise("??")
    ).withColumn("triggered", C.compare("value", F.lit(50), "rule"))
)
query(
    "security_code_check",
    "ts_code is_valid",
    "",
    """SELECT code AS ts_code, regexp_matches(code, '^[0-9]{6}\\.(SZ|SH)$') AS is_valid FROM (
         SELECT lpad(CAST(s_suppkey AS VARCHAR), CASE WHEN s_acctbal > 3000 THEN 6 ELSE 5 END, '0') || CASE WHEN s_nationkey < 10 THEN '.SZ' WHEN s_nationkey < 20 THEN '.SH' ELSE '.HK' END AS code FROM supplier)""",
    (),
)(
    lambda s, f: table(s, f, "supplier").select(
        F.concat(
            F.when(F.col("s_acctbal") > 3000, F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).otherwise(F.lpad(F.col("s_suppkey").cast("string"), 5, "0")),
            F.when(F.col("s_nationkey") < 10, ".SZ").when(F.col("s_nationkey") < 20, ".SH").otherwise(".HK"),
        ).alias("ts_code")
    ).withColumn("is_valid", C.is_security_code("ts_code"))
)


def _params(spark, folder):
    """Part sizes and prices as strategy settings."""
    p = table(spark, folder, "part")
    return p.select("p_partkey", F.lit("max_positions").alias("parameter"), F.col("p_size").cast("double").alias("value")).unionByName(
        p.select("p_partkey", F.lit("price_limit").alias("parameter"), F.col("p_retailprice").alias("value"))
    )


def _constraints(spark):
    return spark.createDataFrame(
        [("max_positions", 5.0, 40.0, None), ("price_limit", 910.0, None, None)], "parameter string, min_value double, max_value double, allowed array<double>"
    )


query(
    "config_violations",
    "p_partkey parameter reason",
    {"value": 4},
    """SELECT p_partkey, 'max_positions' AS parameter, CASE WHEN p_size < 5 THEN 'below_minimum' ELSE 'above_maximum' END AS reason, p_size AS value FROM part WHERE p_size < 5 OR p_size > 40
       UNION ALL SELECT p_partkey, 'price_limit', 'below_minimum', p_retailprice FROM part WHERE p_retailprice < 910""",
    (),
)(lambda s, f: S.config_violations(_params(s, f), _constraints(s)))

# ---- joins ----------------------------------------------------------------------------------

query(
    "as_of_statements",
    "ts_code trade_date end_date ann_date",
    {"revenue": 4},
    "SELECT b.ts_code, b.trade_date, s.end_date, s.ann_date, s.revenue FROM bars b ASOF LEFT JOIN statements s ON b.ts_code = s.ts_code AND b.trade_date >= s.ann_date",
    ("bars", "statements"),
)(lambda s, f: J.as_of(bars(s, f), statements(s, f).select("ts_code", "end_date", "ann_date", "revenue"), "trade_date", "ann_date"))
view(
    "members",
    """SELECT s.ts_code, s.industry AS industry_name, DATE '1990-01-01' AS in_date, DATE '1998-06-01' AS out_date FROM basic s
       UNION ALL SELECT s.ts_code, n.r_name, DATE '1998-06-01', NULL FROM basic s JOIN region r ON s.industry = r.r_name JOIN region n ON (r.r_regionkey + 1) % 5 = n.r_regionkey""",
    "basic",
)
query(
    "industry_on_date",
    "ts_code trade_date industry_name",
    "",
    "SELECT b.ts_code, b.trade_date, m.industry_name FROM bars b LEFT JOIN members m ON m.ts_code = b.ts_code AND m.in_date <= b.trade_date AND (m.out_date IS NULL OR b.trade_date < m.out_date)",
    ("bars", "members"),
)(lambda s, f: J.membership_on(bars(s, f).select("ts_code", "trade_date"), industry_members(s, f)))
query(
    "industry_hierarchy",
    "nation_key region nation path",
    "",
    "SELECT n_nationkey AS nation_key, r_name AS region, n_name AS nation, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
    (),
)(lambda s, f: sqlfuncs.industry_paths(s, table(s, f, "region"), table(s, f, "nation")))
view("edges", "SELECT l_orderkey AS task_id, l_orderkey // 3 AS depends_on FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey > 0")
query(
    "dependency_closure",
    "task_id root depth",
    "",
    """WITH RECURSIVE chain AS (SELECT task_id, task_id AS root, 0 AS depth FROM nodes WHERE task_id NOT IN (SELECT task_id FROM edges)
         UNION ALL SELECT e.task_id, c.root, c.depth + 1 FROM edges e JOIN chain c ON e.depends_on = c.task_id)
       SELECT task_id, root, CAST(depth AS INTEGER) AS depth FROM chain""",
    ("edges", view("nodes", "SELECT DISTINCT l_orderkey AS task_id FROM lineitem")),
)(lambda s, f: sqlfuncs.dependency_closure(*_graph(s, f)))


def _graph(spark, folder):
    """Orders as tasks, each depending on the order with a third of its key."""
    nodes = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("task_id")).distinct()
    edges = nodes.where(F.col("task_id") > 0).select("task_id", F.floor(F.col("task_id") / 3).alias("depends_on"))
    return nodes, edges


query(
    "compare_full_outer",
    "ts_code trade_date same",
    {"old_value": 8, "new_value": 8, "difference": 7, "pct_change": 6},
    """SELECT ts_code, trade_date, a AS old_value, b AS new_value, b - a AS difference, (b - a) / nullif(abs(a), 0) AS pct_change, a IS NOT DISTINCT FROM b AS same
       FROM (SELECT ts_code, trade_date, CASE WHEN trade_date < DATE '1999-01-01' THEN mom END AS a, CASE WHEN trade_date >= DATE '1997-01-01' THEN mom + rng END AS b FROM panel)""",
    ("panel",),
)(
    lambda s, f: J.compare_full(
        panel(s, f).where(F.col("trade_date") < F.lit("1999-01-01").cast("date")),
        panel(s, f).where(F.col("trade_date") >= F.lit("1997-01-01").cast("date")).withColumn("mom", F.col("mom") + F.col("rng")),
        ["ts_code", "trade_date"],
        "mom",
    )
)
query(
    "code_overlap",
    "common total low_overlap",
    "overlap",
    """SELECT *, common / total AS overlap, common / total < 0.8 AS low_overlap FROM (SELECT (SELECT count(*) FROM (SELECT ts_code FROM bars INTERSECT SELECT ts_code FROM statements)) AS common,
         (SELECT count(*) FROM (SELECT ts_code FROM bars UNION SELECT ts_code FROM statements)) AS total)""",
    ("bars", "statements"),
)(lambda s, f: J.set_overlap(bars(s, f), statements(s, f)))
query(
    "date_span_gap",
    "ts_code bars_from bars_to reports_from reports_to",
    "",
    "SELECT * FROM (SELECT ts_code, min(trade_date) AS bars_from, max(trade_date) AS bars_to FROM bars GROUP BY 1) FULL JOIN (SELECT ts_code, min(end_date) AS reports_from, max(end_date) AS reports_to FROM statements GROUP BY 1) USING (ts_code)",
    ("bars", "statements"),
)(
    lambda s, f: bars(s, f).groupBy("ts_code").agg(F.min("trade_date").alias("bars_from"), F.max("trade_date").alias("bars_to")).join(
        statements(s, f).groupBy("ts_code").agg(F.min("end_date").alias("reports_from"), F.max("end_date").alias("reports_to")), "ts_code", "full_outer"
    )
)

# ---- sorts, limits, sets --------------------------------------------------------------------

query("latest_rows", "ts_code trade_date", {"close": 8}, "SELECT ts_code, trade_date, \"close\" FROM bars ORDER BY trade_date DESC, ts_code LIMIT 25")(lambda s, f: S.latest_rows(bars(s, f), 25))
query("latest_bar_per_stock", "ts_code trade_date", {"close": 8}, "SELECT ts_code, trade_date, \"close\" FROM bars QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1")(
    lambda s, f: J.latest_row(bars(s, f).select("ts_code", "trade_date", "close"), "ts_code", "trade_date")
)
query(
    "paged_bars",
    "ts_code trade_date row_number total page pages has_next has_prev",
    "",
    """SELECT ts_code, trade_date, rn AS row_number, (SELECT count(*) FROM bars) AS total, 3 AS page, CAST(ceil((SELECT count(*) FROM bars) / 40.0) AS BIGINT) AS pages,
              3 < ceil((SELECT count(*) FROM bars) / 40.0) AS has_next, true AS has_prev FROM (SELECT *, row_number() OVER (ORDER BY trade_date DESC, ts_code) AS rn FROM bars) WHERE rn BETWEEN 81 AND 120""",
)(lambda s, f: Pages(bars(s, f), [F.desc("trade_date"), F.asc("ts_code")], part_rows=50_000).page(3, 40))
query(
    "top_by_metric",
    "event_id",
    {"value": 4},
    "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20",
    (),
)(lambda s, f: S.top_by_metric(table(s, f, "events"), "value", 20, ("value",), "event_id"))
query("stacked_groups", "industry n", "", "SELECT 'all' AS industry, count(*) AS n FROM basic UNION ALL SELECT industry, count(*) FROM basic GROUP BY 1", ("basic",))(
    lambda s, f: stock_basic(s, f).agg(F.lit("all").alias("industry"), F.count("*").alias("n")).unionByName(stock_basic(s, f).groupBy("industry").agg(F.count("*").alias("n")))
)
query("codes_in_both", "ts_code", "", "SELECT ts_code FROM bars INTERSECT SELECT ts_code FROM statements", ("bars", "statements"))(
    lambda s, f: bars(s, f).select("ts_code").intersect(statements(s, f).select("ts_code"))
)
query("codes_in_either", "ts_code", "", "SELECT ts_code FROM bars UNION SELECT ts_code FROM statements", ("bars", "statements"))(
    lambda s, f: bars(s, f).select("ts_code").union(statements(s, f).select("ts_code")).distinct()
)
query(
    "days_without_bars",
    "ts_code trade_date",
    "",
    "SELECT b.ts_code, c.cal_date AS trade_date FROM (SELECT ts_code, min(trade_date) AS a, max(trade_date) AS z FROM bars GROUP BY 1) b JOIN calendar c ON c.cal_date BETWEEN b.a AND b.z EXCEPT SELECT ts_code, trade_date FROM bars",
    ("bars", "calendar"),
)(
    lambda s, f: bars(s, f).groupBy("ts_code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    .select("ts_code", F.explode(F.sequence("a", "z")).alias("trade_date"))
    .join(calendar(s, f).select(F.col("cal_date").alias("trade_date")), "trade_date", "left_semi")
    .join(bars(s, f).select("ts_code", "trade_date"), ["ts_code", "trade_date"], "left_anti")
)
query("distinct_keys", "industry area", "", "SELECT DISTINCT industry, area FROM basic", ("basic",))(lambda s, f: stock_basic(s, f).dropDuplicates(["industry", "area"]))
query(
    "sql_return_function",
    "ts_code",
    "gain",
    "SELECT ts_code, CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0 END AS gain FROM (SELECT ts_code, arg_min(\"close\", trade_date) AS a, arg_max(\"close\", trade_date) AS b FROM bars GROUP BY 1)",
)(lambda s, f: sqlfuncs.first_to_last_return(s, bars(s, f)))
query(
    "scalar_functions",
    "ts_code trade_date weekday month_start digest json code_text day_hash",
    {"root": 6, "power": 6, "log_amount": 6, "direction": 1},
    """SELECT ts_code, trade_date, CAST(dayofweek(trade_date) + 1 AS INTEGER) AS weekday, month(trade_date) <> month(trade_date - 1) AS month_start, sha256(CAST(ts_code AS VARCHAR) || '/' || CAST(trade_date AS VARCHAR)) AS digest,
              '{"c":' || ts_code || '}' AS json, CAST(ts_code AS VARCHAR) AS code_text, md5(CAST(trade_date AS VARCHAR)) AS day_hash, sqrt(vol) AS root, pow(vol / 10, 1.5) AS power, ln(amount) AS log_amount,
              sign("close" - pre_close) AS direction FROM bars""",
)(
    lambda s, f: bars(s, f).select(
        "ts_code",
        "trade_date",
        F.dayofweek("trade_date").alias("weekday"),
        (F.month("trade_date") != F.month(F.date_sub("trade_date", 1))).alias("month_start"),
        F.sha2(F.concat_ws("/", "ts_code", "trade_date"), 256).alias("digest"),
        F.to_json(F.struct(F.col("ts_code").alias("c"))).alias("json"),
        F.col("ts_code").cast("string").alias("code_text"),
        F.md5(F.col("trade_date").cast("string")).alias("day_hash"),
        F.sqrt("vol").alias("root"),
        F.pow(F.col("vol") / 10, F.lit(1.5)).alias("power"),
        F.log("amount").alias("log_amount"),
        F.signum(F.col("close") - F.col("pre_close")).alias("direction"),
    )
)
query(
    "numeric_coercion",
    "event_id",
    {"number": 4},
    "SELECT event_id, TRY_CAST(CASE WHEN value < 50 THEN CAST(value AS VARCHAR) ELSE event_type END AS DOUBLE) AS number FROM events",
    (),
)(
    lambda s, f: table(s, f, "events").select(
        "event_id", F.when(F.col("value") < 50, F.col("value").cast("string")).otherwise(F.col("event_type")).try_cast("double").alias("number")
    )
)
