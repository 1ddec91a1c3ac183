"""Training, prediction, monitoring and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog import monitoring as M
from alphaloom.catalog.base import W, query, view
from alphaloom.catalog.selection import new_weights, prior
from alphaloom.operators import ml
from alphaloom.session import scratch_path
from alphaloom.sources.tables import bars, panel

FACTORS = ["mom", "volr", "rng"]
C = '"close"'


def training(spark, folder):
    return ml.training_set(panel(spark, folder), ml.forward_returns(bars(spark, folder), 5), FACTORS)


view("fwd", f"SELECT ts_code, trade_date, lead({C}, 5) OVER ({W}) / {C} - 1 AS target_return FROM bars", "bars")
view(
    "tbase",
    "SELECT p.ts_code, p.trade_date, mom, volr, rng, target_return FROM panel p JOIN fwd USING (ts_code, trade_date) WHERE target_return BETWEEN -0.5 AND 0.5 AND (mom IS NOT NULL OR volr IS NOT NULL OR rng IS NOT NULL)",
    "panel",
    "fwd",
)
view(
    "training",
    "SELECT * FROM tbase, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FACTORS)
    + " FROM tbase) WHERE "
    + " AND ".join(f"coalesce(abs({c} - m_{c}) <= 10 * s_{c} OR s_{c} = 0, true)" for c in FACTORS),
    "tbase",
)
query("forward_returns", "ts_code trade_date", "target_return", "SELECT * FROM fwd", ("fwd",))(lambda s, f: ml.forward_returns(bars(s, f), 5))
query("training_set", "ts_code trade_date", {"mom": 8, "volr": 9, "rng": 8, "target_return": 8}, "SELECT * FROM training", ("training",))(training)
view(
    "shares",
    "SELECT t.*, share FROM training t JOIN (SELECT trade_date, sum(count(*)) OVER (ORDER BY trade_date) / sum(count(*)) OVER () AS share FROM training GROUP BY 1) USING (trade_date)",
    "training",
)


@query(
    "chronological_split",
    "part n first_date last_date",
    "",
    "SELECT CASE WHEN share <= 0.8 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date FROM shares GROUP BY 1",
    ("shares",),
)
def chronological_split(spark, folder):
    a, b = ml.chronological_split(training(spark, folder))
    both = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query(
    "linear_model_single_factor",
    "part n",
    "mse rmse mae r2",
    """SELECT part, count(*) AS n, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2 FROM (
         SELECT CASE WHEN share <= 0.8 THEN 'train' ELSE 'test' END AS part, target_return AS y, a + b * x - target_return AS e FROM (SELECT *, coalesce(rng, 0) AS x FROM shares),
           (SELECT regr_slope(target_return, coalesce(rng, 0)) AS b, regr_intercept(target_return, coalesce(rng, 0)) AS a FROM shares WHERE share <= 0.8)) GROUP BY 1""",
    ("shares",),
    digits=5,
)
def linear_model_single_factor(spark, folder):
    a, b = ml.chronological_split(training(spark, folder))
    return ml.evaluate(ml.train(a, ["rng"], "linear"), a, b, ["rng"])


def _fit(kind, **params):
    def run(spark, folder):
        a, b = ml.chronological_split(training(spark, folder))
        return ml.evaluate(ml.train(a, FACTORS, kind, **params), a, b, FACTORS).withColumn("kind", F.lit(kind))

    return run


def normal_equations(rows: str, alpha: float) -> str:
    """SQL of one row (y0, m_*, s_*, b_*): a penalised fit on three scaled factors, by Cramer's rule."""
    a, b, c = FACTORS
    z = lambda f: f"(CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} ELSE 0 END)"
    pairs = [(a, a), (a, b), (a, c), (b, b), (b, c), (c, c)]
    sums = ", ".join([f"sum({z(p)} * {z(q)}) + {alpha if p == q else 0} AS {p}_{q}" for p, q in pairs] + [f"sum({z(f)} * (target_return - y0)) AS r_{f}" for f in FACTORS])
    moments = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FACTORS)

    def det(m):
        return " + ".join(f"({m[0][i]}) * (({m[1][j]}) * ({m[2][k]}) - ({m[1][k]}) * ({m[2][j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    rows3 = [[f"{min(p, q, key=FACTORS.index)}_{max(p, q, key=FACTORS.index)}" for q in FACTORS] for p in FACTORS]
    solved = ", ".join(f"({det([[f'r_{p}' if j == k else rows3[i][j] for j in range(3)] for i, p in enumerate(FACTORS)])}) / ({det(rows3)}) AS b_{f}" for k, f in enumerate(FACTORS))
    filled = "SELECT target_return, " + ", ".join(f"coalesce({f}, 0) AS {f}" for f in FACTORS) + f" FROM {rows}"
    return f"""SELECT y0, {", ".join(f"m_{f}, s_{f}" for f in FACTORS)}, {solved} FROM (
        SELECT y0, {", ".join(f"m_{f}, s_{f}" for f in FACTORS)}, {sums} FROM ({filled}) x, (SELECT avg(target_return) AS y0, {moments} FROM ({filled}))
        GROUP BY ALL)"""


def predicted() -> str:
    return "y0 + " + " + ".join(f"CASE WHEN s_{f} > 0 THEN b_{f} * (coalesce({f}, 0) - m_{f}) / s_{f} ELSE 0 END" for f in FACTORS)


def metrics_sql(kind: str, alpha: float) -> str:
    return f"""SELECT '{kind}' AS kind, part, count(*) AS n, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2 FROM (
         SELECT CASE WHEN share <= 0.8 THEN 'train' ELSE 'test' END AS part, target_return AS y, {predicted()} - target_return AS e
         FROM (SELECT share, target_return, {", ".join(FACTORS)} FROM shares), ({normal_equations("(SELECT * FROM shares WHERE share <= 0.8)", alpha)})) GROUP BY 1, 2"""


query("model_linear", "kind part n", "mse rmse mae r2", metrics_sql("linear", 0), ("shares",), digits=5)(_fit("linear"))
query("model_ridge", "kind part n", "mse rmse mae r2", metrics_sql("ridge", 1), ("shares",), digits=5)(_fit("ridge"))


def lasso_equations(rows: str, penalty: float, steps: int = 100) -> str:
    """SQL of one row (y0, m_*, s_*, b_*): the lasso on three scaled factors, by steps from factor to factor.

    Each step sets a coefficient to what its factor explains of the rest, drawn to zero by the penalty.
    """
    z = {f: f"(CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} ELSE 0 END)" for f in FACTORS}
    moments = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FACTORS)
    filled = "SELECT target_return, " + ", ".join(f"coalesce({f}, 0) AS {f}" for f in FACTORS) + f" FROM {rows}"
    known = ["y0", *(f"{k}_{f}" for f in FACTORS for k in "ms")]
    products = [f"avg({z[f]} * {z[g]}) AS g_{f}_{g}" for f in FACTORS for g in FACTORS] + [f"avg({z[f]} * (target_return - y0)) AS c_{f}" for f in FACTORS]
    gram = f"SELECT {', '.join(known)}, {', '.join(products)} FROM ({filled}) x, (SELECT avg(target_return) AS y0, {moments} FROM ({filled})) GROUP BY ALL"
    level, body = "SELECT k, gram.*, " + ", ".join(f"b_{f}" for f in FACTORS) + f" FROM steps, gram WHERE k < {steps}", ""
    for f in FACTORS:  # the new coefficient takes the old one's place for the factors after it
        rest = " - ".join([f"c_{f}", *(f"g_{f}_{h} * b_{h}" for h in FACTORS if h != f)])
        level = f"SELECT * REPLACE (CASE WHEN g_{f}_{f} > 0 THEN sign({rest}) * greatest(abs({rest}) - {penalty}, 0) / g_{f}_{f} ELSE 0 END AS b_{f}) FROM ({level})"
    body = f"SELECT k + 1 AS k, {', '.join(f'b_{f}' for f in FACTORS)} FROM ({level})"
    first = ", ".join(f"0::DOUBLE AS b_{f}" for f in FACTORS)
    return f"""WITH RECURSIVE gram AS MATERIALIZED ({gram}), steps AS (SELECT 0 AS k, {first} UNION ALL {body})
        SELECT {', '.join(known)}, {', '.join(f'b_{f}' for f in FACTORS)} FROM gram, (SELECT * FROM steps WHERE k = {steps})"""


def lasso_sql(penalty: float) -> str:
    return metrics_sql("lasso", 0).replace(normal_equations("(SELECT * FROM shares WHERE share <= 0.8)", 0), lasso_equations("(SELECT * FROM shares WHERE share <= 0.8)", penalty))


query("model_lasso", "kind part n", "mse rmse mae r2", lasso_sql(0.1), ("shares",), digits=5)(_fit("lasso"))
# A penalty that leaves some factors in.
query("model_lasso_light", "kind part n", "mse rmse mae r2", lasso_sql(0.002), ("shares",), digits=5)(_fit("lasso", regParam=0.002))
for _k in ("random_forest", "gradient_boosting"):
    query(f"model_{_k}", "kind part n", "mse rmse mae r2")(_fit(_k))


@query(
    "feature_importance_linear",
    "feature",
    "importance",
    f"""SELECT unnest({FACTORS}) AS feature, unnest([{', '.join(f'abs(b_{f})' for f in FACTORS)}]) AS importance FROM ({normal_equations('(SELECT * FROM shares WHERE share <= 0.8)', 0)})""",
    ("shares",),
    digits=5,
)
def feature_importance_linear(spark, folder):
    a, _ = ml.chronological_split(training(spark, folder))
    return ml.feature_importance(ml.train(a, FACTORS, "linear"), FACTORS, spark)


@query("feature_importance", "feature", "importance")
def feature_importance(spark, folder):
    a, _ = ml.chronological_split(training(spark, folder))
    return ml.feature_importance(ml.train(a, FACTORS, "random_forest"), FACTORS, spark)


def folds_sql(folds: int = 5) -> str:
    parts = []
    for k in range(1, folds + 1):
        cut, end = f"CAST({k / (folds + 1)!r} AS DOUBLE)", f"CAST({(k + 1) / (folds + 1)!r} AS DOUBLE)"
        parts.append(
            f"""SELECT {k} AS fold, count(*) AS n, 1 - avg(e * e) / var_pop(y) AS r2, avg(e * e) AS mse FROM (SELECT target_return AS y, {predicted()} - target_return AS e
                FROM (SELECT target_return, {", ".join(FACTORS)} FROM shares WHERE share > {cut} AND share <= {end}), ({normal_equations(f"(SELECT * FROM shares WHERE share <= {cut})", 0)}))"""
        )
    return " UNION ALL ".join(parts)


@query("time_series_cv", "fold n", "r2 mse", folds_sql(), ("shares",), digits=5)
def time_series_cv(spark, folder):
    return spark.createDataFrame(ml.time_series_cv(training(spark, folder), FACTORS, "linear"), "fold int, n long, r2 double, mse double")


@query("best_model", "kind", "r2")
def best_model(spark, folder):
    return ml.best_model(ml.metrics_table(ml.train_many(training(spark, folder), FACTORS, ["linear", "ridge", "lasso", "random_forest", "gradient_boosting"])))


@query(
    "model_save_load",
    "ts_code trade_date label",
    "score",
    f"SELECT ts_code, trade_date, score, CASE WHEN score > 0 THEN 1 ELSE 0 END AS label FROM (SELECT ts_code, trade_date, {predicted()} AS score FROM (SELECT *, 1 AS one FROM panel) p JOIN (SELECT *, 1 AS also FROM ({normal_equations('training', 0)})) m ON p.one = m.also)",
    ("panel", "training"),
)
def model_save_load(spark, folder):
    """Predictions of a model that was written and read back."""
    rows = training(spark, folder)
    path = scratch_path(spark, "models")
    ml.save_model(ml.train(rows, FACTORS, "linear"), path, "baseline", "1", {"r2": 0.0}, spark)
    return ml.predict(ml.load_model(path, "baseline", "1"), panel(spark, folder), FACTORS)


def predictions(spark, folder):
    """Momentum as a model: the sign of the factor is the label, its size the confidence."""
    p = panel(spark, folder).where(F.col("mom").isNotNull())
    return p.select("ts_code", "trade_date", F.date_format("trade_date", "yyyy").alias("model_name"), F.when(F.col("mom") > 0, 1).otherwise(0).alias("label"), F.least(F.abs("mom") / 100, F.lit(1.0)).alias("confidence"))


def judged(spark, folder):
    """Predictions with the realised sign of the forward return."""
    truth = ml.forward_returns(bars(spark, folder), 5).where(F.col("target_return").isNotNull())
    return predictions(spark, folder).join(truth.select("ts_code", "trade_date", F.when(F.col("target_return") > 0, 1).otherwise(0).alias("truth")), ["ts_code", "trade_date"])


view(
    "judged",
    "SELECT strftime(trade_date, '%Y') AS model_name, (mom > 0)::INT AS p, (target_return > 0)::INT AS t, least(abs(mom) / 100, 1.0) AS confidence FROM panel JOIN fwd USING (ts_code, trade_date) WHERE mom IS NOT NULL AND target_return IS NOT NULL",
    "panel",
    "fwd",
)
query(
    "classification_metrics",
    "model_name prediction_count",
    "accuracy precision recall f1_score error_rate",
    """SELECT model_name, CAST(sum(support) AS BIGINT) AS prediction_count, sum(tp) / sum(support) AS accuracy, sum(pr * support) / sum(support) AS precision, sum(rc * support) / sum(support) AS recall,
              sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support) / sum(support) AS f1_score, 1 - sum(tp) / sum(support) AS error_rate FROM (
         SELECT model_name, k, tp, support, coalesce(tp / nullif(called, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS rc FROM (
           SELECT model_name, k, count(*) FILTER (t = k AND p = k) AS tp, count(*) FILTER (t = k) AS support, count(*) FILTER (p = k) AS called FROM judged, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2)) GROUP BY 1""",
    ("judged",),
)(lambda s, f: ml.classification_metrics(judged(s, f), ["model_name"]))
query(
    "confidence_distribution",
    "model_name",
    "mean std min max q25 q50 q75",
    """SELECT model_name, avg(confidence) AS mean, stddev_pop(confidence) AS std, min(confidence) AS min, max(confidence) AS max, quantile_cont(confidence, 0.25) AS q25, quantile_cont(confidence, 0.5) AS q50,
              quantile_cont(confidence, 0.75) AS q75 FROM judged GROUP BY 1""",
    ("judged",),
)(lambda s, f: ml.confidence_distribution(judged(s, f), ["model_name"]))
_cut = "DATE '1998-07-01'"
view("dlong", " UNION ALL ".join(f"SELECT '{c}' AS feature, trade_date < {_cut} AS ref, {c} AS x FROM panel WHERE {c} IS NOT NULL" for c in FACTORS), "panel")
query(
    "data_drift",
    "feature drift_type is_significant n_reference n_current",
    {"reference_mean": 5, "current_mean": 5, "reference_std": 5, "current_std": 5, "ks_statistic": 6, "p_value": 5, "drift_score": 6},
    """SELECT *, CASE WHEN drift_type = 'distribution_change' THEN ks_statistic WHEN drift_type = 'variance_change' THEN vs ELSE ms END AS drift_score,
              drift_type <> 'distribution_change' OR p_value < 0.05 AS is_significant FROM (
         SELECT *, CASE WHEN ms > 2 AND ms >= vs THEN 'mean_shift' WHEN vs > 0.5 THEN 'variance_change' ELSE 'distribution_change' END AS drift_type,
                CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1, greatest(0, list_sum(list_transform(generate_series(1, 100), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * lam * lam))))) END AS p_value FROM (
           SELECT *, (sqrt(n_reference * n_current / (n_reference + n_current)) + 0.12 + 0.11 / sqrt(n_reference * n_current / (n_reference + n_current))) * ks_statistic AS lam,
                  abs(current_mean - reference_mean) / reference_std AS ms, abs(current_std - reference_std) / reference_std AS vs FROM (
             SELECT feature, avg(x) FILTER (ref) AS reference_mean, avg(x) FILTER (NOT ref) AS current_mean, stddev_pop(x) FILTER (ref) AS reference_std, stddev_pop(x) FILTER (NOT ref) AS current_std,
                    count(*) FILTER (ref) AS n_reference, count(*) FILTER (NOT ref) AS n_current FROM dlong GROUP BY 1)
           JOIN (SELECT feature, max(abs(cr / nr - cc / nc)) AS ks_statistic FROM (
             SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc FROM (
               SELECT feature, x, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM dlong GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY x)) GROUP BY 1) USING (feature)))""",
    ("dlong",),
)(lambda s, f: ml.data_drift(panel(s, f).where(F.col("trade_date") < F.lit("1998-07-01").cast("date")), panel(s, f).where(F.col("trade_date") >= F.lit("1998-07-01").cast("date")), FACTORS))
query(
    "importance_drift",
    "model_name",
    "importance_drift",
    "SELECT model_name, 1 - sum(n.weight * p.weight) / (sqrt(sum(n.weight * n.weight)) * sqrt(sum(p.weight * p.weight))) AS importance_drift FROM new_weights n JOIN prior p USING (model_name, factor_name) GROUP BY 1",
    ("new_weights", "prior"),
)(lambda s, f: ml.importance_drift(new_weights(s, f), prior(s, f)))
query(
    "monitoring_summary",
    "model_name significant_drifts alerts critical_alerts",
    "avg_accuracy avg_f1 avg_error_rate",
    """SELECT m.*, a.n AS alerts, a.c AS critical_alerts FROM (SELECT model_name, avg(accuracy) AS avg_accuracy, avg(f1_score) AS avg_f1, avg(error_rate) AS avg_error_rate, count(*) FILTER (error_rate > 0.2) AS significant_drifts
         FROM mmetrics GROUP BY 1) m LEFT JOIN (SELECT model_name, count(*) AS n, count(*) FILTER (severity = 'critical') AS c FROM malerts GROUP BY 1) a USING (model_name)""",
    ("mmetrics", "malerts"),
)(
    lambda s, f: ml.monitoring_summary(
        M.model_metrics(s, f), M.model_metrics(s, f).select("model_name", (F.col("error_rate") > 0.2).alias("is_significant")), M.model_alerts(s, f)
    )
)


@query(
    "retraining_triggers",
    "model_name trigger_type",
    "",
    """SELECT model_name, unnest(list_filter([CASE WHEN accuracy < 0.45 OR f1_score < 0.3 OR error_rate > 0.4 THEN 'performance_threshold' END, CASE WHEN drifts >= 3 THEN 'data_drift' END,
              CASE WHEN DATE '2024-02-05' - last >= 7 THEN 'scheduled' END], lambda x: x IS NOT NULL)) AS trigger_type FROM (
         SELECT model_name, avg(accuracy) AS accuracy, avg(f1_score) AS f1_score, avg(error_rate) AS error_rate, count(*) FILTER (error_rate > 0.25) AS drifts, min(date) AS last FROM mmetrics GROUP BY 1)""",
    ("mmetrics",),
)
def retraining_triggers(spark, folder):
    m = M.model_metrics(spark, folder).groupBy("model_name").agg(
        F.avg("accuracy").alias("accuracy"),
        F.avg("f1_score").alias("f1_score"),
        F.avg("error_rate").alias("error_rate"),
        F.count_if(F.col("error_rate") > 0.25).alias("drifts_today"),
        F.min("date").alias("last_trained"),
    )
    return ml.retraining_triggers(m, "2024-02-05", 0.45, 0.3, 0.4)


query(
    "prediction_history",
    "ts_code trade_date label",
    "confidence",
    "SELECT ts_code, trade_date, (mom > 0)::INT AS label, least(abs(mom) / 100, 1.0) AS confidence FROM panel WHERE mom IS NOT NULL AND ts_code = 5 AND trade_date >= DATE '2001-01-01'",
    ("panel",),
)(lambda s, f: ml.history(predictions(s, f), 5, None, "2001-01-01"))


_WEIGHTS = {"mom": 0.5, "rng": -0.25}


@query(
    "explanation_history",
    "id model_version explanation_type created_at",
    "prediction_value base_value share_mom share_rng",
    """SELECT 'blend-' || version || '-' || ts_code || '-' || strftime(trade_date, '%Y%m%d') AS id, version AS model_version, 'local' AS explanation_type, base + a + b AS prediction_value, base AS base_value,
              a AS share_mom, b AS share_rng, trade_date AS created_at
       FROM (SELECT ts_code, trade_date, '2' AS version, 0.5 * avg(mom) OVER d - 0.25 * avg(rng) OVER d AS base, 0.5 * (coalesce(mom, avg(mom) OVER d) - avg(mom) OVER d) AS a,
                    -0.25 * (coalesce(rng, avg(rng) OVER d) - avg(rng) OVER d) AS b FROM panel WINDOW d AS (PARTITION BY trade_date))
       WHERE ts_code = 5 AND trade_date >= DATE '2001-06-30' - 200""",
    ("panel",),
)
def explanation_history(spark, folder):
    """A model explains all bars, and those of its last year a second time."""
    own = ml.explanation_table(spark, scratch_path(spark, "explanations"))
    rows = panel(spark, folder)
    own.write(ml.linear_explanations(rows, _WEIGHTS, "blend", "2"))
    own.write(ml.linear_explanations(rows.where("trade_date >= DATE '2001-01-01'"), _WEIGHTS, "blend", "2"))
    found = ml.explanation_history(own.read(), 5, "blend", "2001-06-30", 200, "local")
    shares = [F.col("feature_importances")[f].alias(f"share_{f}") for f in _WEIGHTS]
    return found.select("id", "model_version", "explanation_type", "prediction_value", "base_value", *shares, "created_at")


def _model(spark, folder):
    rows = training(spark, folder)
    return ml.train(rows, FACTORS, "linear"), rows


_filled = ", ".join(f"coalesce({f}, 0) AS {f}" for f in FACTORS)


def digest_sql(seed: int) -> str:
    return f"md5('{seed}|' || ts_code || '|' || trade_date)"


def number_sql(seed: int) -> str:
    return f"CAST('0x' || substr({digest_sql(seed)}, 1, 8) AS BIGINT)"


def shuffled_sql(rows: str, col: str, seed: int) -> str:
    """(ts_code, trade_date, v): the column's values permuted among the rows."""
    places = ", ".join(f"row_number() OVER (PARTITION BY g ORDER BY {digest_sql(seed * 31 + salt)}, ts_code, trade_date) AS i{salt}" for salt in (1, 2))
    placed = f"(SELECT *, {places} FROM (SELECT ts_code, trade_date, {col}, {number_sql(seed)} % (SELECT greatest(1, CAST(ceil(count(*) / 50000) AS BIGINT)) FROM {rows}) AS g FROM {rows}))"
    return f"(SELECT a.ts_code, a.trade_date, b.{col} AS v FROM {placed} a JOIN {placed} b ON a.g = b.g AND a.i1 = b.i2)"


def importance_sql(rows: str, repeats: int = 10, seed: int = 42) -> str:
    """Rise of the squared error of the linear model when a factor is permuted."""
    parts = []
    for j, f in enumerate(FACTORS):
        own = ", ".join("v AS " + f if c == f else c for c in FACTORS)
        for r in range(repeats):
            mixed = f"(SELECT target_return, {own} FROM {rows} JOIN {shuffled_sql(rows, f, seed + 100 * j + r)} USING (ts_code, trade_date))"
            parts.append(f"SELECT '{f}' AS feature, avg(pow({predicted()} - target_return, 2)) AS mse FROM {mixed}, fit")
    return f"""WITH fit AS MATERIALIZED ({normal_equations("training", 0)}), errors AS ({" UNION ALL ".join(parts)}),
        base AS (SELECT avg(pow({predicted()} - target_return, 2)) AS b FROM {rows}, fit)
        SELECT feature, avg(mse - b) AS importance, stddev_pop(mse - b) AS importance_std, min(mse - b) AS importance_min, max(mse - b) AS importance_max FROM errors, base GROUP BY 1"""


view("filled", f"SELECT ts_code, trade_date, target_return, {_filled} FROM training", "training")
view("sampled", f"SELECT * FROM filled WHERE {number_sql(42)} < 0.3 * 4294967296", "filled")


def dependence_sql(feature: str, points: int = 50) -> str:
    at = predicted().replace(f"coalesce({feature}, 0)", "feature_value")
    return f"""SELECT grid_index, feature_value, avg({at}) AS pdp_value FROM filled, ({normal_equations("training", 0)}),
        (SELECT i AS grid_index, lo + (hi - lo) * i / {points - 1} AS feature_value FROM (SELECT min({feature}) AS lo, max({feature}) AS hi FROM filled), (SELECT CAST(unnest(range({points})) AS INTEGER) AS i))
        GROUP BY 1, 2"""


def interaction_sql(pairs: list[tuple[str, str]], seed: int = 7) -> str:
    used = sorted({f for p in pairs for f in p})
    wide = "filled"
    columns = ", ".join(f"p{j}.v AS p_{f}" for j, f in enumerate(used))
    for j, f in enumerate(used):
        wide += f" JOIN {shuffled_sql('filled', f, seed + j)} p{j} USING (ts_code, trade_date)"

    def with_(*swap):
        out = predicted()
        for f in swap:
            out = out.replace(f"coalesce({f}, 0)", f"p_{f}")
        return f"({out})"

    base = with_()
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS feature1, '{b}' AS feature2, avg(abs({base} - {with_(a, b)})) / (avg(abs({base} - {with_(a)}) + abs({base} - {with_(b)})) + 1e-8) AS interaction_strength
            FROM (SELECT {", ".join(FACTORS)}, {columns} FROM {wide}), ({normal_equations("training", 0)})"""
        for a, b in pairs
    )


@query("permutation_importance", "feature", "importance importance_std importance_min importance_max", importance_sql("filled"), ("training", "filled"), digits=8)
def permutation_importance(spark, folder):
    model, rows = _model(spark, folder)
    return ml.permutation_importance(model, rows, FACTORS)


@query("partial_dependence", "grid_index", "feature_value pdp_value", dependence_sql("mom"), ("training", "filled"))
def partial_dependence(spark, folder):
    model, rows = _model(spark, folder)
    return ml.partial_dependence(model, rows, FACTORS, "mom")


@query("interaction_strength", "feature1 feature2", "interaction_strength", interaction_sql([("mom", "volr"), ("mom", "rng")]), ("training", "filled"), digits=5)
def interaction_strength(spark, folder):
    model, rows = _model(spark, folder)
    return ml.interaction_strength(model, rows, FACTORS, [("mom", "volr"), ("mom", "rng")])


@query("global_importance", "feature", "importance", importance_sql("sampled"), ("training", "filled", "sampled"), digits=8)
def global_importance(spark, folder):
    model, rows = _model(spark, folder)
    return ml.global_importance(model, rows, FACTORS, 0.3)
