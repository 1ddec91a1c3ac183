"""Training sets, Spark ML models, predictions, monitoring and model explanation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.stats import kolmogorov_p_value
from alphaloom.operators import crosssection as X
from alphaloom.operators import trees
from alphaloom.session import brief_shuffles, stored
from alphaloom.sources.versioned import VersionedTable

CODE, DATE = "ts_code", "trade_date"
TARGET = "target_return"
#: Share of the rows, by their days, that models learn from.
TRAIN_SHARE = 0.8


# ---- data -----------------------------------------------------------------------------------


def forward_returns(bars: DataFrame, n: int = 5) -> DataFrame:
    """Return over the next ``n`` rows of the security."""
    later = F.lead("close", n).over(W.partitionBy(CODE).orderBy(DATE))
    return bars.select(CODE, DATE, F.when(F.col("close") > 0, later / F.col("close") - 1).alias(TARGET))


def clean_training(df: DataFrame, factors: list[str], band: float = 0.5, sigmas: float = 10.0) -> DataFrame:
    """Known targets inside the band, rows with some factor, factors inside ten sd.

    The sd bounds join their conditions with AND, so that they have an effect. Moments, shares of
    days and fits all read the rows; they are written once, so that windows and joins run once.
    """
    out = stored(df.where(F.col(TARGET).between(-band, band)).dropna(how="all", subset=factors), "known")
    moments = out.agg(*[F.avg(c).alias(f"_m_{c}") for c in factors], *[F.stddev_samp(c).alias(f"_s_{c}") for c in factors])
    out = out.crossJoin(F.broadcast(moments))  # one row
    for c in factors:
        off = F.abs(F.col(c) - F.col(f"_m_{c}"))
        out = out.where(F.coalesce((off <= F.col(f"_s_{c}") * sigmas) | (F.col(f"_s_{c}") == 0), F.lit(True)))
    return out.drop(*[f"_m_{c}" for c in factors], *[f"_s_{c}" for c in factors])


def training_set(factors: DataFrame, targets: DataFrame, names: list[str], min_samples: int = 1) -> DataFrame:
    """Wide factors with their target, cleaned; an error when too few rows remain."""
    out = clean_training(factors.select(CODE, DATE, *names).join(targets, [CODE, DATE]), names)
    if min_samples > 1 and out.limit(min_samples).count() < min_samples:
        raise ValueError(f"fewer than {min_samples} samples")
    return out


def with_time_share(df: DataFrame) -> DataFrame:
    """Share of all rows dated up to each row's date.

    Rows are counted per day first, so the running sum covers one row per day.
    """
    days = df.groupBy(DATE).agg(F.count("*").alias("_c"))
    order = W.orderBy(DATE)
    share = F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("_c").over(W.partitionBy())
    return df.join(days.select(DATE, share.alias("time_share")), DATE)


def chronological_split(df: DataFrame, train: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Earlier days for training, later ones for testing; a day is never divided."""
    shared = with_time_share(df)
    return shared.where(F.col("time_share") <= train).drop("time_share"), shared.where(F.col("time_share") > train).drop("time_share")


# ---- models ---------------------------------------------------------------------------------

LINEAR = ("linear", "ridge", "lasso")
#: Parameters of trees that mean the same for rows and for rows summed by cell.
CELL_PARAMS = {"seed", "numTrees", "maxIter", "maxDepth", "stepSize", "minInfoGain", "featureSubsetStrategy"}


def regressor(kind: str, seed: int = 42, **params):
    """A Spark ML estimator by name; the boosting libraries map to gradient-boosted trees."""
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=TARGET, **params)
    if kind == "ridge":
        return LinearRegression(featuresCol="features", labelCol=TARGET, elasticNetParam=0.0, standardization=False, **params)
    if kind == "lasso":
        return LinearRegression(featuresCol="features", labelCol=TARGET, elasticNetParam=1.0, standardization=False, regParam=params.pop("regParam", 0.1), **params)
    if kind == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol=TARGET, seed=seed, **({"numTrees": 100, "maxDepth": 10} | params))
    if kind in ("gradient_boosting", "xgboost", "lightgbm"):
        return GBTRegressor(featuresCol="features", labelCol=TARGET, seed=seed, **({"maxIter": 100, "maxDepth": 6, "stepSize": 0.1} | params))
    raise ValueError(f"unknown model {kind}")


def model_pipeline(kind: str, factors: list[str], **params) -> Pipeline:
    """Assemble, scale for the linear family, and regress."""
    assemble = VectorAssembler(inputCols=factors, outputCol="raw" if kind in LINEAR else "features", handleInvalid="error")
    stages = [assemble]
    if kind in LINEAR:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, regressor(kind, **params)])


def fill_zero(df: DataFrame, factors: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=factors)


def train(df: DataFrame, factors: list[str], kind: str, **params) -> PipelineModel:
    # Fitting reads the rows several times; they are written once, so that a lost executor costs a read.
    return fitted(stored(trees.numbered(fill_zero(df, factors).select(*factors, TARGET)), "training"), factors, kind, **params)


def fitted(rows: DataFrame, factors: list[str], kind: str, alpha: float = 1.0, **params) -> PipelineModel:
    """The model of a kind on rows without nulls.

    Ridge weighs ``alpha`` against the sum of squared errors; the estimator's own penalty goes with
    half the mean error and is divided by the target's deviation, so it follows from both. The
    lasso's penalty goes with half the mean error here and there. Trees grow on rows summed by cell,
    unless a parameter asks for something that only single rows have, or there are too many cells.
    """
    if kind not in LINEAR and set(params) <= CELL_PARAMS:
        model = trees.fitted_trees(rows, factors, TARGET, regressor(kind, **params))
        if model:
            return model
    if kind == "ridge" and "regParam" not in params:
        n, deviation = rows.agg(F.count("*"), F.stddev_pop(TARGET)).first()
        params["regParam"] = alpha * (deviation or 0.0) / max(n, 1)
    return model_pipeline(kind, factors, **params).fit(rows)


def regression_metrics(predicted: DataFrame, target: str = TARGET, by: list[str] | None = None) -> DataFrame:
    """mse, rmse, mae and r2 in one aggregate."""
    e = F.col("prediction") - F.col(target)
    out = predicted.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(target).alias("_v")
    )
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_v"))}).drop("_v")


def evaluate(model: PipelineModel, train_set: DataFrame, test_set: DataFrame, factors: list[str]) -> DataFrame:
    """Metrics of both sets, one row each."""
    both = train_set.withColumn("part", F.lit("train")).unionByName(test_set.withColumn("part", F.lit("test")))
    return regression_metrics(trees.predicted(model, fill_zero(both, factors)), by=["part"])


def feature_importance(model: PipelineModel, factors: list[str], spark) -> DataFrame:
    """Tree importances or sizes of coefficients, largest first; one row per factor."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(v) for v in last.coefficients.toArray()]
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(factors, values)], "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def time_series_cv(df: DataFrame, factors: list[str], kind: str, folds: int = 5, **params) -> list[dict]:
    """r2 of ``folds`` expanding windows: train up to a cut, test on the part after it."""
    shared = stored(with_time_share(fill_zero(df, factors)).select(*factors, TARGET, "time_share"), "folds")
    scores = []
    for k in range(1, folds + 1):
        cut, end = k / (folds + 1), (k + 1) / (folds + 1)
        model = fitted(shared.where(F.col("time_share") <= cut), factors, kind, **params)
        part = shared.where((F.col("time_share") > cut) & (F.col("time_share") <= end))
        row = regression_metrics(model.transform(part)).first()
        scores.append({"fold": k, "n": row["n"], "r2": row["r2"], "mse": row["mse"]})
    return scores


@dataclass
class Trained:
    kind: str
    model: PipelineModel
    metrics: DataFrame


def train_many(df: DataFrame, factors: list[str], kinds: list[str]) -> dict[str, Trained]:
    """Fit several kinds on the same chronological split, written once for all of them."""
    parts = with_time_share(df).withColumn("part", F.when(F.col("time_share") <= TRAIN_SHARE, "train").otherwise("test"))
    rows = stored(trees.numbered(fill_zero(parts, factors).select(*factors, TARGET, "part")), "training")
    out = {}
    for kind in kinds:
        model = fitted(rows.where("part = 'train'"), factors, kind)
        out[kind] = Trained(kind, model, regression_metrics(trees.predicted(model, rows), by=["part"]).withColumn("kind", F.lit(kind)))
    return out


def metrics_table(trained: dict[str, Trained]) -> DataFrame:
    frames = [t.metrics for t in trained.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def best_model(metrics: DataFrame) -> DataFrame:
    """The kind with the highest test r2."""
    return metrics.where("part = 'test'").agg(F.max_by("kind", "r2").alias("kind"), F.max("r2").alias("r2"))


def save_model(model: PipelineModel, path: str, name: str, version: str, metrics: dict, spark) -> None:
    """Write the model and a metadata row beside it."""
    model.write().overwrite().save(f"{path}/{name}/{version}/model")
    row = spark.createDataFrame([(name, version, {k: float(v) for k, v in metrics.items()})], "name string, version string, metrics map<string,double>")
    row.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/{name}/{version}/meta")


def load_model(path: str, name: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{name}/{version}/model")


def predict(model: PipelineModel, factors_wide: DataFrame, factors: list[str]) -> DataFrame:
    """Score every row and label it by the sign of the prediction."""
    out = model.transform(fill_zero(factors_wide, factors))
    return out.select(CODE, DATE, F.col("prediction").alias("score"), F.when(F.col("prediction") > 0, 1).otherwise(0).alias("label"))


def history(rows: DataFrame, code=None, model: str | None = None, since=None, time: str = DATE) -> DataFrame:
    """Stored predictions or explanations, newest first."""
    if code is not None:
        rows = rows.where(F.col(CODE) == code)
    if model is not None:
        rows = rows.where(F.col("model_name") == model)
    if since is not None:
        rows = rows.where(F.col(time) >= F.lit(since).cast("date"))
    return rows.orderBy(F.desc(time), CODE)


def linear_explanations(rows: DataFrame, weights: dict[str, float], model: str, version: str) -> DataFrame:
    """What each factor adds to a linear model's prediction, against the mean of its day.

    One row per security and day: base value, prediction and the factors' shares, which add up.
    Null factors count as their day's mean.
    """
    means = X.group_stats(rows, DATE, **{f"_mean_{f}": F.avg(f) for f in weights})
    share = {f: (F.coalesce(F.col(f), F.col(f"_mean_{f}")) - F.col(f"_mean_{f}")) * w for f, w in weights.items()}
    base = sum((F.col(f"_mean_{f}") * w for f, w in weights.items()), F.lit(0.0))
    return means.select(
        F.concat_ws("-", F.lit(model), F.lit(version), F.col(CODE).cast("string"), F.date_format(DATE, "yyyyMMdd")).alias("id"),
        F.col(CODE),
        F.lit(model).alias("model_name"),
        F.lit(version).alias("model_version"),
        F.lit("local").alias("explanation_type"),
        (base + sum(share.values(), F.lit(0.0))).alias("prediction_value"),
        base.alias("base_value"),
        F.create_map(*(x for f, c in share.items() for x in (F.lit(f), c))).alias("feature_importances"),
        F.col(DATE).alias("created_at"),
        F.date_format(DATE, "yyyy-MM").alias("month"),
    )


def explanation_table(spark: SparkSession, path: str) -> VersionedTable:
    """Stored explanations by month; one that is stored again replaces the older."""
    return VersionedTable(spark, path, ["id", "month"], "month")


def explanation_history(rows: DataFrame, code, model: str, as_of, days: int = 30, kind: str | None = None) -> DataFrame:
    """Explanations of one security and model from the last days, newest first."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    own = rows.where((F.col(CODE) == code) & (F.col("model_name") == model) & (F.col("created_at") >= since) & (F.col("month") >= F.date_format(since, "yyyy-MM")))
    if kind is not None:
        own = own.where(F.col("explanation_type") == kind)
    columns = ["id", "model_version", "explanation_type", "prediction_value", "base_value", "feature_importances", "created_at"]
    return own.select(*columns).orderBy(F.desc("created_at"), "id")


# ---- monitoring -----------------------------------------------------------------------------


def classification_metrics(df: DataFrame, by: list[str], predicted: str = "label", truth: str = "truth") -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, and error rate per model.

    Everything comes from the counts of (model, truth, prediction).
    """
    cells = df.where(F.col(truth).isNotNull()).groupBy(*by, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    arms = F.explode(F.array(F.struct(F.col("t").alias("k"), F.lit("t").alias("side")), F.struct(F.col("p").alias("k"), F.lit("p").alias("side"))))
    sides = cells.withColumn("a", arms)
    hit = (F.col("t") == F.col("p")) & (F.col("a.side") == "t")
    per_class = sides.groupBy(*by, F.col("a.k").alias("k")).agg(
        F.sum(F.when(hit, F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("a.side") == "t", F.col("c")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("a.side") == "p", F.col("c")).otherwise(0)).alias("called"),
    )
    pr = F.coalesce(F.try_divide(F.col("tp"), F.col("called")), F.lit(0.0))
    rc = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(pr * rc * 2, pr + rc), F.lit(0.0))
    total = F.sum("support")
    out = per_class.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(pr * F.col("support")) / total).alias("precision"),
        (F.sum(rc * F.col("support")) / total).alias("recall"),
        (F.sum(f1 * F.col("support")) / total).alias("f1_score"),
        total.alias("prediction_count"),
    )
    return out.withColumn("error_rate", F.lit(1.0) - F.col("accuracy"))


def confidence_distribution(df: DataFrame, by: list[str], confidence: str = "confidence") -> DataFrame:
    base = df.groupBy(*by).agg(F.avg(confidence).alias("mean"), F.stddev_pop(confidence).alias("std"), F.min(confidence).alias("min"), F.max(confidence).alias("max"))
    return base.join(X.group_quantiles(df, by, confidence, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), by)


# Limits above which a shift counts as drift.
DRIFT = {"mean_shift": 2.0, "variance_change": 0.5, "distribution_change": 0.05}


def ks_statistic(long: DataFrame, key: str = "feature", value: str = "x", flag: str = "is_reference") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature.

    At every value, the cumulative share of the value's own sample and of the other one follow
    from its position in its sample and in both samples together.
    """
    known = long.where(F.col(value).isNotNull())
    hot = X.has_hot_group(known, key)
    placed = X.with_all_positions(known, [(key, value, "_a"), ([key, flag], value, "_o")], hot)
    own = F.col("_obelow") + F.col("_oties")
    other = F.col("_abelow") + F.col("_aties") - own
    gap = F.abs(own / F.col("_on") - F.try_divide(other, F.col("_an") - F.col("_on")))
    return placed.groupBy(key).agg(
        F.max(gap).alias("ks_statistic"),
        F.count_if(F.col(flag)).alias("n_reference"),
        F.count_if(~F.col(flag)).alias("n_current"),
    )


def data_drift(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Drift per feature: mean shift, change of spread or changed distribution, in that order."""
    long = reference.select(*features).withColumn("is_reference", F.lit(True)).unionByName(current.select(*features).withColumn("is_reference", F.lit(False)))
    long = long.unpivot(["is_reference"], features, "feature", "x")
    ref, cur = F.when(F.col("is_reference"), F.col("x")), F.when(~F.col("is_reference"), F.col("x"))
    base = long.groupBy("feature").agg(
        F.avg(ref).alias("reference_mean"), F.avg(cur).alias("current_mean"), F.stddev_pop(ref).alias("reference_std"), F.stddev_pop(cur).alias("current_std")
    )
    out = base.join(ks_statistic(long), "feature")
    out = out.withColumns(
        {
            "mean_score": F.coalesce(F.try_divide(F.abs(F.col("current_mean") - F.col("reference_mean")), F.col("reference_std")), F.lit(0.0)),
            "variance_score": F.coalesce(F.try_divide(F.abs(F.col("current_std") - F.col("reference_std")), F.col("reference_std")), F.lit(0.0)),
            "p_value": kolmogorov_p_value("ks_statistic", "n_reference", "n_current"),
        }
    )
    mean, var = F.col("mean_score") > DRIFT["mean_shift"], F.col("variance_score") > DRIFT["variance_change"]
    by_mean = mean & (F.col("mean_score") >= F.col("variance_score"))
    return out.withColumns(
        {
            "drift_type": F.when(by_mean, "mean_shift").when(var, "variance_change").otherwise("distribution_change"),
            "drift_score": F.when(by_mean, F.col("mean_score")).when(var, F.col("variance_score")).otherwise(F.col("ks_statistic")),
            "is_significant": by_mean | var | (F.col("p_value") < DRIFT["distribution_change"]),
        }
    )


def importance_drift(current: DataFrame, earlier: DataFrame, by: str = "model_name") -> DataFrame:
    """One minus the cosine of two weight vectors over their common factors."""
    both = current.select(by, "factor_name", F.col("weight").alias("a")).join(earlier.select(by, "factor_name", F.col("weight").alias("b")), [by, "factor_name"])
    a, b = F.col("a"), F.col("b")
    cosine = F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))
    return both.groupBy(by).agg((F.lit(1.0) - cosine).alias("importance_drift"))


def monitoring_summary(metrics: DataFrame, drift: DataFrame, alerts: DataFrame) -> DataFrame:
    """Figures per model with counts of significant drifts and of alerts by severity."""
    m = metrics.groupBy("model_name").agg(F.avg("accuracy").alias("avg_accuracy"), F.avg("f1_score").alias("avg_f1"), F.avg("error_rate").alias("avg_error_rate"))
    d = drift.groupBy("model_name").agg(F.count_if("is_significant").alias("significant_drifts"))
    a = alerts.groupBy("model_name").agg(F.count("*").alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts"))
    return m.join(d, "model_name", "left").join(a, "model_name", "left").fillna(0, ["significant_drifts", "alerts", "critical_alerts"])


def retraining_triggers(state: DataFrame, as_of, accuracy: float = 0.6, f1: float = 0.6, error: float = 0.4) -> DataFrame:
    """Why a model should be trained again: weak metrics, three drifts in a day, thirty days."""
    age = F.datediff(F.lit(as_of).cast("date"), "last_trained")
    reasons = F.array(
        F.when((F.col("accuracy") < accuracy) | (F.col("f1_score") < f1) | (F.col("error_rate") > error), F.lit("performance_threshold")),
        F.when(F.col("drifts_today") >= 3, F.lit("data_drift")),
        F.when(age >= 30, F.lit("scheduled")),
    )
    return state.withColumn("trigger_type", F.explode(F.filter(reasons, lambda r: r.isNotNull()))).select("model_name", "trigger_type")


# ---- explanation ----------------------------------------------------------------------------


def key_digest(seed: int | Column, keys: list[str]) -> Column:
    """An order of keys by chance that any engine can repeat: the digest of seed and keys."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed, *(F.col(k).cast("string") for k in keys)).cast("binary"))


def key_number(seed: int | Column, keys: list[str]) -> Column:
    """The digest's first 32 bits."""
    return F.conv(F.substring(key_digest(seed, keys), 1, 8), 16, 10).cast("long")


GROUP_ROWS = 50_000  # rows among which values are permuted
TASK_ROWS = 1_000_000  # rows that a task sorts for it
TURN_ROWS = 40_000_000  # rows that are exchanged before the disk is free again


def shuffled_column(df: DataFrame, keys: list[str], col: str, seed: int, group_rows: int = GROUP_ROWS, rows: int | None = None) -> DataFrame:
    """Keys with the column's values permuted among the rows.

    Rows fall into random groups of bounded size by a hash of their key. Inside a group, the row
    at one random place takes the value of the row at the same place in another random order.
    """
    n = df.count() if rows is None else rows
    groups = max(1, math.ceil(n / group_rows))

    def place(salt: int) -> Column:
        return F.row_number().over(W.partitionBy("_g").orderBy(key_digest(seed * 31 + salt, keys), *keys))

    base = df.select(*keys, F.col(col).alias("_v"), (key_number(seed, keys) % groups).alias("_g"))
    takers = base.select(*keys, "_g", place(1).alias("_i"))
    givers = base.select("_g", place(2).alias("_i"), F.col("_v").alias(col))
    return takers.join(givers, ["_g", "_i"]).drop("_g", "_i")


def digest_order(table: pa.Table, digest: str, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the order of a digest, then of the keys, and for each row the number of its key in that order."""
    held = table[digest].combine_chunks().cast(pa.binary(16))
    words = np.frombuffer(held.buffers()[1], ">u8", 2 * len(held), 16 * held.offset).astype(np.uint64)
    by = [words[0::2]]
    order = np.argsort(by[0], kind="stable")
    if (by[0][order][1:] == by[0][order][:-1]).any():  # a key that comes twice, or almost never two keys
        by = [*by, words[1::2], *(pd.factorize(table[k].to_pandas(), sort=True)[0] for k in keys)]
        order = np.lexsort(by[::-1])
    new = np.zeros(len(order), dtype=bool)
    for b in by:
        new[1:] |= b[order][1:] != b[order][:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new)
    return order, number


def permutation_importance(model: PipelineModel, df: DataFrame, factors: list[str], repeats: int = 10, seed: int = 42, keys=(CODE, DATE)) -> DataFrame:
    """Rise of the squared error when a factor is permuted, over ``repeats`` permutations.

    Every (factor, repeat) is a copy of the rows with one column replaced, as by
    :func:`shuffled_column`. Copies are exchanged whole, once, to the groups among which values are
    permuted; so neither values nor copies are joined. Rows without a key give their value only,
    and where a key comes twice, each of its rows takes each of its values. Copies, or some groups
    of one, are taken in turns of ``TURN_ROWS`` rows, so that the disk never holds all copies.
    """
    k = list(keys)
    spark = df.sparkSession
    with brief_shuffles(spark):
        data = stored(fill_zero(df.select(*k, *factors, TARGET), factors), "permuted")
        n = data.count()
    groups = max(1, math.ceil(n / GROUP_ROWS))
    mixes = [(f, r, seed + 100 * j + r) for j, f in enumerate(factors) for r in range(repeats)]
    columns = [*factors, TARGET]
    schema = ", ".join(["_mix int", *(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in columns)])
    moved = [f for f, _, _ in mixes]
    mix = F.col("_mix")
    own = F.get(F.array(*[F.lit(s) for _, _, s in mixes]), mix)

    def permute(group: pa.Table) -> pa.Table:
        col = moved[group["_mix"][0].as_py()]
        takers, number = digest_order(group, "_to", k)
        givers, _ = digest_order(group, "_from", k)
        given = np.empty(len(takers), dtype=np.int64)
        given[takers] = givers
        rows = np.flatnonzero(np.logical_and.reduce([group[c].is_valid().to_numpy() for c in k]))
        mixed = pd.DataFrame({"number": number[rows], "row": rows, "value": given[rows]})
        if not mixed["number"].is_unique:
            mixed = mixed[["number", "row"]].merge(mixed[["number", "value"]], on="number")
        out = group.select(["_mix", *columns]).take(pa.array(mixed["row"]))
        return out.set_column(out.column_names.index(col), out.schema.field(col), group[col].take(pa.array(mixed["value"])))

    def errors(chosen: range, part: int, parts: int) -> list:
        copies = data.withColumn("_mix", F.explode(F.array(*[F.lit(i) for i in chosen]))).withColumn("_g", (key_number(own, k) % groups).cast("int"))
        tasks = max(1, math.ceil(n * len(chosen) / parts / TASK_ROWS))
        dealt = copies.where(F.col("_g") % parts == part).repartition(tasks, "_mix", "_g")
        placed = dealt.select("*", *[F.unhex(key_digest(own * 31 + salt, k)).alias(name) for salt, name in ((1, "_to"), (2, "_from"))])
        mixed = placed.groupBy("_mix", "_g").applyInArrow(permute, schema)
        predicted = model.transform(mixed)
        e = F.col("prediction") - F.col(TARGET)
        return predicted.groupBy("_mix").agg(F.sum(e * e).alias("sum"), F.count(e).alias("n")).collect()

    turn = max(TURN_ROWS, spark.sparkContext.defaultParallelism * TASK_ROWS)
    together, parts = max(1, turn // max(n, 1)), max(1, math.ceil(n / turn))
    sums = {}
    with brief_shuffles(spark):
        for first in range(0, len(mixes), together):
            for part in range(parts):
                for r in errors(range(first, min(first + together, len(mixes))), part, parts):
                    total, known = sums.get(r["_mix"], (0.0, 0))
                    sums[r["_mix"]] = (total + (r["sum"] or 0.0), known + r["n"])
        base = regression_metrics(model.transform(data)).first()["mse"]
    found = [(moved[i], total / known - base if known else None) for i, (total, known) in sorted(sums.items())]
    return spark.createDataFrame(found, "feature string, d double").groupBy("feature").agg(
        F.avg("d").alias("importance"), F.stddev_pop("d").alias("importance_std"), F.min("d").alias("importance_min"), F.max("d").alias("importance_max")
    )


def partial_dependence(model: PipelineModel, df: DataFrame, factors: list[str], feature: str, resolution: int = 50) -> DataFrame:
    """Mean prediction with one factor set to each point of an even grid over its range.

    The grid is an array of ``resolution`` numbers computed from the factor's range, so each row
    is repeated inside its task.
    """
    data = fill_zero(df.select(*factors), factors)
    span = data.agg(F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))  # one row
    grid = F.transform(F.sequence(F.lit(0), F.lit(resolution - 1)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (resolution - 1))
    wide = data.crossJoin(F.broadcast(span)).select(*[c for c in factors if c != feature], F.posexplode(grid).alias("grid_index", feature))
    return model.transform(wide).groupBy("grid_index").agg(F.first(feature).alias("feature_value"), F.avg("prediction").alias("pdp_value"))


def interaction_strength(model: PipelineModel, df: DataFrame, factors: list[str], pairs: list[tuple[str, str]], seed: int = 7, keys=(CODE, DATE)) -> DataFrame:
    """Effect of permuting two factors together against permuting each alone."""
    k = list(keys)
    data = fill_zero(df.select(*k, *factors), factors)
    n = data.count()
    used = sorted({f for p in pairs for f in p})
    wide = data
    for j, f in enumerate(used):
        wide = wide.join(shuffled_column(data, k, f, seed + j, rows=n).withColumnRenamed(f, f"_p_{f}"), k)
    variants = [("_base", ())] + [(f, (f,)) for f in used] + [(f"{a}*{b}", (a, b)) for a, b in pairs]
    rows = F.explode(
        F.array(*[F.struct(F.lit(name).alias("variant"), *[F.col(f"_p_{c}" if c in swap else c).alias(c) for c in factors]) for name, swap in variants])
    )
    scored = model.transform(wide.select(*k, rows.alias("r")).select(*k, "r.*")).select(*k, "variant", "prediction")
    pivot = scored.groupBy(*k).pivot("variant", [v for v, _ in variants]).agg(F.first("prediction"))
    base = F.col("_base")
    aggs = []
    for a, b in pairs:
        joint = F.avg(F.abs(base - F.col(f"`{a}*{b}`")))
        single = F.avg(F.abs(base - F.col(a)) + F.abs(base - F.col(b)))
        aggs.append(F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), (joint / (single + 1e-8)).alias("interaction_strength")))
    return pivot.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def global_importance(model: PipelineModel, df: DataFrame, factors: list[str], fraction: float, seed: int = 42, keys=(CODE, DATE)) -> DataFrame:
    """Permutation importance on a sample of the rows, chosen by digest of the key."""
    some = df.where(key_number(seed, list(keys)) < F.lit(fraction * 2**32))
    return permutation_importance(model, some, factors, seed=seed, keys=keys)
