"""Weighted scores, rankings, selection and factor weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.scalars import clip, sigmoid_score
from alphaloom.operators import crosssection as X

CODE, DATE = "ts_code", "trade_date"


def weighted_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the known factors and its logistic score on 0..100.

    Both are rounded far below their use, so that equal scores tie whatever the order of the sums.
    """
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * v, F.lit(0.0)) for c, v in weights.items()])
    return df.withColumn("weighted_score", F.round(total, 10)).withColumn("score", F.round(sigmoid_score("weighted_score"), 8))


def rankings(df: DataFrame, by: str = DATE, industry: str = "industry", score: str = "score") -> DataFrame:
    """Distinct places in the market and in the industry, best first, ties by code.

    The order value is the pair of negative score and code, so every row has its own place and
    the exact ranks come from counting smaller pairs.
    """
    out = df.withColumn("_o", F.when(F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(CODE).alias("c"))))
    out = X.with_all_positions(out, [(by, "_o", "_all"), ([by, industry], "_o", "_ind")])
    return out.withColumns({"rank_overall": F.col("_allbelow") + 1, "industry_rank": F.col("_indbelow") + 1}).drop(
        "_o", "_allbelow", "_allties", "_alln", "_indbelow", "_indties", "_indn"
    )


def stored_scores(df: DataFrame, day=None, industry: str | None = None, top_n: int | None = None) -> DataFrame:
    """Scores of a day and industry, best first, optionally only the first ones."""
    if day is not None:
        df = df.where(F.col(DATE) == F.lit(day).cast("date"))
    if industry is not None:
        df = df.where(F.col("industry") == industry)
    df = df.orderBy(F.desc("score"), CODE)
    return df.limit(top_n) if top_n else df


def top_stocks(df: DataFrame, top_n: int, min_score: float | None = None, by: str = DATE) -> DataFrame:
    """Best ``top_n`` per day first, the minimum score applied to those only."""
    top = X.top_per_group(df, by, [F.desc("score"), F.asc(CODE)], top_n)
    return top.where(F.col("score") >= min_score) if min_score is not None else top


def industry_balanced(df: DataFrame, total: int, by: str = DATE, industry: str = "industry", min_score: float | None = None) -> DataFrame:
    """Top securities with an even quota per industry; the first industries take the remainder.

    Industries are numbered by their best score of the day. Rows are limited per industry before
    the quota is known, as no quota exceeds ``total``.
    """
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    groups = df.groupBy(by, industry).agg(F.max("score").alias("_best"))
    day = W.partitionBy(by)  # one row per industry
    groups = groups.select(
        by,
        industry,
        F.count("*").over(day).alias("_k"),
        (F.row_number().over(day.orderBy(F.desc("_best"), industry)) - 1).alias("_i"),
    )
    base = F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("_k")))
    groups = groups.withColumn("_quota", base + F.when(F.col("_i") < total % F.col("_k"), 1).otherwise(0)).drop("_k", "_i")
    first = X.top_per_group(df, [by, industry], [F.desc("score"), F.asc(CODE)], total)
    return first.join(groups, [by, industry]).where(F.col("rank") <= F.col("_quota")).drop("_quota")


def score_statistics(df: DataFrame, days: list | DataFrame, window: int = 30) -> DataFrame:
    """Statistics of each security over the ``window`` days up to each report day, with trend.

    ``days`` is a table of report days. The trend compares with the security's previous report.
    """
    span = F.explode(F.sequence(F.lit(0), F.lit(window))).alias("_back")
    reach = days.select(F.col("report_date"), span).select("report_date", F.date_sub("report_date", F.col("_back")).alias(DATE))
    stats = df.join(reach, DATE).groupBy(CODE, "report_date").agg(
        F.avg("score").alias("avg_score_30d"),
        F.stddev_samp("score").alias("std_score_30d"),
        F.max("score").alias("max_score_30d"),
        F.min("score").alias("min_score_30d"),
        F.avg("rank_overall").alias("avg_rank_30d"),
    )
    before = F.lag("avg_score_30d").over(W.partitionBy(CODE).orderBy("report_date"))
    return stats.withColumn(
        "score_trend",
        F.when(F.col("avg_score_30d") > before, "up").when(F.col("avg_score_30d") < before, "down").otherwise("stable"),
    )


def derive_weights(importance: DataFrame, history: DataFrame | None = None, decay: float = 0.95, lo: float = 0.01, hi: float = 0.3) -> DataFrame:
    """Blend importance with earlier weights, limit, and scale to a sum of one per model.

    A model holds one row per factor, so the window over a model is small.
    """
    raw: Column = F.col("importance")
    out = importance
    if history is not None:
        out = importance.join(history.select("model_name", "factor_name", F.col("weight").alias("_old")), ["model_name", "factor_name"], "left")
        raw = F.when(F.col("_old").isNotNull(), F.col("importance") * (1 - decay) + F.col("_old") * decay).otherwise(F.col("importance"))
    out = out.withColumn("_w", clip(raw, lo, hi))
    model = W.partitionBy("model_name")
    total = F.sum("_w").over(model)
    return out.select("model_name", "factor_name", F.when(total > 0, F.col("_w") / total).otherwise(F.lit(1.0) / F.count("*").over(model)).alias("weight"))


def weight_stability(current: DataFrame, history: DataFrame) -> DataFrame:
    keys = ["model_name", "factor_name"]
    joined = current.join(history.select(*keys, F.col("weight").alias("_old")), keys, "left")
    moved = F.abs(F.col("weight") - F.col("_old")) / F.greatest(F.col("_old"), F.lit(0.01))
    value = F.when(F.col("_old").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - moved))
    return joined.withColumn("stability", value).drop("_old")


def weight_changes(old: DataFrame, new: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Rows to log: factors whose weight moved by more than the threshold; absent counts as 0."""
    keys = ["model_name", "factor_name"]
    both = old.select(*keys, F.col("weight").alias("old_weight")).join(new.select(*keys, F.col("weight").alias("new_weight")), keys, "full_outer")
    both = both.fillna(0.0, ["old_weight", "new_weight"]).withColumn("change", F.col("new_weight") - F.col("old_weight"))
    return both.where(F.abs("change") > threshold)


def weight_history(log: DataFrame, model: str | None = None, factor: str | None = None, since=None) -> DataFrame:
    if model is not None:
        log = log.where(F.col("model_name") == model)
    if factor is not None:
        log = log.where(F.col("factor_name") == factor)
    if since is not None:
        log = log.where(F.col("changed_at") >= since)
    return log.orderBy(F.desc("changed_at"), "factor_name")


def weight_history_stability(log: DataFrame) -> DataFrame:
    """Change statistics per factor; a factor with one entry is stable."""
    moved = F.col("new_weight") - F.col("old_weight")
    many = F.count("*") > 1
    return log.groupBy("factor_name").agg(
        F.count("*").alias("change_count"),
        F.when(many, F.avg(moved)).otherwise(0.0).alias("avg_change"),
        F.when(many, F.stddev_samp(moved)).otherwise(0.0).alias("std_change"),
        F.when(many, F.max(F.abs(moved))).otherwise(0.0).alias("max_change"),
        F.when(many, F.lit(1.0) / (F.avg(F.abs(moved)) + 1)).otherwise(1.0).alias("stability_score"),
    )
