"""Signals, selection against holdings, sizing and set-based portfolio returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators import crosssection as X
from alphaloom.session import stored
from alphaloom.operators.joins import not_held

CODE, DATE = "ts_code", "trade_date"


def rebalance_flag(frequency: str, day: str = DATE, first: Column | None = None) -> Column:
    """Whether a day is a rebalance day: every day, Mondays, or the first of a month.

    The month test compares with the calendar day before. The first day always counts.
    """
    d = F.col(day)
    test = {
        "daily": F.lit(True),
        "weekly": F.dayofweek(d) == 2,
        "monthly": F.month(d) != F.month(F.date_sub(d, 1)),
    }[frequency]
    return test | first if first is not None else test


def with_rebalance(calendar: DataFrame, frequency: str) -> DataFrame:
    """Trading days with the flag and the rebalance day in force, one row per day of history."""
    order = W.orderBy(DATE)
    flagged = calendar.withColumn("is_rebalance", rebalance_flag(frequency, DATE, F.row_number().over(order) == 1))
    held = F.last(F.when(F.col("is_rebalance"), F.col(DATE)), ignorenulls=True)
    # A day's return belongs to the holdings chosen before it.
    return flagged.withColumn("held_since", held.over(order.rowsBetween(W.unboundedPreceding, -1)))


def exit_reasons(holdings: DataFrame, scores: DataFrame, stop_loss: float | None, take_profit: float | None, min_days: int, threshold: float) -> DataFrame:
    """Reason to sell each holding, null to keep it; the first rule that applies decides."""
    joined = holdings.join(scores.select(CODE, F.col("score").alias("_score")), CODE, "left")
    r = F.col("unrealized_return")
    stop = (r <= -stop_loss) if stop_loss else F.lit(False)
    take = (r >= take_profit) if take_profit else F.lit(False)
    reason = (
        F.when(stop, "stop_loss")
        .when(take, "take_profit")
        .when(F.col("holding_days") < min_days, F.lit(None))
        .when(F.col("_score") < threshold, "score_drop")
        .when(F.col("_score").isNull(), "not_scored")
    )
    return joined.withColumn("sell_reason", reason).drop("_score")


def candidates(scores: DataFrame, holdings: DataFrame, method: str, slots: int | None = None, threshold: float | None = None) -> DataFrame:
    """Securities to buy that are not held: the best ``slots``, or all above the threshold."""
    free = not_held(scores, holdings)
    if method == "top_score":
        return free.orderBy(F.desc("score"), CODE).limit(slots)
    return free.where(F.col("score") >= threshold)


def under_industry_cap(candidates: DataFrame, holdings: DataFrame, cap: float) -> DataFrame:
    """Keep candidates whose industry's share of the held value is below the cap."""
    value = holdings.groupBy("industry").agg(F.sum("current_value").alias("_v"))
    total = holdings.agg(F.sum("current_value").alias("_t"))  # one row
    share = value.crossJoin(F.broadcast(total)).select("industry", F.try_divide("_v", "_t").alias("_share"))
    out = candidates.join(share, "industry", "left")
    return out.where(F.coalesce("_share", F.lit(0.0)) < cap).drop("_share")


def size_orders(df: DataFrame, total_value: float, cash: float, position_size: float, cost: float, lot: int = 100) -> DataFrame:
    """Whole lots that the target amount and the cash allow, with amount and commission."""
    budget = F.least(F.lit(total_value * position_size), F.lit(cash / (1 + cost)))
    shares = (F.floor(F.try_divide(budget, F.col("price")) / lot) * lot).cast("long")
    out = df.withColumn("shares", F.when(budget >= F.col("price"), shares).otherwise(F.lit(0)))
    out = out.withColumn("amount", F.col("shares") * F.col("price"))
    return out.withColumn("commission", F.col("amount") * cost).where(F.col("shares") > 0)


def mark_to_market(holdings: DataFrame, bars: DataFrame) -> DataFrame:
    """Value, gain and return of holdings at the bars' closes; no bar keeps the cost price."""
    out = holdings.join(bars.select(CODE, F.col("close").alias("_px")), CODE, "left")
    price = F.coalesce(F.col("_px"), F.col("avg_cost"))
    value, cost = F.col("shares") * price, F.col("shares") * F.col("avg_cost")
    return out.withColumns(
        {
            "current_price": price,
            "current_value": value,
            "unrealized_pnl": value - cost,
            "unrealized_return": F.try_divide(value - cost, cost),
        }
    ).drop("_px")


def position_weights(selected: DataFrame, method: str = "equal", by: str = DATE) -> DataFrame:
    """Weights of a selection per day; the selection per day is a top-n list."""
    day = W.partitionBy(by)
    weight = F.lit(1.0) / F.count("*").over(day) if method == "equal" else F.try_divide(F.col("score"), F.sum("score").over(day))
    return selected.withColumn("weight", weight)


def blend(df: DataFrame) -> DataFrame:
    """Technical, fundamental and sentiment scores at 0.4, 0.4 and 0.2."""
    return df.withColumn("total_score", F.col("technical") * 0.4 + F.col("fundamental") * 0.4 + F.col("sentiment") * 0.2)


def portfolio_metrics(df: DataFrame, by: list[str], risk_free: float = 0.03) -> DataFrame:
    """Expected return, risk without correlation, and their ratio."""
    out = df.groupBy(*by).agg(
        F.sum(F.col("weight") * F.col("expected_return")).alias("portfolio_return"),
        F.sqrt(F.sum(F.pow(F.col("weight") * F.col("expected_risk"), F.lit(2.0)))).alias("portfolio_risk"),
        F.count("*").alias("num_stocks"),
    )
    return out.withColumn("sharpe_ratio", F.try_divide(F.col("portfolio_return") - risk_free, F.col("portfolio_risk")))


def momentum_signals(bars: DataFrame, window: int = 20, buy: float = 0.05, sell: float = -0.05) -> DataFrame:
    w = W.partitionBy(CODE).orderBy(DATE)
    filled = bars.withColumn("_p", F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = filled.withColumn("momentum", F.try_divide(F.col("_p"), F.lag("_p", window).over(w)) - 1).where(F.col("momentum").isNotNull())
    signal = F.when(F.col("momentum") > buy, "BUY").when(F.col("momentum") < sell, "SELL").otherwise("HOLD")
    return out.select(CODE, DATE, signal.alias("signal"), F.col("close").alias("price"), "momentum")


def backtest(scores: DataFrame, returns: DataFrame, calendar: DataFrame, top_n: int, frequency: str = "monthly", cost: float = 0.0) -> DataFrame:
    """Daily returns of many score-driven portfolios at once.

    On each rebalance day every strategy takes its best ``top_n`` securities at equal weight and
    keeps the weights until the next one. A day's return is the weighted sum of the members'
    returns (none counts as 0), less cost times turnover on the first day of a new holding.
    Weights do not drift, lots are not rounded and cash is not limited.

    ``scores`` is keyed by (strategy_id, ts_code, trade_date). Selection keeps at most ``top_n``
    rows per strategy and day before the exchange; later tables are of that size times the days.
    """
    days = with_rebalance(calendar, frequency)
    picks = scores.join(days.where(F.col("is_rebalance")).select(DATE), DATE, "left_semi")
    picks = X.top_per_group(picks.where(F.col("score").isNotNull()), ["strategy_id", DATE], [F.desc("score"), F.asc(CODE)], top_n)
    size = W.partitionBy("strategy_id", "held_since")  # at most top_n rows
    held = picks.select("strategy_id", CODE, F.col(DATE).alias("held_since")).withColumn("weight", F.lit(1.0) / F.count("*").over(size))

    # Turnover: half the sum of weight changes between consecutive holdings of a strategy.
    order = W.orderBy("held_since")
    starts = days.where(F.col("is_rebalance")).select(F.col(DATE).alias("held_since")).withColumn("_next", F.lead("held_since").over(order))
    leaving = held.join(starts, "held_since").where(F.col("_next").isNotNull()).select(
        "strategy_id", CODE, F.col("_next").alias("held_since"), (-F.col("weight")).alias("weight")
    )
    moves = held.unionByName(leaving).groupBy("strategy_id", "held_since", CODE).agg(F.abs(F.sum("weight")).alias("m"))
    turnover = moves.groupBy("strategy_id", "held_since").agg((F.sum("m") / 2).alias("turnover"))

    span = days.where(F.col("held_since").isNotNull()).select(DATE, "held_since")
    first = span.groupBy("held_since").agg(F.min(DATE).alias("first_day"))
    daily = held.join(span, "held_since").join(returns.select(CODE, DATE, "return_rate"), [CODE, DATE], "left")
    gross = daily.groupBy("strategy_id", DATE, "held_since").agg(
        F.sum(F.col("weight") * F.coalesce("return_rate", F.lit(0.0))).alias("gross_return"), F.count("*").alias("positions")
    )
    out = gross.join(first, "held_since").join(turnover, ["strategy_id", "held_since"], "left")
    charge = F.when(F.col(DATE) == F.col("first_day"), F.coalesce("turnover", F.lit(0.0)) * cost).otherwise(0.0)
    return out.select("strategy_id", DATE, "held_since", "positions", "gross_return", (F.col("gross_return") - charge).alias("return"))


def benchmark_returns(index: DataFrame) -> DataFrame:
    """Returns of a benchmark series with one row per day."""
    w = W.partitionBy("index_code").orderBy(DATE)
    return index.withColumn("return", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)


def match_score(template=F.col) -> Column:
    """How well a strategy template suits an investor, 0..1; ``template`` gives a template's column by name."""
    level = {"beginner": 1, "intermediate": 3, "advanced": 5}
    experience = F.lit(3)
    for name, value in level.items():
        experience = F.when(F.col("experience") == name, value).otherwise(experience)
    horizon, kind, risk = F.col("time_horizon"), template("category"), template("risk_level")
    fits = (
        ((kind == "conservative") & (horizon >= 12))
        | ((kind == "balanced") & horizon.between(6, 36))
        | ((kind == "aggressive") & (horizon <= 24))
    )
    score = (
        (F.lit(1.0) - F.abs(F.col("risk_tolerance") - risk * 2) / 10) * 0.4
        + (F.lit(1.0) - F.abs(experience - risk) / 5) * 0.2
        + F.when(fits, 1.0).otherwise(0.5) * 0.2
        + F.when(template("expected_volatility") * 2 <= F.col("loss_tolerance"), 1.0).otherwise(0.5) * 0.2
    )
    # Nine digits, so that equal matches tie whatever the order of the sum.
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 9)


def risk_class(tolerance: str = "risk_tolerance") -> Column:
    t = F.col(tolerance)
    return F.when(t <= 3, "conservative").when(t <= 7, "balanced").otherwise("aggressive")


def _template_blocks(templates: DataFrame, keep: int, block: int) -> tuple[DataFrame, int]:
    """(block, list): lists of at most about ``block`` templates, and how many there are.

    A score looks at risk level, category and volatility only; of templates that agree in these, none
    but the first ``keep`` by id can be among an investor's best.
    """
    first = X.top_per_group(templates, ["risk_level", "category", "expected_volatility"], [F.asc("template_id")], keep).drop("rank")
    first = stored(first, "templates")
    blocks = max(1, -(-first.count() // block))
    own = F.struct(*[F.col(c) for c in templates.columns]).alias("t")
    lists = first.select(F.pmod(F.xxhash64("template_id"), F.lit(blocks)).alias("block"), own).groupBy("block").agg(F.collect_list("t").alias("list"))
    return stored(lists, "template-blocks"), blocks


def recommend_templates(profiles: DataFrame, templates: DataFrame, keep: int = 3, floor: float = 0.5, block: int = 500) -> DataFrame:
    """Best templates per investor with settings adjusted to the investor.

    Templates are a stated set that investors meet in blocks: each investor row is scored against
    one block's list inside its own task and keeps its best ``keep``, and the best of all blocks
    are ranked. So rows grow with investors times blocks, never with investors times templates.
    """
    lists, blocks = _template_blocks(templates, keep, block)
    dealt = profiles.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))) if blocks > 1 else profiles.withColumn("block", F.lit(0).cast("long"))
    met = dealt.join(lists, "block")

    def scored(t: Column) -> Column:
        score = match_score(lambda c: t[c])
        return F.struct((-score).alias("less"), t["template_id"].alias("template_id"), t.alias("t"))

    fit = F.filter(F.transform("list", scored), lambda s: -s["less"] > floor)
    best = met.withColumn("best", F.slice(F.array_sort(fit), 1, keep)).drop("list", "block")
    rows = best.select(*profiles.columns, F.explode("best").alias("b"))
    rows = rows.select(*profiles.columns, "b.t.*", (-F.col("b.less")).alias("match_score"))
    top = X.top_per_group(rows, "user_id", [F.desc("match_score"), F.asc("template_id")], keep)
    t = F.col("risk_tolerance")
    positions = F.col("max_positions")
    slower = F.when(F.col("rebalance_frequency") == "daily", "weekly").when(F.col("rebalance_frequency") == "weekly", "monthly").otherwise(F.col("rebalance_frequency"))
    return top.withColumns(
        {
            "position_size": F.when(t <= 3, F.col("position_size") * 0.8).when(t >= 8, F.col("position_size") * 1.2).otherwise(F.col("position_size")),
            "max_positions": F.when(t <= 3, F.least(positions + 3, F.lit(20))).when(t >= 8, F.greatest(positions - 2, F.lit(5))).otherwise(positions),
            "rebalance_frequency": F.when(F.col("time_horizon") >= 24, slower).otherwise(F.col("rebalance_frequency")),
            "stop_loss": F.when(F.col("stop_loss") > 0, F.least("stop_loss", "loss_tolerance")).otherwise(F.col("stop_loss")),
            "risk_class": risk_class(),
        }
    )
