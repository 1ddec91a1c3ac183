"""Group statistics, exact quantiles and ranks that hold when one group is very large.

A trading date, an industry or a factor name can own a large share of all rows, so nothing here
puts a whole group into one task unless its size was checked first:

* moments are grouped with map-side combine and joined back, one small row per group. For a large
  input the statistics are written first and counted: up to ``BROADCAST_ROWS`` rows are broadcast,
  so the rows themselves are not shuffled; more groups are joined by exchange;
* quantiles and ranks first count equal values. If no group is larger than ``HOT_ROWS`` they use
  a plain grouping or window. Otherwise each group is cut at ``SPLITS`` of its own values, chosen
  by hash so that every attempt of a task chooses the same ones, and the pieces are ranked apart
  and shifted by the totals of the pieces before them. Both ways give the same exact result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.session import cut

HOT_ROWS = 4_000_000  # largest group handled by a single task
SMALL_INPUT_BYTES = 64 * 1024 * 1024  # an input this small fits one task whole
SPLITS = 512  # pieces per hot group
SALTS = 256  # parts of a group in a long top list
BROADCAST_ROWS = 200_000  # largest statistics table sent to every executor


def _cols(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan's inputs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes)


def has_hot_group(df: DataFrame, by) -> bool:
    """Whether some group exceeds ``HOT_ROWS``; counts only when the input is large enough."""
    if estimated_bytes(df) <= SMALL_INPUT_BYTES:
        return False
    sizes = df.groupBy(*_cols(by)).agg(F.count("*").alias("rows"))
    return not sizes.where(F.col("rows") > HOT_ROWS).limit(1).isEmpty()


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys treating null as a value, keeping one copy of each key."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, by, how: str = "left") -> DataFrame:
    """Join one row of statistics per group to the rows of the group, null keys included.

    Behind a large input the statistics are cut from their lineage, so that chained operators do
    not repeat the work before them, and broadcast if their counted size allows it. Otherwise
    adaptive execution picks the join and splits skewed keys.
    """
    if estimated_bytes(df) > SMALL_INPUT_BYTES:
        stats = cut(stats)
        if stats.count() <= BROADCAST_ROWS:
            stats = F.broadcast(stats)
    return join_groups(df, stats, _cols(by), how)


def group_stats(df: DataFrame, by, **aggs: Column) -> DataFrame:
    """Add aggregates of each row's group as columns."""
    keys = _cols(by)
    return attach(df, df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()]), keys)


def _split_points(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Up to ``SPLITS`` values per group with the smallest hashes, sorted.

    The per-group limit on the hash order runs before the exchange, so a task receives at most
    ``SPLITS`` rows per group and map task.
    """
    hashed = values.select(*keys, value, F.xxhash64(value).alias("_h"))
    first = W.partitionBy(*keys).orderBy("_h", value)
    picked = hashed.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= SPLITS)
    return picked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_splits"))


def _smaller_in(array: str, value: str) -> Column:
    """Number of elements of a sorted array below the value, by halving steps."""
    steps = [1 << b for b in range(SPLITS.bit_length() - 1, -1, -1)]

    def advance(pos, step):
        return pos + F.when(F.get(array, pos + step - 1) < F.col(value), step).otherwise(0)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def value_positions(df: DataFrame, by, value: str, hot: bool | None = None) -> DataFrame:
    """Distinct non-null values of each group with their place in the sorted group.

    Columns: keys, value, ``_ties`` (rows with the value), ``_below`` (rows with a smaller value)
    and ``_n`` (non-null rows of the group).
    """
    keys = _cols(by)
    hot = has_hot_group(df, keys) if hot is None else hot
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    before = F.sum("_ties")
    if not hot:
        w = W.partitionBy(*keys).orderBy(value)
        return counted.select(
            *keys,
            value,
            "_ties",
            F.coalesce(before.over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
            before.over(W.partitionBy(*keys)).alias("_n"),
        )
    counted = cut(counted)  # every branch below must see the same values to the last bit
    splits = _split_points(counted, keys, value)
    pieces = join_groups(counted, splits, keys).withColumn("_piece", _smaller_in("_splits", value)).drop("_splits")
    totals = pieces.groupBy(*keys, "_piece").agg(F.sum("_ties").alias("_rows"))
    group = W.partitionBy(*keys)  # at most SPLITS + 1 rows
    offsets = totals.select(
        *keys,
        "_piece",
        F.coalesce(F.sum("_rows").over(group.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_rows").over(group).alias("_n"),
    )
    inside = W.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = pieces.withColumn("_inside", F.coalesce(before.over(inside), F.lit(0)))
    return join_groups(ranked, offsets, [*keys, "_piece"]).select(
        *keys, value, "_ties", (F.col("_start") + F.col("_inside")).alias("_below"), "_n"
    )


def with_positions(df: DataFrame, by, value: str, prefix: str = "_", hot: bool | None = None) -> DataFrame:
    """Add ``below``, ``ties`` and ``n`` of the row's value inside its group; null for null."""
    return with_all_positions(df, [(by, value, prefix)], hot)


def with_all_positions(df: DataFrame, specs: list[tuple], hot: bool | None = None) -> DataFrame:
    """Positions of several columns, each given as (group, column, prefix).

    On the split path every column is placed from the same input and joined to it, so the plan
    grows with the number of columns only.
    """
    split = [has_hot_group(df, _cols(by)) if hot is None else hot for by, _, _ in specs]
    if any(split):
        df = cut(df)  # places are joined back by value, so both sides must hold equal floats
    out = df
    for (by, value, prefix), apart in zip(specs, split):
        keys = _cols(by)
        names = {"_below": f"{prefix}below", "_ties": f"{prefix}ties", "_n": f"{prefix}n"}
        if not apart:
            group = W.partitionBy(*keys)
            known = F.col(value).isNotNull()
            out = out.select(
                "*",
                F.when(known, (F.rank().over(group.orderBy(F.col(value).asc_nulls_last())) - 1).cast("long")).alias(names["_below"]),
                F.when(known, F.count(value).over(W.partitionBy(*keys, value))).alias(names["_ties"]),
                F.when(known, F.count(value).over(group)).alias(names["_n"]),
            )
        else:
            places = value_positions(df.select(*dict.fromkeys([*keys, value])), keys, value, True)
            out = join_groups(out, places.withColumnsRenamed(names), [*keys, value])
    return out


def average_rank(prefix: str = "_", ascending: bool = True) -> Column:
    """One-based mean rank of tied values, from the columns of :func:`with_positions`."""
    below, ties, n = (F.col(prefix + c) for c in ("below", "ties", "n"))
    up = below + (ties + 1) / 2
    return up if ascending else n + 1 - up


def cumulative_share(prefix: str = "_") -> Column:
    """Share of the group's values at or below the row's value."""
    return (F.col(prefix + "below") + F.col(prefix + "ties")) / F.col(prefix + "n")


def group_quantiles(df: DataFrame, by, value: str, probs: dict[str, float], hot: bool | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group."""
    keys = _cols(by)
    hot = has_hot_group(df, keys) if hot is None else hot
    if not hot:
        q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
        return df.groupBy(*keys).agg(q.alias("_q")).select(
            *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
        )
    places = value_positions(df, keys, value, hot)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n").cast("double") - 1) * p
        for part, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("_below") <= at) & (at < F.col("_below") + F.col("_ties"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{part}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_w_{name}"))
    picked = places.groupBy(*keys).agg(*aggs)

    def between(name):  # the same arithmetic as the built-in percentile
        lo, hi, w = (F.col(f"_{part}_{name}") for part in ("lo", "hi", "w"))
        return F.when(lo == hi, lo).otherwise((F.lit(1.0) - w) * lo + w * hi).alias(name)

    out = picked.select(*keys, *[between(n) for n in probs])
    everyone = df.select(*keys).distinct()  # keep groups whose values are all null
    return join_groups(everyone, out, keys)


def with_quantiles(df: DataFrame, by, value: str, probs: dict[str, float], hot: bool | None = None) -> DataFrame:
    return with_all_quantiles(df, by, {value: probs}, hot)


def with_all_quantiles(df: DataFrame, by, wanted: dict[str, dict[str, float]], hot: bool | None = None) -> DataFrame:
    """Quantiles of several columns by one grouping: ``wanted`` maps a column to names and shares."""
    keys = _cols(by)
    hot = has_hot_group(df, keys) if hot is None else hot
    if hot:
        out = df
        for value, probs in wanted.items():
            out = attach(out, group_quantiles(df.select(*dict.fromkeys([*keys, value])), keys, value, probs, True), keys)
        return out
    aggs = [F.percentile(c, F.array(*[F.lit(float(p)) for p in probs.values()])).alias(f"_q{i}") for i, (c, probs) in enumerate(wanted.items())]
    names = [F.col(f"_q{i}")[j].alias(n) for i, probs in enumerate(wanted.values()) for j, n in enumerate(probs)]
    return attach(df, df.groupBy(*keys).agg(*aggs).select(*keys, *names), keys)


def with_median_mad(df: DataFrame, by, value: str, hot: bool | None = None) -> DataFrame:
    """Add ``_med`` and ``_mad`` (median absolute deviation from the median) of the group."""
    return with_all_median_mad(df, by, {value: ("_med", "_mad")}, hot)


def with_all_median_mad(df: DataFrame, by, wanted: dict[str, tuple[str, str]], hot: bool | None = None) -> DataFrame:
    """Median and median absolute deviation of several columns, two groupings in all."""
    keys = _cols(by)
    hot = has_hot_group(df, keys) if hot is None else hot
    out = with_all_quantiles(df, keys, {c: {med: 0.5} for c, (med, _) in wanted.items()}, hot)
    out = out.withColumns({f"_dev_{c}": F.abs(F.col(c) - F.col(med)) for c, (med, _) in wanted.items()})
    out = with_all_quantiles(out, keys, {f"_dev_{c}": {mad: 0.5} for c, (_, mad) in wanted.items()}, hot)
    return out.drop(*[f"_dev_{c}" for c in wanted])


def top_per_group(df: DataFrame, by, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group with their number in ``rank``.

    Up to a thousand rows the optimizer applies the limit before the exchange too, so a task
    receives at most ``k`` rows per group and map task. Beyond that the rows are first limited
    inside salted parts of the group, which hold the group's first ``k`` between them.
    """
    keys = _cols(by)
    w = W.partitionBy(*keys).orderBy(*order)
    if k > 1000:
        part = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        inner = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = part.withColumn("_i", F.row_number().over(inner)).where(F.col("_i") <= k).drop("_salt", "_i")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bucket_by_edges(df: DataFrame, by, value: str, n: int, out: str, hot: bool | None = None, min_rows: int = 0) -> DataFrame:
    """Equal-frequency bucket 1..n inside the group; equal edges are merged.

    Groups with fewer than ``min_rows`` rows are left out.
    """
    keys = _cols(by)
    hot = has_hot_group(df, keys) if hot is None else hot
    shares = [i / n for i in range(n + 1)]
    size = F.count("*").alias("_size")
    if hot:
        names = {f"_e{i}": p for i, p in enumerate(shares)}
        edges = group_quantiles(df.select(*dict.fromkeys([*keys, value])), keys, value, names, True)
        edges = edges.select(*keys, F.array(*names).alias("_edges"))
        if min_rows:
            edges = join_groups(edges, df.groupBy(*keys).agg(size), keys)
    else:
        edges = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for p in shares])).alias("_edges"), size)
    if min_rows:
        edges = edges.where(F.col("_size") >= min_rows)
    edges = edges.select(*keys, F.array_distinct("_edges").alias("_edges"))
    joined = attach(df, edges, keys, "inner" if min_rows else "left")
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bucket = F.lit(1) + F.size(F.filter(inner, lambda e: e < F.col(value)))
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), bucket)).drop("_edges")
