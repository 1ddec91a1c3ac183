"""Forests and boosted trees of Spark ML on rows that are summed by cell first.

A tree of Spark ML puts every factor into bins before it grows, and weighs a split by the counts and
the sums of the target in the bins alone. Rows that share the bins of all factors therefore count by
their number and their sum: what the targets of a cell differ among themselves is on both sides of
every comparison. So the bins are cut once, all rows are summed by cell, and the estimators grow the
same trees on weighted cells, however many rows there are. The bootstrap of a forest is drawn row by
row, before the sums. Without it each level of each tree would read all rows, each with a count for
every tree.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.session import scratch_path, stored

#: Bins of a factor, as the estimators have them.
BINS = 32
#: Cells in all. A task of the bootstrap holds two numbers for each, for every tree.
CELLS = 65_536
#: Rows that a task of the bootstrap takes at least, so that its sums stay fewer than its rows.
TASK_ROWS = 4_000_000
#: Rows that are summed at once; 2^18 times a target of 2^35 units is still exact in a double.
BLOCK, UNIT_BITS = 1 << 17, 35
ROW = "_row"


def numbered(df: DataFrame) -> DataFrame:
    """A number for every row, to be stored with it: the bootstrap follows it, whatever task reads the row."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def cut_points(rows: DataFrame, factors: list[str], target: str, bins: int = BINS) -> tuple[list[list[float]], int, int]:
    """Lower ends of each factor's bins but the first, by all rows; the units of a target as a power of two; the rows.

    A factor of few values has a bin for each; others are cut at their quantiles. The maximum is a
    cut as well, so that a rare value at the upper end is not lost among the others.
    """
    shares = [k / bins for k in range(1, bins)]
    figures = [F.struct(F.approx_count_distinct(f), F.min(f), F.max(f), F.percentile_approx(f, shares, 10_000)).alias(f"f{i}") for i, f in enumerate(factors)]
    unknown = F.count(F.when(F.col(target).isNull() | F.isnan(target), 1))
    found = rows.agg(F.count("*").alias("n"), unknown.alias("unknown"), F.max(F.abs(target)).alias("top"), *figures).first()
    if found["unknown"]:
        raise ValueError(f"{found['unknown']} rows without {target}")
    cuts = []
    for i, f in enumerate(factors):
        distinct, low, high, inner = found[f"f{i}"]
        values = {*(inner or []), high} - {None}
        if distinct <= 2 * bins and len(few := rows.select(f).distinct().limit(bins + 1).collect()) <= bins:
            values = {r[0] for r in few}
        cuts.append(sorted(values - {low}) or [low or 0.0])
    # Sums of whole units do not depend on the order of rows. A unit is 2^-35 of the largest target, or 2^-33 for 2^28 rows.
    bits = min(UNIT_BITS, 61 - found["n"].bit_length()) - math.frexp(found["top"] or 1.0)[1]
    return cuts, bits, found["n"]


def poisson(key: np.ndarray, pair: int, mean: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """How often two trees draw each row: Poisson numbers from the halves of one hash of row and trees."""
    z = key + np.uint64((pair + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    below, term, steps = 0.0, math.exp(-mean), []
    for k in range(64):
        below += term
        term *= mean / (k + 1)
        if below * 2**32 >= 2**32 - 0.5:
            break
        steps.append(np.uint32(below * 2**32))
    both = []
    for u in (z.astype(np.uint32), (z >> np.uint64(32)).astype(np.uint32)):
        drawn = np.zeros(len(u), dtype=np.uint8)
        for s in steps:
            drawn += u >= s
        both.append(drawn.astype(np.float64))
    return both[0], both[1]


def bootstrap(cells: DataFrame, n_cells: int, trees: int, seed: int) -> DataFrame:
    """(tree, cell, weight, total) of a Poisson bootstrap of the rows (``ROW``, cell, units) for each tree."""

    def sums(batches):
        weight, total = np.zeros((trees, n_cells), dtype=np.int64), np.zeros((trees, n_cells), dtype=np.int64)
        waiting, held = [], 0

        def add():
            block = pd.concat(waiting)
            cell, units = block["cell"].to_numpy(), block["units"].to_numpy().astype(np.float64)
            key = block["key"].to_numpy().astype(np.uint64)
            for at in range(0, len(block), BLOCK):
                part = slice(at, at + BLOCK)
                for first in range(0, trees, 2):
                    for tree, drawn in zip(range(first, min(first + 2, trees)), poisson(key[part], first // 2)):
                        weight[tree] += np.bincount(cell[part], drawn, n_cells).astype(np.int64)
                        total[tree] += np.bincount(cell[part], drawn * units[part], n_cells).astype(np.int64)

        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held >= BLOCK:
                add()
                waiting, held = [], 0
        if held:
            add()
        for tree in range(trees):
            kept = np.flatnonzero(weight[tree])
            yield pd.DataFrame({"tree": np.int32(tree), "cell": kept.astype(np.int32), "weight": weight[tree][kept], "total": total[tree][kept]})

    keyed = cells.select(F.xxhash64(F.lit(seed), ROW).alias("key"), "cell", "units")
    parts = keyed.mapInPandas(sums, "tree int, cell int, weight long, total long")
    return parts.groupBy("tree", "cell").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def strides(sizes: list[int]) -> list[int]:
    return [math.prod(sizes[i + 1 :]) for i in range(len(sizes))]


def cell_of(names: list[str], sizes: list[int]) -> Column:
    """The number of a row's cell, from the columns of its bins."""
    return sum((F.col(n).cast("int") * s for n, s in zip(names, strides(sizes))), F.lit(0))


def bins_of(names: list[str], sizes: list[int]) -> list[Column]:
    """The bins behind the column ``cell``."""
    return [(F.expr(f"cell div {s}") % n).cast("double").alias(name) for s, n, name in zip(strides(sizes), sizes, names)]


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the model's prediction.

    Trees on cells say the same for all rows of a cell. Each possible cell is predicted once, and
    its rows look it up, instead of every row going down every tree.
    """
    bucketizer, *rest = model.stages
    if not isinstance(bucketizer, Bucketizer) or len(rest) != 2 or rest[0].getInputCols() != bucketizer.getOutputCols():
        return model.transform(rows)
    names, sizes = bucketizer.getOutputCols(), [len(s) - 1 for s in bucketizer.getSplitsArray()]
    every = rows.sparkSession.range(math.prod(sizes)).select(F.col("id").cast("int").alias("cell"))
    found = PipelineModel(rest).transform(every.select("cell", *bins_of(names, sizes)))
    found = stored(found.select(F.col("cell").alias("_cell"), "prediction"), "predictions")  # at most CELLS rows
    binned = bucketizer.transform(rows).withColumn("_cell", cell_of(names, sizes)).drop(*names)
    return binned.join(F.broadcast(found), "_cell").drop("_cell")


def fitted_trees(rows: DataFrame, factors: list[str], target: str, estimator) -> PipelineModel | None:
    """The estimator's model on all rows; nothing if the factors have more than ``CELLS`` cells."""
    spark = rows.sparkSession
    rows = rows if ROW in rows.columns else numbered(rows)
    cuts, bits, n = cut_points(rows, factors, target)
    sizes = [len(c) + 1 for c in cuts]
    if (n_cells := math.prod(sizes)) > CELLS:
        return None
    names = [f"_bin_{f}" for f in factors]
    bucketizer = Bucketizer(inputCols=factors, outputCols=names, splitsArray=[[-math.inf, *c, math.inf] for c in cuts])
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    units = F.round(F.col(target) * F.lit(2.0**bits)).cast("long")
    cells = bucketizer.transform(rows).select(ROW, cell_of(names, sizes).alias("cell"), units.alias("units"))

    def table(sums: DataFrame) -> DataFrame:
        """A row per cell: its bins, its weight and its mean target."""
        bins = bins_of(names, sizes)
        mean = F.col("total") / F.col("weight") * F.lit(2.0**-bits)
        rest = [c for c in sums.columns if c not in ("cell", "weight", "total")]
        return assembler.transform(sums.select(*bins, F.col("weight").cast("double").alias("weight"), mean.alias(target), *rest)).drop(*names)

    def every() -> DataFrame:
        return stored(table(cells.groupBy("cell").agg(F.count("*").alias("weight"), F.sum("units").alias("total"))).coalesce(1), "cells")

    # All bins are seen: the estimators look at the square of maxBins rows to find them.
    estimator = estimator.copy({estimator.maxBins: max(256, max(sizes)), estimator.weightCol: "weight"})
    if not estimator.hasParam("numTrees"):
        return PipelineModel([bucketizer, assembler, estimator.fit(every())])

    trees, seed, strategy = estimator.getNumTrees(), estimator.getSeed(), estimator.getFeatureSubsetStrategy()
    if strategy == "auto":  # as the estimator takes it for a forest, and not for each tree alone
        strategy = "onethird" if trees > 1 else "all"
    tasks = max(spark.sparkContext.defaultParallelism, n // TASK_ROWS)
    path = scratch_path(spark, "bootstrap")
    sums = table(bootstrap(cells.coalesce(tasks), n_cells, trees, seed))
    sums.repartition("tree").write.partitionBy("tree").parquet(path)
    drawn = {r[0] for r in spark.read.schema(sums.schema).parquet(path).select("tree").distinct().collect()}
    schema, rest = sums.drop("tree").schema, every() if len(drawn) < trees else None
    seeds = [int(s) for s in np.random.default_rng(seed).integers(2**31, size=trees)]
    single = estimator.copy({estimator.numTrees: 1, estimator.bootstrap: False, estimator.featureSubsetStrategy: strategy})

    @inheritable_thread_target(spark)
    def grow(tree: int):
        # A tree that drew none of a few rows takes all of them.
        own = spark.read.schema(schema).parquet(f"{path}/tree={tree}").coalesce(1) if tree in drawn else rest
        return single.copy({single.seed: seeds[tree]}).fit(own).trees[0]

    with ThreadPoolExecutor(8) as pool:
        grown = list(pool.map(grow, range(trees)))
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    array = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, trees)
    for k, tree in enumerate(grown):
        array[k] = tree._java_obj
    forest = RandomForestRegressionModel(jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(estimator.uid, array, len(factors)))
    return PipelineModel([bucketizer, assembler, estimator._copyValues(forest)])
