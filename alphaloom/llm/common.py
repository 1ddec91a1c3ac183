"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import scratch_path

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and go on from its files.

    This cuts the lineage: what several later steps read is made once, and the loss of an
    executor costs no more than a read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learned from: a fifth, by checksum of the id (null: not held out)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_key(id_column: str, text_column: str) -> Column:
    """Equal for repeated rows only: id and text, each with a mark for null."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part(id_column), F.lit("\n"), part(text_column)).cast("binary"))


def pieces(rows: DataFrame, place: list[str], carried: list[str], block: int) -> DataFrame:
    """(work, side, carried): rows that share a place, dealt to pieces of work of at most two blocks, so that all pairs that need to meet do.

    ``rows`` has the columns of ``place``, ``node``, which tells rows of a place apart, and ``ball``:
    rows of one ball, numbered from 0 on, need not meet; -1 is none. A place of up to ``block`` rows
    is one piece of side 0. A larger one is cut into blocks of one ball each, and each pair of
    blocks is a piece with sides 0 and 1; blocks of one ball don't meet. Rows of a place where all
    are of one ball, and those that are alone, are left out.
    """
    sizes = rows.groupBy(*place, "ball").agg(F.count("*").alias("n"))
    whole = sizes.groupBy(*place).agg(F.sum("n").alias("crowd"), F.max("ball").alias("top"), F.min("ball").alias("low"))
    whole = stored(whole.where("crowd > 1 AND (top = -1 OR top > low)").select(*place, "crowd"), "pieces-crowds")
    sized = rows.join(whole, place)
    small = sized.where(F.col("crowd") <= block).select(F.xxhash64(*place).alias("work"), F.lit(0).alias("side"), *carried)
    blocks = stored(sizes.join(whole.where(F.col("crowd") > block), place).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "pieces-blocks")
    if blocks.isEmpty():
        return small
    every = blocks.select(*place, "ball", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = every.select(*place, F.col("ball").alias("ball2"), F.col("block").alias("block2"))
    ordered = (F.col("ball") < F.col("ball2")) | ((F.col("ball") == -1) & (F.col("ball2") == -1) & (F.col("block") <= F.col("block2")))
    met = every.join(other, place).where(ordered).withColumn("work", F.xxhash64(*place, "ball", "block", "ball2", "block2"))
    own = F.struct("ball", "block", F.lit(0).alias("side"))
    opposite = F.struct(F.col("ball2").alias("ball"), F.col("block2").alias("block"), F.lit(1).alias("side"))
    alone = (F.col("ball") == F.col("ball2")) & (F.col("block") == F.col("block2"))
    ends = met.select(*place, "work", F.explode(F.when(alone, F.array(own)).otherwise(F.array(own, opposite))).alias("e")).select(*place, "work", "e.*")
    cut = sized.where(F.col("crowd") > block).join(blocks.select(*place, "ball", "blocks"), [*place, "ball"])
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    return small.unionByName(cut.join(ends, [*place, "ball", "block"]).select("work", "side", *carried))


def in_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches with the (start, length) of each run of equal keys in them, of rows that come sorted by a long key.

    No run is split: the last of a batch goes on in the next.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        keys = rows[key].to_numpy()
        bounds = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
        yield rows, [(int(a), int(b - a)) for a, b in zip(bounds, bounds[1:])]
        held = rows.slice(bounds[-1])
    if held is not None:
        yield held, [(0, held.num_rows)]
