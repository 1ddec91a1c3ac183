"""Pages of a sorted table by an offset index, so that a late page costs no more than an early one.

The table is written once in its order, cut into parts of about ``part_rows`` rows by range. The
index holds the rows of each part and of all parts before it, one row a part. A page opens only the
one or two parts that its rows lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from alphaloom.session import scratch_path

PART_ROWS = 500_000


class Pages:
    """A table sorted by ``order``; columns that the order leaves equal may come in any order."""

    def __init__(self, df: DataFrame, order: list[Column], path: str | None = None, part_rows: int = PART_ROWS):
        self.spark: SparkSession = df.sparkSession
        self.order, self.schema = order, df.schema
        self.path = path or scratch_path(self.spark, "pages")
        parts = max(1, -(-df.count() // part_rows))
        ranged = df.repartitionByRange(parts, *order) if parts > 1 else df.repartition(1)
        ranged.withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(self.path)
        counts = self._read().groupBy("_part").agg(F.count("*").alias("rows"))
        before, self.index = 0, []
        # One row a part: a few bytes for each ``part_rows`` rows of the table.
        for part, rows in sorted(map(tuple, counts.collect())):
            self.index.append((part, before, rows))
            before += rows
        self.total = before

    def _read(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_part", IntegerType())])).parquet(self.path)

    def parts_of(self, number: int, size: int) -> list[tuple[int, int, int]]:
        """(part, rows before it, its rows) of the parts that a page lies in."""
        begin, end = (number - 1) * size, number * size
        return [p for p in self.index if p[1] < end and p[1] + p[2] > begin]

    def page(self, number: int, size: int) -> DataFrame:
        """One page, from 1 on, with row numbers and totals; a page beyond the end is empty."""
        if number < 1 or size < 1:
            raise ValueError("pages and their sizes start at 1")
        begin, end = (number - 1) * size, number * size
        own = self.parts_of(number, size)
        rows = self._read().where(F.col("_part").isin([p for p, _, _ in own]))
        before = F.create_map(*(F.lit(x) for p, b, _ in own for x in (p, b))) if own else None
        # A part is bounded, so numbering it is one small sort; only rows of the page go on.
        place = F.row_number().over(Window.partitionBy("_part").orderBy(*self.order))
        numbered = rows.withColumn("row_number", place + (before[F.col("_part")] if own else F.lit(0))).drop("_part")
        pages = -(-self.total // size)
        return numbered.where(F.col("row_number").between(begin + 1, end)).withColumns(
            {
                "total": F.lit(self.total).cast("long"),
                "page": F.lit(number),
                "pages": F.lit(pages).cast("long"),
                "has_next": F.lit(number < pages),
                "has_prev": F.lit(number > 1),
            }
        )
