"""Distinct counts kept as mergeable sketches: one HyperLogLog sketch per column and month, refreshed by merging.

A month's sketch is a few kilobytes, whatever the rows. New rows are sketched alone and merged into
the stored ones; counts of any span of months are unions of their sketches, without the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: log2 of a sketch's registers, and the relative error that an estimate stays within (three standard errors, of 0.8326 / sqrt(registers)).
LOG_REGISTERS = 14
ERROR = 3 * 0.8326 / (1 << LOG_REGISTERS) ** 0.5


def sketched(df: DataFrame, month: Column, columns: list[str]) -> DataFrame:
    """(column_name, month, rows, sketch) of the rows; NULLs are no values, a NULL month is a month of its own."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    long = df.select(month.alias("month"), F.explode(cells).alias("x")).select("month", "x.*")
    return long.groupBy("column_name", "month").agg(F.count("v").alias("rows"), F.hll_sketch_agg("v", F.lit(LOG_REGISTERS)).alias("sketch"))


def merged(*parts: DataFrame) -> DataFrame:
    """Sketches of the same column and month joined into one."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("column_name", "month").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


class SketchStore:
    """Stored sketches: a folder of versions, the greatest of which counts. A refresh writes the next
    version from the last one and the new rows' sketches, and never changes a version in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path.rstrip("/"), 0

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v{self.version}") if self.version else None

    def refresh(self, new: DataFrame) -> "SketchStore":
        old = self.read()
        (merged(old, new) if old is not None else merged(new)).write.parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1
        return self


def estimates(sketches: DataFrame, by: list[str] = ["column_name", "month"]) -> DataFrame:
    """Estimated distinct values for each group of sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
