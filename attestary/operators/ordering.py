"""Places in a global order, without a window over all rows: range partitions, with the counts of those ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

_PART_BITS = 33  # monotonically_increasing_id counts rows in the lower bits


def numbered(rows: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """The rows with their place in the order, from 0. Rows are written once, as the ranges' bounds come from a sample and may not
    change between two uses; only counts by partition meet in one task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged.withColumn("_part", F.shiftright("_at", _PART_BITS)), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.col("_at").bitwiseAND((1 << _PART_BITS) - 1)
    return ranged.join(ahead, "_part").withColumn(name, place).drop("_part", "_at", "_ahead")


def slice_of(rows: DataFrame, order: list[Column], first: int, size: int, near: int = 10_000) -> DataFrame:
    """Rows `first` to `first + size` of the order. Up to place `near` every task keeps that many of its rows and no more; beyond,
    the rows are laid out by ranges of the order, and only the ranges that hold the slice are read and sorted."""
    if first + size <= near:
        return rows.orderBy(*order).offset(first).limit(size)
    ranged = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges", by="_part")
    held, begin, chosen = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()), 0, []  # a row a partition
    skip = first
    for part, n in held:
        if begin < first + size and begin + n > first:
            chosen.append(part)
        elif begin + n <= first:
            skip -= n
        begin += n
    return ranged.where(F.col("_part").isin(*chosen)).drop("_part").orderBy(*order).offset(skip).limit(size)
