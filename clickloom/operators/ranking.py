"""Ranks over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.runtime import checkpointed

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33


def full_rank(
    df: DataFrame, group: list[str], order: list[Column], name: str, partitions: int | None = None
) -> DataFrame:
    """``row_number`` over ``group`` by ``order`` without one task per group.

    The rows are range-partitioned by group and order, so a large group spans
    many partitions; a row's rank is its place in its partition plus the
    group's rows in the partitions before. ``order`` must be unique within a
    group. The sorted rows are checkpointed, as their places are read twice; that
    job runs when this function is called.
    """
    keys = [F.col(g) for g in group] + order
    ranged = (
        df.repartitionByRange(*keys)
        if partitions is None
        else df.repartitionByRange(partitions, *keys)
    )
    placed = checkpointed(
        ranged.sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", _PARTITION_SHIFT))
    )
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    return (
        placed.join(offsets, [*group, "_part"])
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_place", "_part", "_shift")
    )
