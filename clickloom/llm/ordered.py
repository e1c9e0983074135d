"""Places of rows in groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.llm.common import stored

_PART_SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``idx``, a row's place in its group from 0, and ``total``, the group's size.

    Rows are range-partitioned by group and order, so a large group spans many tasks; a
    place is counted within the partition and the group's rows in earlier ones are added.
    ``group`` must not be null. Rows that ``order`` leaves equal are told apart by where
    they were read, so a run of repeated rows is spread too. The sorted rows are written
    to the shared folder, as their places are read twice.
    """
    once = stored(df).withColumn("__row", F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("__row")]
    laid = stored(
        once.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("__row")
        .withColumn("__place", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__place", _PART_SHIFT))
    )
    pieces = laid.groupBy(group, "__part").agg(
        F.min("__place").alias("first"), F.count(F.lit(1)).alias("n")
    )
    whole = W.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select(
        group,
        "__part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__shift"),
        F.sum("n").over(whole).alias("total"),
    )
    return (
        laid.join(shifts, [group, "__part"])
        .withColumn("idx", F.col("__place") + F.col("__shift"))
        .drop("__place", "__part", "__shift")
    )
