"""Earlier rows and running sums in groups too large for one task.

Rows are range-partitioned by group and order, so a large group spans many partitions: its
pieces. Within a piece a window does the work; between pieces only one value a piece is
carried on. No window ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.runtime import checkpointed

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33
PLACE, PIECE = "_place", "_piece"


def laid_out(
    df: DataFrame, group: list[str], order: list[Column], partitions: int | None = None
) -> DataFrame:
    """``df`` sorted by group and order over range partitions, with its place and piece.

    ``group`` columns must not be null. The rows are checkpointed, because their places
    are read more than once; that job runs when this function is called.
    """
    keys = [F.col(g) for g in group] + order
    ranged = (
        df.repartitionByRange(*keys)
        if partitions is None
        else df.repartitionByRange(partitions, *keys)
    )
    return checkpointed(
        ranged.sortWithinPartitions(*keys)
        .withColumn(PLACE, F.monotonically_increasing_id())
        .withColumn(PIECE, F.shiftright(PLACE, _PARTITION_SHIFT))
    )


def _within(group: list[str]):
    return W.partitionBy(*group, PIECE).orderBy(PLACE)


def last_before(rows: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` of ``laid_out`` with the last value, not null, in earlier rows of the group.

    ``values`` names each new column and what it takes from the earlier row; a struct brings
    several columns of one row.
    """
    ids = {n: f"_value_{i}" for i, n in enumerate(values)}
    valued = rows.withColumns({ids[n]: c for n, c in values.items()})
    ends = valued.groupBy(*group, PIECE).agg(
        *[F.max_by(i, F.when(F.col(i).isNotNull(), F.col(PLACE))).alias(i) for i in ids.values()]
    )
    earlier = W.partitionBy(*group).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *group,
        PIECE,
        *[F.last(i, ignorenulls=True).over(earlier).alias(f"{i}_carried") for i in ids.values()],
    )
    above = _within(group).rowsBetween(W.unboundedPreceding, -1)
    found = {
        n: F.coalesce(F.last(i, ignorenulls=True).over(above), F.col(f"{i}_carried"))
        for n, i in ids.items()
    }
    joined = valued.join(carried, [*group, PIECE])
    return joined.select(*rows.columns, *[c.alias(n) for n, c in found.items()])


def running_sum(rows: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` of ``laid_out`` with the sum of ``value`` up to and with each row."""
    valued = rows.withColumn("_value", value)
    sums = valued.groupBy(*group, PIECE).agg(F.sum("_value").alias("_sum"))
    earlier = W.partitionBy(*group).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        *group, PIECE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried")
    )
    upto = _within(group).rowsBetween(W.unboundedPreceding, 0)
    total = F.coalesce(F.sum("_value").over(upto), F.lit(0)) + F.col("_carried")
    joined = valued.join(carried, [*group, PIECE])
    return joined.select(*rows.columns, total.alias(name))
