"""Replacing only the partitions of a saved table that new rows touch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def replace_partitions(rows: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Write ``rows`` in place of the partitions of ``path`` that they have rows of.

    Spark's dynamic overwrite: the new files are staged and moved when all tasks are done, so
    a failed or repeated write leaves the old or the new rows of a partition, never both.
    Other partitions are neither read nor written. A partition with no new row stays, so
    a group is emptied by deleting it and not by writing nothing. Rows are clustered
    by the keys first, so a partition has a file or a few, and a large one is split.
    """
    (
        rows.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; without rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
