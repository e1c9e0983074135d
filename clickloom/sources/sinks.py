"""Writers for results and saved tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import text


def run_stamp(now: datetime | None = None) -> str:
    """Task id of a run: its start as ``yyyyMMddHHmmss``."""
    return (now or datetime.now()).strftime("%Y%m%d%H%M%S")


def stamped(df: DataFrame, task_id: str) -> DataFrame:
    """The rows with the run's task id as first column."""
    return df.select(F.lit(task_id).alias("task_id"), "*")


def append_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    partitions: int | None = None,
    batch_size: int = 10_000,
    **options: str,
) -> None:
    """Append rows to a database table.

    Each partition holds one connection, so ``partitions`` bounds how many
    the database sees; it only ever merges partitions.
    """
    out = list_columns_as_text(df)
    if partitions is not None:
        out = out.coalesce(partitions)
    writer = (
        out.write.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", batch_size)
        .options(**options)
    )
    if user is not None:
        writer = writer.option("user", user)
    if password is not None:
        writer = writer.option("password", password)
    writer.mode("append").save()


def list_columns_as_text(df: DataFrame) -> DataFrame:
    """Array columns as comma text, for sinks without arrays."""
    return df.select(
        *[
            text.list_text(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def save_table(
    df: DataFrame,
    table: str,
    partition_by: tuple[str, ...] = (),
    bucket_by: tuple[int, str] | None = None,
    path: str | None = None,
) -> None:
    """Overwrite a saved table.

    Partition actions by ``date`` so that date ranges prune whole folders;
    bucket them by ``session_id`` so that session work needs no shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        buckets, column = bucket_by
        writer = writer.bucketBy(buckets, column).sortBy(column)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
