"""Readers for stored tables and for ad-click line streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.sources import model


def read_actions(spark: SparkSession, table: str = "user_visit_action") -> DataFrame:
    """Typed actions from a saved table."""
    return model.normalise_actions(spark.table(table))


def read_users(spark: SparkSession, table: str = "user_info") -> DataFrame:
    return spark.table(table).select(*model.USER.names)


def read_products(spark: SparkSession, table: str = "product_info") -> DataFrame:
    return spark.table(table).select(*model.PRODUCT.names)


def read_cities(spark: SparkSession, table: str = "city_info") -> DataFrame:
    return spark.table(table).select(*model.CITY.names)


def kafka_lines(
    spark: SparkSession,
    servers: str,
    topics: str,
    starting: str = "latest",
    max_per_trigger: int | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of ``value`` lines from Kafka.

    Offsets live in the query's checkpoint; ``starting`` matters on the first
    run only. ``partitions`` adds a shuffle, for topics with too few of them.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", starting)
        .options(**options)
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return _lines(reader.load(), partitions)


def file_lines(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Stream of ``value`` lines from text files dropped into a folder."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _lines(reader.load(path), partitions)


def _lines(stream: DataFrame, partitions: int | None) -> DataFrame:
    lines = stream.selectExpr("CAST(value AS STRING) AS value")
    return lines if partitions is None else lines.repartition(partitions)
