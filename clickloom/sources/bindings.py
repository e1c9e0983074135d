"""The driver's tables seen as the logical input tables.

A user and a day make a session. ``k`` is the number in ``props``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources import model

CITIES = 25  # rows of nation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.expr("CAST(substr(props, 7, length(props) - 7) AS INT)"))


def _on_type(name: str, value):
    return F.when(F.col("event_type") == name, value)


def raw_actions(events: DataFrame, compressed_clock: bool = False) -> DataFrame:
    """Events as stored actions: text id lists, -1 for no click.

    The compressed clock plays a minute of the day in one second.
    """
    day = F.col("ts").cast("date")
    k, product = F.col("k"), F.col("event_id") % 100
    time = F.col("ts").cast("timestamp")
    if compressed_clock:
        seconds = (F.hour("ts") * 60 + F.minute("ts")).cast("bigint")
        time = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)
    none = F.lit(model.NO_ID).cast("bigint")
    order = F.concat_ws(",", k.cast("string"), ((k * 3 + 1) % 100).cast("string"))
    return with_k(events).select(
        day.alias("date"),
        "user_id",
        F.concat_ws("_", F.col("user_id").cast("string"), day.cast("string")).alias("session_id"),
        (k % 10).cast("bigint").alias("page_id"),
        time.alias("action_time"),
        _on_type("view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"),
        F.coalesce(_on_type("click", k.cast("bigint")), none).alias("click_category_id"),
        F.coalesce(_on_type("click", product), none).alias("click_product_id"),
        _on_type("purchase", order).alias("order_category_ids"),
        _on_type("purchase", product.cast("string")).alias("order_product_ids"),
        _on_type("signup", k.cast("string")).alias("pay_category_ids"),
        _on_type("signup", product.cast("string")).alias("pay_product_ids"),
        (F.col("user_id") % CITIES).alias("city_id"),
    )


def actions(spark: SparkSession, sf_dir: str, compressed_clock: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return model.normalise_actions(raw_actions(events, compressed_clock))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("user_id"),
            F.col("c_name").alias("username"),
            F.col("c_name").alias("name"),
            (key % 60).cast("int").alias("age"),
            F.col("c_mktsegment").alias("professional"),
            F.col("n_name").alias("city"),
            (key % 2).cast("string").alias("sex"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.col("p_size") % 2).cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat(F.lit('{"product_status": '), status, F.lit("}")).alias("extend_info"),
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").cast("bigint").alias("city_id"),
            F.col("n_name").alias("city_name"),
            F.col("r_name").alias("area"),
        )
    )


def _located(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    located = with_k(events).withColumn("city_id", F.col("user_id") % CITIES)
    return located.join(cities(spark, sf_dir), "city_id")


def ad_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as typed ad clicks."""
    return clicks_of(spark, sf_dir, table(spark, sf_dir, "events"))


def clicks_of(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    return _located(spark, sf_dir, events).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("date"),
        F.col("area").alias("province"),
        F.col("city_name").alias("city"),
        F.col("user_id").alias("userid"),
        (F.col("k") % 20).cast("bigint").alias("adid"),
    )


def ad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ad-click log lines; error events leave out the ad, so they are malformed."""
    return lines_of(spark, sf_dir, table(spark, sf_dir, "events"))


def ad_line_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The same lines in the order they arrive in: four parts by the hour of day, all days in each.

    Events without a time come with the first part; their lines are malformed.
    """
    events = table(spark, sf_dir, "events")
    quarter = F.coalesce(F.floor(F.hour("ts") / 6), F.lit(0))
    return [lines_of(spark, sf_dir, events.where(quarter == n)) for n in range(4)]


def ad_line_weeks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The same lines in the order of their days: four parts of eight days of a month."""
    events = table(spark, sf_dir, "events")
    week = F.coalesce(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(0))
    return [lines_of(spark, sf_dir, events.where(week == n)) for n in range(4)]


def lines_of(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    ad = F.when(F.col("event_type") != "error", (F.col("k") % 20).cast("string"))
    return _located(spark, sf_dir, events).select(
        F.concat_ws(
            " ",
            millis,
            F.translate("area", " ", "_"),
            F.translate("city_name", " ", "_"),
            F.col("user_id").cast("string"),
            ad,
        ).alias("value")
    )
