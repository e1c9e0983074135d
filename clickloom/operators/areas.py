"""Product clicks per area and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.operators.ranking import full_rank


def product_click_scan(actions: DataFrame) -> DataFrame:
    """City and product of every product click."""
    return actions.select("city_id", "click_product_id").where(
        F.col("click_product_id").isNotNull()
    )


def click_city_join(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks with their city's name and area.

    No broadcast hint: Spark knows a stored table's size and broadcasts it
    below its threshold; beyond, a skewed city is split by adaptive execution.
    """
    return clicks.join(cities.select("city_id", "city_name", "area"), "city_id")


def area_product_counts(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks per area and product, with the ``id:name`` list of their cities.

    Clicks are counted per city and product before the join, so only counts
    are joined and shuffled again, and a list is made from one row per city.
    """
    per_city = clicks.groupBy("city_id", "click_product_id").agg(
        F.count(F.lit(1)).alias("click_count")
    )
    label = F.concat_ws(":", F.col("city_id").cast("string"), F.col("city_name"))
    return (
        click_city_join(per_city, cities)
        .groupBy("area", "click_product_id")
        .agg(
            F.sum("click_count").alias("click_count"),
            text.sorted_set_text(label).alias("city_info"),
        )
    )


def concat_distinct(df: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """Distinct texts of each group in order, joined by commas."""
    distinct = df.select(*group, value.alias(name)).distinct()
    return distinct.groupBy(*group).agg(text.sorted_set_text(F.col(name)).alias(name))


def product_status_label(extend_info: Column) -> Column:
    """``Self`` where the JSON's product_status is 0, else ``Third Party``."""
    status = F.get_json_object(extend_info, "$.product_status")
    return F.when(status == "0", "Self").otherwise("Third Party")


def _with_product(counts: DataFrame, products: DataFrame) -> DataFrame:
    named = products.select(
        F.col("product_id").alias("click_product_id"),
        "product_name",
        product_status_label(F.col("extend_info")).alias("product_status"),
    )
    return counts.join(named, "click_product_id")


def area_product_rank(counts: DataFrame, products: DataFrame) -> DataFrame:
    """Every known product's rank within its area, most clicks first.

    Runs a job when called: see ``full_rank``.
    """
    order = [F.desc("click_count"), F.asc("click_product_id")]
    return full_rank(_with_product(counts, products), ["area"], order, "rank")


def area_top_products(counts: DataFrame, products: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best known products of each area."""
    best = W.partitionBy("area").orderBy(F.desc("click_count"), "click_product_id")
    return (
        _with_product(counts, products)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )
