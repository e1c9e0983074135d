"""Category funnel counts, top categories and their top sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _listed(actions: DataFrame, column: str, count: str) -> DataFrame:
    ids = actions.select(F.explode(column).alias("category_id"))
    return (
        ids.where(F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias(count))
    )


def category_click_counts(actions: DataFrame) -> DataFrame:
    clicks = actions.where(F.col("click_category_id").isNotNull())
    return clicks.groupBy(F.col("click_category_id").alias("category_id")).agg(
        F.count(F.lit(1)).alias("click_count")
    )


def category_order_counts(actions: DataFrame) -> DataFrame:
    return _listed(actions, "order_category_ids", "order_count")


def category_pay_counts(actions: DataFrame) -> DataFrame:
    return _listed(actions, "pay_category_ids", "pay_count")


def _category_uses(actions: DataFrame) -> DataFrame:
    """(kind, category_id) for every click, order and payment, in one scan."""
    ids = F.array(
        F.array("click_category_id"), F.col("order_category_ids"), F.col("pay_category_ids")
    )
    active = actions.where(
        F.col("click_category_id").isNotNull()
        | F.col("order_category_ids").isNotNull()
        | F.col("pay_category_ids").isNotNull()
    )
    kinds = active.select(F.posexplode(ids).alias("kind", "ids"))
    return kinds.select("kind", F.explode("ids").alias("category_id")).where(
        F.col("category_id").isNotNull()
    )


def category_universe(actions: DataFrame) -> DataFrame:
    """Every category clicked, ordered or paid for."""
    return _category_uses(actions).select("category_id").distinct()


def category_funnel(actions: DataFrame) -> DataFrame:
    """Clicks, orders and payments per category, missing ones 0.

    One aggregation over all three kinds in place of three left joins.
    """
    return (
        _category_uses(actions)
        .groupBy("category_id")
        .agg(
            F.count_if(F.col("kind") == 0).alias("click_count"),
            F.count_if(F.col("kind") == 1).alias("order_count"),
            F.count_if(F.col("kind") == 2).alias("pay_count"),
        )
    )


def top_categories(funnel: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best categories by clicks, then orders, then payments."""
    return funnel.orderBy(
        F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id"
    ).limit(k)


def category_session_counts(actions: DataFrame) -> DataFrame:
    """Clicks per category and session."""
    clicks = actions.where(F.col("click_category_id").isNotNull())
    return clicks.groupBy(F.col("click_category_id").alias("category_id"), "session_id").agg(
        F.count(F.lit(1)).alias("click_count")
    )


def top_sessions(actions: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` sessions with most clicks in each of the given categories.

    The categories filter the clicks before they are counted; Spark broadcasts them if
    they measure small. ``rank <= k`` lets Spark cut each category down before
    the shuffle, so a category with a large share of clicks is no hot spot.
    """
    wanted = categories.select(F.col("category_id").alias("click_category_id"))
    clicks = actions.select("session_id", "click_category_id").join(
        wanted, "click_category_id", "left_semi"
    )
    best = W.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    return (
        category_session_counts(clicks)
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
        .select("category_id", "session_id", "click_count")
    )
