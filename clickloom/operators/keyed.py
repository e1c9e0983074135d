"""Merging new rows into keyed tables.

Each merge takes the stored rows and the new ones and returns the table's new
rows. The new rows hold each key once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Insert new keys; add to the value of known ones."""
    both = old.select(*keys, value).unionByName(new.select(*keys, value))
    return both.groupBy(*keys).agg(F.sum(value).alias(value))


def set_upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Insert new keys; overwrite the value of known ones.

    One aggregation over both sides: its running values have a fixed width,
    and rows combine before the shuffle.
    """
    both = (
        old.select(*keys, value, F.lit(0).alias("_age"))
        .unionByName(new.select(*keys, value, F.lit(1).alias("_age")))
    )
    return both.groupBy(*keys).agg(F.max_by(value, "_age").alias(value))


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Drop the stored rows of every group that occurs in the new rows; add those."""
    touched = new.select(*group).distinct()
    return old.join(touched, group, "left_anti").unionByName(new)


def only_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new keys not stored yet, each once."""
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")
