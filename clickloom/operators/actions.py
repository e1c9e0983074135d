"""Selecting actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks that the actions of one session can spread over.
SALTS = 32


def action_scan(actions: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """Actions whose date is from ``start_date`` to ``end_date``, both included."""
    low, high = F.lit(start_date).cast("date"), F.lit(end_date).cast("date")
    return actions.where(F.col("date").between(low, high))


def filtered_actions(
    actions: DataFrame, sessions: DataFrame, salts: int = SALTS
) -> DataFrame:
    """Actions of the kept sessions.

    A session may hold a third of all actions. Actions are dealt over ``salts`` parts by a
    hash of their fields and each kept id is repeated for every part, so that the
    join splits a large session whatever shape the other side has. With one part it is a
    plain join, which needs no shuffle of a table bucketed by session.
    """
    if salts == 1:
        return actions.join(sessions.select("session_id"), "session_id", "left_semi")
    salt = F.pmod(F.xxhash64("action_time", "page_id", "user_id", "click_product_id"), F.lit(salts))
    ids = sessions.select("session_id").where("session_id is not null")
    repeated = ids.select(
        "session_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    return (
        actions.withColumn("_salt", salt.cast("int"))
        .join(repeated, ["session_id", "_salt"], "left_semi")
        .select(*actions.columns)
    )
