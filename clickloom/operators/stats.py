"""Visit-length and step-length statistics over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import buckets
from clickloom.functions.numbers import ratio_round


def _counts():
    """(output name, count aggregate) for all fifteen buckets."""
    for name, low, high in buckets.VISIT_LENGTH_BUCKETS:
        yield f"visit_length_{name}", buckets.bucket_count(F.col("visit_length"), low, high)
    for name, low, high in buckets.STEP_LENGTH_BUCKETS:
        yield f"step_length_{name}", buckets.bucket_count(F.col("step_length"), low, high)


def visit_length_buckets(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn(
        "visit_bucket", buckets.visit_length_bucket(F.col("visit_length"))
    )


def step_length_buckets(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("step_bucket", buckets.step_length_bucket(F.col("step_length")))


def session_ratio_stats(sessions: DataFrame) -> DataFrame:
    """One row: session count and the share of each bucket, to two places."""
    counts = list(_counts())
    totals = sessions.agg(
        F.count(F.lit(1)).alias("session_count"), *[c.alias(n) for n, c in counts]
    )
    ratios = [
        ratio_round(F.col(n), F.col("session_count")).alias(f"{n}_ratio") for n, _ in counts
    ]
    return totals.select("session_count", *ratios)


def bucket_counts(sessions: DataFrame) -> DataFrame:
    """(name, count) rows: all sessions and each bucket, zero counts included."""
    counts = [("session_count", F.count(F.lit(1))), *_counts()]
    totals = sessions.agg(*[c.alias(n) for n, c in counts])
    return totals.unpivot([], [n for n, _ in counts], "name", "count")
