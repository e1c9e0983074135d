"""Visit-length and step-length buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names with first and last whole number (None = open).
VISIT_LENGTH_BUCKETS = (
    ("1s_3s", 1, 3),
    ("4s_6s", 4, 6),
    ("7s_9s", 7, 9),
    ("10s_30s", 10, 30),
    ("30s_60s", 31, 60),
    ("1m_3m", 61, 180),
    ("3m_10m", 181, 600),
    ("10m_30m", 601, 1800),
    ("30m", 1801, None),
)
STEP_LENGTH_BUCKETS = (
    ("1_3", 1, 3),
    ("4_6", 4, 6),
    ("7_9", 7, 9),
    ("10_30", 10, 30),
    ("30_60", 31, 60),
    ("60", 61, None),
)


def _inside(c: Column, low: int, high: int | None) -> Column:
    return c >= low if high is None else c.between(low, high)


def _bucket(c: Column, buckets) -> Column:
    """Bucket name of a whole number; NULL below the first bucket."""
    name, low, high = buckets[0]
    first = F.when(_inside(c, low, high), name)
    return reduce(lambda chain, b: chain.when(_inside(c, b[1], b[2]), b[0]), buckets[1:], first)


def visit_length_bucket(seconds: Column) -> Column:
    return _bucket(seconds, VISIT_LENGTH_BUCKETS)


def step_length_bucket(steps: Column) -> Column:
    return _bucket(steps, STEP_LENGTH_BUCKETS)


def bucket_count(c: Column, low: int, high: int | None) -> Column:
    """Aggregate: how many values fall inside one bucket."""
    return F.count_if(_inside(c, low, high))
