"""Optional conditions on sessions.

The scalar ones are bare comparisons, so they reach the parquet scan of the users.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokens(value: str | Sequence | None) -> tuple[str, ...]:
    """A comma list or a sequence as tokens; empty ones are dropped."""
    if value is None:
        return ()
    parts = value.split(",") if isinstance(value, str) else [str(v) for v in value]
    return tuple(p for p in parts if p != "")


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def in_range(c: Column, low: int | None, high: int | None) -> Column | None:
    """Both bounds included; no condition unless both are given."""
    if low is None or high is None:
        return None
    return c.between(low, high)


def equals(c: Column, value: str | None) -> Column | None:
    if value is None or value == "":
        return None
    return c == value


def any_match(c: Column, values: str | Sequence | None) -> Column | None:
    """Scalar equal to any listed value; NULL and "-1" never match."""
    wanted = _tokens(values)
    if not wanted:
        return None
    usable = [v for v in wanted if v != "-1"]
    return c.isin(*usable) if usable else F.lit(False)


def any_overlap(c: Column, values: str | Sequence | None, element: str) -> Column | None:
    """Array sharing at least one element with the listed values."""
    wanted = _tokens(values)
    if not wanted:
        return None
    listed = F.array(*[F.lit(v).try_cast(element) for v in wanted])
    return F.coalesce(F.arrays_overlap(c, listed), F.lit(False))


@dataclass(frozen=True)
class SessionCriteria:
    """Conditions on a session, joined by AND; an absent or empty one is no condition.

    Lists are comma text or sequences.
    """

    start_age: int | None = None
    end_age: int | None = None
    professionals: str | Sequence | None = None
    cities: str | Sequence | None = None
    sex: str | None = None
    keywords: str | Sequence | None = None
    category_ids: str | Sequence | None = None

    def user_condition(self) -> Column:
        """The part that looks at user columns only."""
        parts = [
            in_range(F.col("age"), self.start_age, self.end_age),
            any_match(F.col("professional"), self.professionals),
            any_match(F.col("city"), self.cities),
            equals(F.col("sex"), self.sex),
        ]
        return _all([p for p in parts if p is not None])

    def list_condition(self) -> Column:
        """The part that looks at the session's lists."""
        parts = [
            any_overlap(F.col("search_keywords"), self.keywords, "string"),
            any_overlap(F.col("click_category_ids"), self.category_ids, "bigint"),
        ]
        return _all([p for p in parts if p is not None])

    def action_flags(self) -> dict[str, Column]:
        """The list part per action; a session matches if any action does."""
        flags = {}
        if keywords := _tokens(self.keywords):
            found = F.col("search_keyword").isin(*keywords)
            flags["keyword_hit"] = F.coalesce(found, F.lit(False))
        if categories := _tokens(self.category_ids):
            listed = [F.lit(v).try_cast("bigint") for v in categories]
            found = F.col("click_category_id").isin(*listed)
            flags["category_hit"] = F.coalesce(found, F.lit(False))
        return flags


def session_filter(sessions: DataFrame, criteria: SessionCriteria) -> DataFrame:
    """Joined sessions, lists included, that meet every condition."""
    return sessions.where(criteria.user_condition() & criteria.list_condition())
