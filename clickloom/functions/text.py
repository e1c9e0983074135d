"""Text column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(c: Column) -> Column:
    """True for NULL and for the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def non_empty(c: Column) -> Column:
    """The text, with the empty string as NULL."""
    return F.nullif(c, F.lit(""))


def trim_comma(c: Column) -> Column:
    """Drop one leading and one trailing comma."""
    return F.regexp_replace(c, "^,|,$", "")


def pad_two(c: Column) -> Column:
    """Left-pad with zeros to two characters; longer text is kept."""
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def id_list(c: Column) -> Column:
    """Comma list of ids as ``array<bigint>``.

    Blank text gives NULL. Tokens that are not whole numbers become NULL
    elements, which every consumer drops; this keeps the parse a plain cast.
    """
    filled = F.when(F.length(F.trim(c)) > 0, c)
    return F.split(filled, ",").try_cast("array<bigint>")


def list_text(c: Column) -> Column:
    """Array as comma text, NULL elements left out, NULL array kept."""
    return F.array_join(c.cast("array<string>"), ",")


def sorted_set_text(c: Column) -> Column:
    """Aggregate: distinct values in order, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def _one_char(delimiter: str) -> str:
    if len(delimiter) != 1:
        raise ValueError("the delimiter must be one character")
    return re.escape(delimiter)


def kv_get(c: Column, field: str, delimiter: str = "|") -> Column:
    """Value of the first ``field=value`` pair, NULL if absent or empty."""
    d = _one_char(delimiter)
    pattern = f"(?:^|{d}){re.escape(field)}=([^={d}]+)=*(?={d}|$)"
    return non_empty(F.regexp_extract(c, pattern, 1))


def kv_set(c: Column, field: str, value: str, delimiter: str = "|") -> Column:
    """Replace the value of ``field`` where present; other pairs are kept."""
    d = _one_char(delimiter)
    pattern = f"(^|{d}){re.escape(field)}(?:=[^{d}]*)?(?={d}|$)"
    literal = f"{field}={value}".replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, pattern, "$1" + literal)
