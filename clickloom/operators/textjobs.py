"""Jobs over text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import text


def kv_field_extract(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """One column per field of a ``k=v|k=v`` text column."""
    return df.withColumns({f: text.kv_get(F.col(column), f) for f in fields})


def kv_field_rewrite(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """New values for fields of a ``k=v|k=v`` text column."""
    c = F.col(column)
    for field, value in values.items():
        c = text.kv_set(c, field, value)
    return df.withColumn(column, c)


def text_normalise(df: DataFrame, column: str) -> DataFrame:
    """Emptiness flag, comma-trimmed and two-character padded forms of a column."""
    c = F.col(column)
    return df.withColumns(
        {
            "is_empty": text.is_empty(c),
            "comma_trimmed": text.trim_comma(c),
            "padded": text.pad_two(c),
        }
    )
