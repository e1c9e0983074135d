"""Input schemas and the projections that normalise them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import text

NO_ID = -1  # stored value for "no click"

_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "bigints": T.ArrayType(T.LongType()),
}


def _schema(columns: str) -> T.StructType:
    pairs = (column.split(":") for column in columns.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# As stored: times and id lists are text, -1 means no click.
RAW_ACTION = _schema(
    "date:string user_id:bigint session_id:string page_id:bigint action_time:string"
    " search_keyword:string click_category_id:bigint click_product_id:bigint"
    " order_category_ids:string order_product_ids:string pay_category_ids:string"
    " pay_product_ids:string city_id:bigint"
)
ACTION = _schema(
    "date:date user_id:bigint session_id:string page_id:bigint action_time:timestamp"
    " search_keyword:string click_category_id:bigint click_product_id:bigint"
    " order_category_ids:bigints order_product_ids:bigints pay_category_ids:bigints"
    " pay_product_ids:bigints city_id:bigint"
)
USER = _schema(
    "user_id:bigint username:string name:string age:int professional:string city:string sex:string"
)
PRODUCT = _schema("product_id:bigint product_name:string extend_info:string")
CITY = _schema("city_id:bigint city_name:string area:string")

ID_LISTS = ("order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids")
CLICK_IDS = ("click_category_id", "click_product_id")


def normalise_actions(raw: DataFrame) -> DataFrame:
    """Stored actions to typed ones: real dates and times, -1 to NULL, id arrays.

    Every output is a plain column expression, so unused ones cost nothing
    and a filter on ``date`` still reaches the scan when it is stored as a date.
    """

    def typed(field: T.StructField):
        name, stored = field.name, raw.schema[field.name].dataType
        c = F.col(name)
        if name in CLICK_IDS:
            return F.nullif(c, F.lit(NO_ID).cast("bigint")).alias(name)
        if name in ID_LISTS and stored == T.StringType():
            return text.id_list(c).alias(name)
        return c if stored == field.dataType else c.cast(field.dataType).alias(name)

    return raw.select(*[typed(f) for f in ACTION.fields])
