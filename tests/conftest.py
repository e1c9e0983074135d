import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from clickloom.runtime import configure

    base = tmp_path_factory.mktemp("spark")
    session = (
        configure(SparkSession.builder)
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Values of column expressions over a one-row table."""

    def evaluate(*columns):
        row = spark.range(1).select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return evaluate


@pytest.fixture(scope="session")
def make_actions(spark):
    """Typed actions from short rows: session, user, time and optional fields."""
    from clickloom.sources import model

    def make(*rows):
        full = []
        for session_id, user_id, time, *rest in rows:
            fields = dict.fromkeys(model.RAW_ACTION.names)
            fields |= {"click_category_id": -1, "click_product_id": -1, "page_id": 0, "city_id": 0}
            fields |= {"session_id": session_id, "user_id": user_id, "action_time": time}
            fields |= {"date": time[:10]}
            fields |= rest[0] if rest else {}
            full.append(tuple(fields[n] for n in model.RAW_ACTION.names))
        return model.normalise_actions(spark.createDataFrame(full, model.RAW_ACTION))

    return make


@pytest.fixture(scope="session")
def make_users(spark):
    from clickloom.sources import model

    def make(*rows):
        full = [(i, "u", "n", age, job, city, sex) for i, age, job, city, sex in rows]
        return spark.createDataFrame(full, model.USER)

    return make


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df) -> str:
    """The ``explain("formatted")`` text."""
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString("formatted"))
