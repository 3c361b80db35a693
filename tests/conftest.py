import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aphora.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "aphora-tests", "local[8]", 8,
        **{
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def model(spark):
    from aphora.sources.model import Model

    return Model(spark, DATA)


@pytest.fixture
def value(spark):
    """Evaluate a column expression on one row."""
    def evaluate(column, **inputs):
        schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else _type(v)}" for k, v in inputs.items())
        rows = spark.createDataFrame([tuple(inputs.values())], schema) if inputs else spark.range(1)
        return rows.select(column.alias("v")).first()["v"]

    def _type(v):
        if isinstance(v, bool):
            return "boolean"
        if isinstance(v, int):
            return "bigint"
        if isinstance(v, float):
            return "double"
        return "array<string>"

    return evaluate
