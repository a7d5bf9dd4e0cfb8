from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A frame from rows and a schema string, spread over a few partitions."""

    def build(rows, schema, partitions=3):
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return build


@pytest.fixture
def evaluate(spark):
    """Values of an SQL expression over ``v`` for each given value."""

    def run(expression, values, schema="string"):
        rows = [(i, value) for i, value in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {schema}")
        found = df.selectExpr("i", f"{expression} AS r").orderBy("i").collect()
        return [row["r"] for row in found]

    return run
