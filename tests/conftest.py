import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("linkloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Apply a column expression to rows of strings and return the values."""

    def run(expression, rows, columns=("a",)):
        rows = [row if isinstance(row, tuple) else (row,) for row in rows]
        schema = ", ".join(
            ["n int", *(c if " " in c else f"{c} string" for c in columns)]
        )
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
        out = df.select("n", expression.alias("out")).orderBy("n").collect()
        return [row["out"] for row in out]

    return run
