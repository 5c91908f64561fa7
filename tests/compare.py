"""Run every query in Spark and its SQL check in DuckDB and compare the rows.

Usage: ``python tests/compare.py [sf_dir] [query ...]``
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows as text, with columns by name and in sorted order."""
    frame = frame[sorted(frame.columns)]
    cells = [
        [None if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in row]
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted((tuple(r) for r in cells), key=lambda r: tuple((c is None, c or "") for c in r))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'"
        )
    return connection


def difference(spark, connection, name: str, sf_dir: str) -> str | None:
    import __spark_entry__ as contract

    ours = contract.queries()[name](spark, sf_dir).toPandas()
    theirs = connection.execute(contract.oracle_sql()[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(normal(ours), normal(theirs)):
        if a != b:
            return f"\n  spark {str(a)[:900]}\n  sql   {str(b)[:900]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    for name in sys.argv[2:] or contract.queries():
        start = time.time()
        try:
            problem = difference(spark, connection, name, sf_dir)
        except Exception as error:  # report and carry on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:18} {time.time() - start:6.1f}s {'same' if problem is None else problem}", flush=True)
