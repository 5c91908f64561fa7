"""Time the headline queries and print one JSON line.

The corpus (file metadata, texts, inventory and so on) is derived from the test
tables and written as tables before the clock starts, as an engine would find
it. Each query then runs to the end and its rows are thrown away, so neither
collecting nor writing results is part of the time.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "link_counts",
    "rewritten_docs",
    "conversion_plan",
    "published_docs",
    "folder_closure",
    "link_closure",
    "discovered",
    "front_matter",
    "sync_results",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from pyspark.sql import SparkSession

    from linkloom.fixtures import Fixtures
    from linkloom.queries import over_views

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = over_views()
    folder = tempfile.mkdtemp(prefix="linkloom-bench-")
    corpus = Fixtures(spark, sf_dir).kept_as_tables(folder, 2 * int(cpus))
    run(queries["link_counts"](corpus))  # start the JVM's code paths once
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        run(queries[name](corpus))
        seconds[name] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
