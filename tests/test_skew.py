"""Hot keys in joins that adaptive execution is left to split.

Each join must keep the shape it can split: a shuffle of the many rows right
below the join. The thresholds are lowered so that small data counts as skewed.
"""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import crawl, inventory, metadata, rewrite, storage

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def low_limits(spark):
    before = {key: spark.conf.get(key, None) for key in LOW}
    for key, value in LOW.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def url(name):
    return f"https://docs.google.com/document/d/{name}/edit"


def hot_ids(spark, rows):
    """A third of all rows name one file."""
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), "id"))
    return spark.range(0, rows, 1, 8).withColumn("name", name)


def test_links_to_one_target(spark, low_limits):
    listed = hot_ids(spark, 3000).select("name").distinct().select(
        F.xxhash64("name").alias("rec_pos"),
        F.concat(F.lit("https://docs.google.com/document/d/"), "name", F.lit("/edit")).alias("link"),
        F.col("name").alias("title"),
        F.lit("").alias("tags"),
        *(F.lit("x").alias(f"frag{i}") for i in range(1, 6)),
    )
    run = storage.RunFolder(spark, "skew")
    index = run.keep(inventory.link_index(listed), "index")
    overrides = run.keep(inventory.url_overrides(index), "overrides")
    contents = run.keep(
        hot_ids(spark, 6000).select(
            F.concat(F.lit("s"), "id").alias("file_id"),
            F.format_string("[a](https://docs.google.com/document/d/%s/edit?n=%d)", "name", "id").alias("markdown"),
        ),
        "contents",
    )
    targets = rewrite.link_targets(rewrite.markdown_links(contents), index, overrides)
    rows, plan = executed(targets)
    assert "skew=true" in plan
    # links to hot and to the 2,000 other listed files resolve; the rest do not
    assert len(rows) == 2000 + 2000


def test_files_of_one_folder(spark, low_limits):
    run = storage.RunFolder(spark, "skew")
    files = run.keep(
        hot_ids(spark, 6000).select(
            F.concat(F.lit("doc"), "id").alias("file_id"),
            F.concat(F.lit("Name "), "id").alias("name"),
            F.lit("application/pdf").alias("mime_type"),
            F.col("name").alias("parent_id"),
            F.lit(False).alias("trashed"),
            F.lit(200).alias("http_status"),
        ),
        "files",
    )
    roots = hot_ids(spark, 6000).select(
        F.col("name").alias("file_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seed_pos")
    )
    rows, plan = executed(crawl.folder_closure(run, roots, files))
    assert "skew=true" in plan
    assert len({r.file_id for r in rows}) == len(rows) == 6000


def test_references_to_one_file(spark, low_limits):
    run = storage.RunFolder(spark, "skew")
    refs = run.keep(
        hot_ids(spark, 6000).select(F.col("name").alias("file_id"), F.sha2(F.col("id").cast("string"), 256).alias("link")),
        "refs",
    )
    files = run.keep(
        hot_ids(spark, 6000).select(F.col("name").alias("file_id"), F.lit(200).alias("http_status")).distinct(),
        "files",
    )
    rows, plan = executed(metadata.attach_metadata(refs, files))
    assert "skew=true" in plan
    assert len(rows) == 6000 and all(r.http_status == 200 for r in rows)
