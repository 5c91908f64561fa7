"""The inventory as a lookup from URLs and file IDs to published documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.naming import FRAGMENT_COLUMNS, directories, file_name
from linkloom.functions.urls import file_id

_RECORD = ("rec_pos", "link", "title", "record_id", "dirs", "file_name")


def with_placement(inventory: DataFrame) -> DataFrame:
    """Add each record's file ID, directories and file name."""
    return inventory.withColumns(
        {
            "record_id": file_id(F.col("link")),
            "dirs": directories(*(F.col(c) for c in FRAGMENT_COLUMNS)),
            "file_name": file_name(F.col("title")),
        }
    )


def latest_per_key(df: DataFrame, key: str, order: str, columns) -> DataFrame:
    """The row with the highest ``order`` per key; combines before its shuffle."""
    kept = F.max_by(F.struct(*columns), F.col(order)).alias("kept")
    return df.groupBy(key).agg(kept).select(key, "kept.*")


def link_index(inventory: DataFrame) -> DataFrame:
    """One row per key, a key being a record's link or its file ID.

    Later records replace earlier ones under the same key. A record whose link
    names no file is found by its link only.
    """
    records = inventory if "dirs" in inventory.columns else with_placement(inventory)
    keys = F.explode(F.array("link", "record_id"))
    keyed = records.select(keys.alias("key"), *_RECORD).filter("key IS NOT NULL")
    return latest_per_key(keyed, "key", "rec_pos", _RECORD)


def url_overrides(index: DataFrame) -> DataFrame:
    """URL keys that lead to another record than the file ID in the URL does.

    For every other URL key, looking up the file ID gives the same record, so
    this (usually tiny) part of the index is all that exact matching needs. A
    record whose link names no file is no override: links that resolve name one,
    or are looked up by their URL in the index itself.
    """
    by_url = index.filter((F.col("key") == F.col("link")) & F.col("record_id").isNotNull())
    by_id = index.select(
        F.col("key").alias("record_id"), F.col("rec_pos").alias("id_rec_pos")
    )
    return (
        by_url.join(by_id, "record_id", "left")
        .filter(~F.col("rec_pos").eqNullSafe(F.col("id_rec_pos")))
        .drop("id_rec_pos")
    )


def resolve_targets(
    links: DataFrame,
    index: DataFrame,
    overrides: DataFrame | None = None,
    url: str = "url",
    target_id: str = "dst",
    fields=_RECORD,
) -> DataFrame:
    """Add ``target``: ``fields`` of the record a link leads to, or null.

    A record with exactly this URL comes first, then one with the same file ID.
    Whether either lookup is broadcast is left to Spark, by its size; pass
    written tables for ``index`` and ``overrides`` to have the sizes known when
    the join is planned. Links without a file ID look up their URL instead,
    which changes no result and keeps them from meeting under one null key.
    """
    if overrides is None:
        overrides = url_overrides(index)
    exact = overrides.select(F.col("key").alias(url), F.struct(*fields).alias("_exact"))
    by_id = index.select(F.col("key").alias("_id"), F.struct(*fields).alias("_by_id"))
    return (
        links.withColumn("_id", F.coalesce(target_id, url))
        .join(exact, url, "left")
        .join(by_id, "_id", "left")
        .withColumn("target", F.coalesce("_exact", "_by_id"))
        .drop("_id", "_exact", "_by_id")
    )
