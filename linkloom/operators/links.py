"""Links found in document texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.access import is_link_source
from linkloom.functions.urls import file_id, mentions_drive, repair_urls, urls_in_text


def with_file_id(df: DataFrame, url: str = "link", out: str = "file_id") -> DataFrame:
    return df.withColumn(out, file_id(F.col(url)))


def link_sources(files: DataFrame) -> DataFrame:
    """IDs of readable files whose text is searched for links."""
    return files.filter(
        (F.col("http_status") == 200) & is_link_source(F.col("mime_type"))
    ).select("file_id")


def extract_links(contents: DataFrame, repair: bool = True) -> DataFrame:
    """``(src, pos, url, dst)`` for every drive URL in a text but self-links.

    Texts are reduced to their URLs where they are scanned; only those rows
    travel further.
    """
    return _edges(_urls_by_document(contents, repair))


def document_links(
    contents: DataFrame, files: DataFrame, partitions: int | None = None
) -> DataFrame:
    """``extract_links`` for the documents that are searched for links.

    With ``partitions`` the result is hash-partitioned by ``src``: documents
    are placed once, as one row each, before the join and before their URLs
    are spread out.
    """
    found = _urls_by_document(contents)
    if partitions is not None:
        found = found.repartition(partitions, "src")
    sources = link_sources(files).withColumnRenamed("file_id", "src")
    return _edges(found.join(sources, "src", "left_semi"))


def _urls_by_document(contents: DataFrame, repair: bool = True) -> DataFrame:
    text = F.col("markdown")
    urls = urls_in_text(repair_urls(text) if repair else text)
    return contents.filter(mentions_drive(text)).select(
        F.col("file_id").alias("src"), urls.alias("urls")
    )


def _edges(found: DataFrame) -> DataFrame:
    return (
        spread_urls(found, "src")
        .select("src", "pos", "url", once(file_id(F.col("url"))).alias("dst"))
        .filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))
    )


def spread_urls(found: DataFrame, key: str) -> DataFrame:
    """One row per URL of ``urls``, with its position.

    The outer form is used because Spark guards the plain one with a filter on
    the array, which would search every text again.
    """
    return found.select(key, F.posexplode_outer("urls").alias("pos", "url")).filter(
        F.col("url").isNotNull()
    )


def once(expr: Column) -> Column:
    """Keep an expression from being repeated in the filters that use it."""
    return F.explode(F.array(expr))
