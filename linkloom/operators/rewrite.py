"""Links in document texts rewritten to relative paths.

Texts are large and links are small, so texts are never multiplied by their
links. The links are cut out where texts are scanned, resolved on their own,
gathered per document, and met with the text again in the one join that also
brings text and publishing plan together.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.naming import relative_path
from linkloom.functions.urls import (
    file_id,
    links_with_text,
    markdown_link_urls,
    mentions_drive,
    repair_urls,
    text_after_links,
)
from linkloom.operators.inventory import resolve_targets
from linkloom.operators.links import spread_urls
from linkloom.operators.storage import RunFolder


def texts_of(run: RunFolder, contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each document that is ``wanted(file_id, texts)``.

    The wanted IDs are kept as a table, so Spark knows their size: it sends them
    to the scan when they are small and shuffles both sides when they are not. Of
    several texts of a document the least that is not null counts; which documents
    have several is known from their number of ``texts``.
    """
    ids = run.keep(wanted.groupBy("file_id").agg(F.max("texts").alias("texts")), "wanted")
    texts = contents.filter("markdown IS NOT NULL").join(ids, "file_id", "left_semi")
    repeated = ids.filter("texts > 1").select("file_id")
    if repeated.isEmpty():
        return texts
    one = texts.join(repeated, "file_id", "left_semi").groupBy("file_id").agg(F.min("markdown").alias("markdown"))
    return texts.join(repeated, "file_id", "left_anti").unionByName(one)


def _repaired(repair: bool) -> Column:
    return repair_urls(F.col("markdown")) if repair else F.col("markdown")


def markdown_links(contents: DataFrame, repair: bool = True) -> DataFrame:
    """``(file_id, pos, url, dst)`` for every Markdown link to a drive host."""
    found = contents.filter(mentions_drive(F.col("markdown"))).select(
        "file_id", markdown_link_urls(_repaired(repair)).alias("urls")
    )
    return spread_urls(found, "file_id").withColumn("dst", file_id(F.col("url")))


def link_targets(
    links: DataFrame, index: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """``(file_id, targets)``: where each link of a document leads, in text order.

    Unresolved links keep an entry without a target, so entries and links stay
    aligned; documents without any resolved link give no row. A group is one
    document's links.
    """
    entry = F.struct("pos", F.col("target.dirs"), F.col("target.file_name"))
    return (
        resolve_targets(links, index, overrides, fields=("dirs", "file_name"))
        .groupBy("file_id")
        .agg(
            F.array_sort(F.collect_list(entry)).alias("targets"),
            F.count("target").alias("_resolved"),
        )
        .filter(F.col("_resolved") > 0)
        .drop("_resolved")
    )


def rewritten_text(docs: DataFrame, repair: bool = True) -> DataFrame:
    """Add ``text``: ``markdown`` with resolved links made relative to ``dirs``.

    Needs ``markdown``, ``targets`` (null when there is nothing to replace) and
    ``dirs``. Links are replaced in place; unresolved ones and everything
    between links stay byte for byte.
    """

    def replaced(link: Column, target: Column) -> Column:
        path = relative_path(F.col("dirs"), target["dirs"], target["file_name"])
        before = F.regexp_extract(link, r"\A[^\[\]]*+", 0)
        label = F.substring_index(F.substr(link, F.length(before) + 1), "]", 1)
        relative = F.concat(before, label, F.lit("]("), path, F.lit(")"))
        return F.when(target["file_name"].isNull(), link).otherwise(relative)

    some = F.col("targets").isNotNull()
    woven = F.array_join(F.zip_with("_links", "targets", replaced), "")
    return (
        docs.withColumn("_repaired", _repaired(repair))
        .withColumns(
            {
                "_links": F.when(some, links_with_text(F.col("_repaired"))),
                "_after": F.when(some, text_after_links(F.col("_repaired"))),
            }
        )
        .withColumn(
            "text", F.when(some, F.concat(woven, "_after")).otherwise(F.col("_repaired"))
        )
        .drop("_repaired", "_links", "_after", "targets", "markdown")
    )
