"""Change detection between a published tree and current metadata."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.access import is_workspace
from linkloom.functions.fixed_values import STUB_HASH
from linkloom.functions.frontmatter import parse_front_matter
from linkloom.functions.urls import file_id


def read_headers(md_files: DataFrame) -> DataFrame:
    """Front matter of Markdown files and the file each one came from.

    The text itself stays behind. ``file_id`` is given only where it is needed:
    for parsed files with a revision hash, other than stubs, and a link.
    """
    values = F.col("front_matter")
    old_hash = F.try_element_at(values, F.lit("hash-gdrive"))
    link = F.try_element_at(values, F.lit("gdrive-link"))
    return (
        parse_front_matter(md_files)
        .select("path", "parse_error", "front_matter")
        .withColumns({"old_hash": old_hash, "link": link})
        .withColumn(
            "file_id", F.when(F.col("old_hash") != STUB_HASH, file_id(F.col("link")))
        )
    )


def order_files(results: DataFrame) -> DataFrame:
    """Results in path order, for presentation."""
    return results.orderBy("file_path")


def detect_changes(headers: DataFrame) -> DataFrame:
    """Add ``status``, ``error`` and ``new_hash``; the first rule decides.

    Needs the columns of ``read_headers`` and, joined by file ID,
    ``mime_type``, ``modified_time``, ``http_status``, ``has_content`` and
    ``rec_pos`` (of the inventory record found under the file ID). A revision
    counts as changed when its hash differs, not when it is newer.
    """
    readable = F.coalesce(F.col("http_status") == 200, F.lit(False))
    workspace = F.coalesce(is_workspace(F.col("mime_type")), F.lit(False))
    rules = [
        (F.col("parse_error").isNotNull(), "error", F.col("parse_error")),
        (F.col("old_hash").isNull(), "skipped", F.lit("no hash-gdrive field found")),
        (F.col("old_hash") == STUB_HASH, "skipped", F.lit(None)),
        (F.col("link").isNull(), "skipped", F.lit("no gdrive-link field found")),
        (F.col("file_id").isNull(), "error", F.lit("failed to extract file ID")),
        (~readable, "error", F.lit("failed to get file metadata")),
        (F.col("old_hash") == F.col("modified_time"), "unchanged", F.lit(None)),
        (
            ~workspace,
            "error",
            F.concat(
                F.lit("failed to export document: unsupported MIME type: "),
                F.coalesce("mime_type", F.lit("")),
            ),
        ),
        (
            F.col("has_content").isNull(),
            "error",
            F.lit("failed to export document"),
        ),
        (F.col("rec_pos").isNull(), "error", F.lit("record not found in link map")),
    ]
    status, error = F, F
    for condition, outcome, message in rules:
        status = status.when(condition, outcome)
        error = error.when(condition, message.cast("string"))
    reported = F.col("link").isNotNull() & (F.col("old_hash") != STUB_HASH)
    looked_up = F.col("file_id").isNotNull() & readable
    return headers.withColumns(
        {
            "status": status.otherwise("updated"),
            "error": error,
            "new_hash": F.when(looked_up, F.col("modified_time")).otherwise(""),
            "old_hash": F.when(reported, F.col("old_hash")).otherwise(""),
        }
    )
