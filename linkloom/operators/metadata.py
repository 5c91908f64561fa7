"""File metadata joined to references, and access status."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.access import access_status, is_folder
from linkloom.functions.fixed_values import INVALID_SEED_TITLE
from linkloom.operators.skew import Spread


def attach_metadata(
    refs: DataFrame,
    metadata: DataFrame,
    spread: Spread | None = None,
    row_id: str = "rec_pos",
) -> DataFrame:
    """Left join on ``file_id``: a file without metadata keeps its row.

    References without a file ID are left out of the join and put back after
    it, so they never gather in one partition.
    """
    named = refs.filter(F.col("file_id").isNotNull())
    if spread is None:
        joined = named.join(metadata, "file_id", "left")
    else:
        joined = spread.slice_rows(named, row_id).join(
            spread.copies(metadata), spread.keys, "left"
        )
    unnamed = refs.filter(F.col("file_id").isNull())
    return joined.unionByName(unnamed, allowMissingColumns=True)


def live_children(files: DataFrame) -> DataFrame:
    """What folder listings return: everything not in the trash."""
    return files.filter(~F.coalesce(F.col("trashed"), F.lit(False)))


def classify_access(refs: DataFrame) -> DataFrame:
    """Add ``title`` and ``status`` to references with their metadata.

    References without a file ID are invalid and keep their link; a failed file
    is titled with its ID.
    """
    status = F.when(F.col("file_id").isNull(), "invalid").otherwise(
        access_status(F.col("http_status"))
    )
    title = (
        F.when(F.col("file_id").isNull(), INVALID_SEED_TITLE)
        .when(F.col("http_status") == 200, F.col("name"))
        .otherwise(F.col("file_id"))
    )
    return refs.withColumns({"status": status, "title": title})


def readable_folder() -> Column:
    readable = F.col("http_status") == 200
    return F.coalesce(readable & is_folder(F.col("mime_type")), F.lit(False))
