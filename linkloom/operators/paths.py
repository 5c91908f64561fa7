"""Output paths: planning, collision suffixes and relative links."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.naming import output_path, relative_path

POSITIONS_PER_BLOCK = 65_536


def plan_paths(records: DataFrame, base: str) -> DataFrame:
    """Add ``path`` from each record's ``dirs`` and ``file_name``."""
    return records.withColumn(
        "path", output_path(base, F.col("dirs"), F.col("file_name"))
    )


def unique_paths(plan: DataFrame, order: str = "rec_pos") -> DataFrame:
    """Give repeated paths ``_1``, ``_2``, … before the extension, in order.

    ``order`` must be unique. One path may be shared by a large part of all
    rows (titles without Latin letters all get one name), so rows are numbered
    per path *and* block of consecutive positions, which bounds every window
    group, and the blocks of a path are put behind one another by their row
    counts. Only those counts meet in one group. The plan is read twice, so it
    should be a table rather than a long query.
    """
    rows = plan.withColumn(
        "_block", F.floor(F.col(order) / POSITIONS_PER_BLOCK).cast("long")
    )
    in_order = Window.partitionBy("path").orderBy("_block")
    before = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        rows.groupBy("path", "_block")
        .agg(F.count("*").alias("_n"))
        .select("path", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    in_block = Window.partitionBy("path", "_block").orderBy(order)
    nth = F.col("_before") + F.col("_in_block") - 1
    suffixed = F.concat(
        F.regexp_replace("path", r"\.[^./]*+\z", ""),
        F.lit("_"),
        nth.cast("string"),
        F.regexp_extract("path", r"\.[^./]*+\z", 0),
    )
    return (
        rows.withColumn("_in_block", F.row_number().over(in_block))
        .join(offsets, ["path", "_block"])
        .withColumn("path", F.when(nth == 0, F.col("path")).otherwise(suffixed))
        .drop("_block", "_before", "_in_block")
    )


def relative_paths(
    pairs: DataFrame,
    source: str = "source_dirs",
    target: str = "target_dirs",
    target_file: str = "target_file",
) -> DataFrame:
    """Add ``relative_path`` from a source directory to a target file."""
    return pairs.withColumn(
        "relative_path", relative_path(F.col(source), F.col(target), F.col(target_file))
    )
