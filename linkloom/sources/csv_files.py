"""Seed lists and inventories as CSV, and the discovery report.

A path may be a file, a folder of files or a pattern. Every file has a header of
its own, and its columns are found by that header, so files of one folder may
order them differently. No schema is inferred. Rows with another number of fields than their
file's header are rejected; ``rejected_rows`` returns them.

Rows are numbered by file name, then by place in the file, whatever the sizes of
files: a file's rows are counted first, and its numbers start where those of the files
before it end.

Fields may hold quoted line breaks, and files with such fields cannot be split:
each is read by one task. Say ``multi_line=False`` when no field holds a line
break, and files split as usual; rows that it breaks are among the rejected ones.
A header has to be one line. Very large inventories are better kept as tables with
``rec_pos``.
"""

import csv
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.naming import FRAGMENT_COLUMNS
from linkloom.functions.text import blank_if_null
from linkloom.operators.storage import RunFolder

_BAD = "_bad_row"
_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": True,
    "enforceSchema": True,
}


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each header. What is fetched is a line per file, as Spark's own file list is."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    )
    first = lines.filter("value <> ''").groupBy("file").agg(F.min(F.struct("block", "id", "value")).alias("first"))
    files: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(first.select("file", "first.value").collect()):
        names = next(csv.reader([row["value"]], skipinitialspace=True))
        files.setdefault(tuple(names), []).append(row["file"])
    if not files:
        raise ValueError(f"no CSV header in {path}")
    return files


def _plain(file: str) -> str:
    """A file's URI as the readers take it."""
    parts = urlsplit(file)
    return unquote(parts.path) if parts.scheme == "file" else unquote(file)


def _rows(
    spark: SparkSession, files: list[str], width: int, multi_line: bool
) -> DataFrame:
    schema = T.StructType(
        [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
        + [T.StructField(_BAD, T.StringType())]
    )
    return (
        spark.read.schema(schema)
        .options(**_OPTIONS, header=True, multiLine=multi_line)
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, columnPruning=False)
        .csv([_plain(file) for file in files])
    )


def _in_order(spark: SparkSession, parts: list[DataFrame], position: str) -> DataFrame:
    """The rows of all files under one number, ``position``.

    A part of a file is read by one task, so its rows follow one another. Only the
    sizes of those parts are fetched.
    """
    run = RunFolder(spark, "csv")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    rows = run.keep(union, "rows")
    sizes = rows.groupBy("_file", "_block").agg(F.min("_id"), F.count("*")).collect()
    starts, before = [], 0
    for file, block, first, size in sorted(sizes):
        starts.append((file, block, before - first))
        before += size
    offsets = spark.createDataFrame(starts, "_file string, _block long, _offset long")
    placed = rows.join(F.broadcast(offsets), ["_file", "_block"])
    return placed.withColumn(position, F.col("_id") + F.col("_offset")).drop("_file", "_block", "_id", "_offset")


def _numbering() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    ]


def rejected_rows(
    spark: SparkSession, path: str, multi_line: bool = True
) -> DataFrame:
    """``(row, file)``: the raw rows whose field count differs from that of their file's header."""
    parts = []
    for header, files in _headers(spark, path).items():
        rows = _rows(spark, files, len(header), multi_line)
        # Spark refuses to read raw rows alone, so the first field is read as well.
        also_read = F.length(F.coalesce("c0", F.lit(""))) >= 0
        bad = rows.filter(F.col(_BAD).isNotNull() & also_read)
        parts.append(bad.select(F.col(_BAD).alias("row"), F.col("_metadata.file_path").alias("file")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def read_seeds(
    spark: SparkSession, path: str, multi_line: bool = True
) -> DataFrame:
    """``(seed_pos, url)`` from each file's first column named ``url`` or ``link``."""
    parts = []
    for header, files in _headers(spark, path).items():
        found = [i for i, name in enumerate(header) if name.lower() in ("url", "link")]
        if not found:
            raise ValueError(f"no 'url' or 'link' column found in {files[0]}")
        url = blank_if_null(F.col(f"c{found[0]}")).alias("url")
        parts.append(_rows(spark, files, len(header), multi_line).select(url, _BAD, *_numbering()))
    rows = _in_order(spark, parts, "seed_pos")
    return rows.filter(F.col(_BAD).isNull() & (F.col("url") != "")).select("seed_pos", "url")


def read_inventory(
    spark: SparkSession, path: str, multi_line: bool = True
) -> DataFrame:
    """``(rec_pos, link, title, tags, frag1..frag5)``; the last column of a name counts.

    ``link`` and ``title`` are required in every file and rows without them are
    dropped; missing optional columns are empty.
    """
    names = ("link", "title", "tags", *FRAGMENT_COLUMNS)
    parts = []
    for header, files in _headers(spark, path).items():
        position = {name.lower(): i for i, name in enumerate(header)}
        for required in ("link", "title"):
            if required not in position:
                raise ValueError(f"required column '{required}' not found in {files[0]}")
        columns = (
            (blank_if_null(F.col(f"c{position[n]}")) if n in position else F.lit("")).alias(n) for n in names
        )
        parts.append(_rows(spark, files, len(header), multi_line).select(*columns, _BAD, *_numbering()))
    rows = _in_order(spark, parts, "rec_pos")
    return rows.filter(F.col(_BAD).isNull() & (F.col("link") != "") & (F.col("title") != "")).select("rec_pos", *names)


def write_discovery(discovered: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``link,title,status`` in discovery order; ``available`` is written blank."""
    from linkloom.operators.crawl import in_report_order

    status = F.when(F.col("status") == "available", "").otherwise(F.col("status"))
    (
        in_report_order(discovered)
        .select("link", "title", status.alias("status"))
        .write.mode(mode)
        .options(
            header=True,
            quote='"',
            escape='"',
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )
