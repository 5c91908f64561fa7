"""Snapshot tables of file metadata and document text.

``files`` holds one row per file and ``contents`` the exported text of each
document. Both are read lazily, so only the columns a plan uses are scanned.

Whether a document has a text can only be told from the text column, which is as
large as the texts. ``land_contents`` therefore writes a narrow table beside the
texts, ``(file_id, texts)``, and plans that need no text read that one instead.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("modified_time", T.StringType()),
        T.StructField("trashed", T.BooleanType()),
        T.StructField("http_status", T.IntegerType()),
    ]
)
CONTENTS_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("markdown", T.StringType()),
    ]
)
PARENTS_SCHEMA = T.StructType(
    [
        T.StructField("child", T.StringType()),
        T.StructField("parent", T.StringType()),
    ]
)
PRESENCE_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("texts", T.LongType()),
    ]
)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES_SCHEMA).parquet(path)


def scan_parents(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent)``, a row for each folder that a file or folder lies in."""
    return spark.read.schema(PARENTS_SCHEMA).parquet(path)


def scan_contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTENTS_SCHEMA).parquet(path)


def text_presence(contents: DataFrame) -> DataFrame:
    """``(file_id, texts)``: how many texts that are not null each document has, one or more."""
    there = contents.filter("markdown IS NOT NULL")
    return there.groupBy("file_id").agg(F.count("*").alias("texts"))


def land_contents(contents: DataFrame, path: str, mode: str = "overwrite") -> tuple[DataFrame, DataFrame]:
    """Write texts to ``path/contents`` and their presence to ``path/presence``; both, as tables.

    The presence is counted from the table just written, so it fits it even if
    ``contents`` would give other rows a second time.
    """
    spark = contents.sparkSession
    contents.select("file_id", "markdown").write.mode(mode).parquet(f"{path}/contents")
    landed = scan_contents(spark, f"{path}/contents")
    text_presence(landed).write.mode("overwrite").parquet(f"{path}/presence")
    return landed, scan_presence(spark, f"{path}/presence")


def scan_presence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRESENCE_SCHEMA).parquet(path)
