"""A training corpus from raw documents: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.line_dedup import drop_recurring_lines
from linkloom.llm.mixing import mix_documents
from linkloom.llm.packing import pack_documents
from linkloom.llm.simhash import keep_one_per_group
from linkloom.llm.toxicity import drop_toxic
from linkloom.operators.storage import RunFolder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a half."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose template recurs across documents."""
    changed, _ = drop_recurring_lines(docs)
    n_chars = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose SimHash fingerprints (three-word shingles) differ by two bits at most.

    Null texts count as empty, and those are one group; of repeated rows one stays.
    """
    return keep_one_per_group(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sources' budgets choose, repeated where epochs are."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: A linear classifier, hashes and best fit are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``."""
    folder = RunFolder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = folder.keep(stage(spark, docs, sf_dir), name)
    return docs
