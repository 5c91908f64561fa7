"""Counts over the results of the pipelines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def discovery_summary(discovered: DataFrame) -> DataFrame:
    return discovered.groupBy("status").agg(F.count("*").alias("files"))


def convert_summary(plan: DataFrame) -> DataFrame:
    errors = F.count_if(F.col("error").isNotNull())
    return plan.agg(
        F.count("*").alias("records"),
        errors.alias("errors"),
        (errors > 0).alias("failed"),
    )


def sync_summary(results: DataFrame) -> DataFrame:
    def having(status: str):
        return F.count_if(F.col("status") == status)

    return results.agg(
        having("updated").alias("updated"),
        having("unchanged").alias("unchanged"),
        having("skipped").alias("skipped"),
        having("error").alias("errors"),
        (having("error") > 0).alias("failed"),
    )
