"""Joins from many rows to one heavy row per key, safe for hot keys."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.storage import RunFolder

ROWS_PER_SLICE = 20_000
#: Hot keys that are sliced, at most, and keys that a sketch keeps count of.
HOT_KEYS, TRACKED_KEYS = 10_000, 200_000


@dataclass(frozen=True)
class Spread:
    """How the rows of hot keys are spread over slices.

    ``slice_rows`` marks each row of the many-side with a slice, ``copies``
    repeats each row of the one-side for every slice of its key; the two are
    then joined on ``keys``. Without hot keys both leave their input as it is.
    """

    key: str
    hot: DataFrame | None

    @property
    def keys(self) -> list[str]:
        return [self.key] if self.hot is None else [self.key, "_slice"]

    def slice_rows(self, many: DataFrame, row_id: str) -> DataFrame:
        if self.hot is None:
            return many
        chosen = F.pmod(F.xxhash64(row_id), F.col("_slices"))
        return (
            many.join(self.hot, self.key, "left")
            .withColumn("_slice", F.coalesce(chosen, F.lit(0)))
            .drop("_slices")
        )

    def copies(self, one: DataFrame) -> DataFrame:
        if self.hot is None:
            return one
        last = F.coalesce(F.col("_slices"), F.lit(1)) - 1
        return (
            one.join(self.hot, self.key, "left")
            .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .drop("_slices")
        )


def measure_spread(
    run: RunFolder, many: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE
) -> Spread:
    """Find the keys of ``many`` that hold more rows than one slice may.

    They come from a sketch of frequent items, of fixed size in every task, so
    neither all keys nor all counts are shuffled. It overlooks no key with more than about
    four in ``TRACKED_KEYS`` of all rows, and counts at most that much too high, which
    costs a few slices and changes no row. The at most ``HOT_KEYS`` keys are a
    table of the run, which Spark knows the size of.
    """
    top = F.call_function("approx_top_k", F.col(key), F.lit(HOT_KEYS), F.lit(TRACKED_KEYS))
    found = many.filter(F.col(key).isNotNull()).agg(top.alias("top"))
    hot = (
        found.select(F.inline("top"))
        .filter(F.col("count") > rows_per_slice)
        .select(F.col("item").alias(key), F.ceil(F.col("count") / rows_per_slice).alias("_slices"))
    )
    hot = run.keep(hot, f"hot_{key}")
    return Spread(key, None if hot.isEmpty() else hot)
