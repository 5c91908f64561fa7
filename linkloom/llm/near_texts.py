"""Near-equal texts: five-word shingles, candidates by MinHash bands, an exact check.

Two texts are near-equal if the Jaccard similarity of their sets of shingles is
``SIMILARITY`` or more. Candidates agree in one band of ``ROWS`` least hashes. In
each band all meet the band's first text, so a text has at most one candidate per
band, however many share it, and its firsts differ from band to band. Every link is
checked with the whole sets. Equal texts are one key throughout. A chain of texts of
which only neighbours are near-equal may come out as several classes.
"""

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import word_list
from linkloom.llm.components import connected_components
from linkloom.operators.storage import RunFolder

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity s is a candidate with 1 - (1 - s^ROWS)^BANDS: 0.997 at 0.8.
ROWS, BANDS = 3, 8

_MASKS = [random.Random(k).getrandbits(64) - (1 << 63) for k in range(ROWS * BANDS)]


def shingles(text: Column) -> Column:
    """Hashes of the word shingles of a text; of all its words where they are fewer."""
    def of_words(words: Column) -> Column:
        short = F.array(F.xxhash64(F.array_join(words, " ")))
        at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
        runs = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
        return F.when(F.size(words) < SHINGLE, short).otherwise(runs)

    # The argument of a lambda is made once; Spark writes out other expressions at each use.
    return F.get(F.transform(F.array(word_list(F.lower(text))), of_words), F.lit(0))


def _bands(texts: DataFrame) -> DataFrame:
    """``(band, key)``: least hashes, each in an order of its own, ``ROWS`` to a band."""
    each = texts.select("key", F.explode(shingles(F.col("text"))).alias("x"))
    least = each.groupBy("key").agg(*(F.min(F.col("x").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(_MASKS)))
    bands = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + k}" for k in range(ROWS))) for b in range(BANDS)]
    return least.select("key", F.explode(F.array(*bands)).alias("band"))


def _upper_half(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def _checked(pairs: DataFrame, texts: DataFrame, run: RunFolder, name: str, similarity: float) -> DataFrame:
    """Those of ``pairs(u, v)`` that are near-equal.

    Sets hold the upper halves of the hashes, which halves what is moved. Of the shingles
    that one text lacks, one in four billion times their number is taken for another's.
    """
    wanted = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    wanted = run.keep(wanted, f"{name}_wanted")  # texts stay where they are if these are few
    sets = texts.join(wanted, "key", "left_semi").select("key", F.array_distinct(F.transform(shingles(F.col("text")), _upper_half)).alias("set"))
    sets = run.keep(sets.dropDuplicates(["key"]), f"{name}_sets")
    left, right = sets.select(F.col("key").alias("u"), F.col("set").alias("a")), sets.select(F.col("key").alias("v"), F.col("set").alias("b"))
    # Sets are about as large as texts, so they are never sent to all tasks, however few there are.
    sized = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("both"))
    return run.keep(sized.filter(F.col("n") >= similarity * (F.col("both") - F.col("n"))).select("u", "v"), f"{name}_links")


def near_classes(texts: DataFrame, run: RunFolder, similarity: float = SIMILARITY) -> DataFrame:
    """``(key, root)`` for every key of ``texts(key, text)`` that has a near-equal text.

    Classes are the components of the links. Rows with one key have one text.
    """
    bands = run.keep(_bands(texts), "bands")
    shared = bands.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first <> last").select("band", "first")
    shared = run.keep(bands.join(shared, "band"), "shared_bands")
    stars = run.keep(shared.filter("key <> first").select(F.col("key").alias("u"), F.col("first").alias("v")).distinct(), "stars")
    links = _checked(stars, texts, run, "star", similarity)
    return run.keep(connected_components(links, run, "near").select(F.col("node").alias("key"), "root"), "near_classes")
