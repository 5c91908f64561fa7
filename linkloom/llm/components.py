"""Connected components of a graph whose edges are rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.storage import RunFolder


def _towards_least(edges: DataFrame) -> DataFrame:
    """Alternate half of the star contraction: every vertex's neighbours link to its least one.

    ``edges`` is ``(u, v)`` with ``u > v``. Least neighbours are found by a
    combining aggregate and joined back, so a vertex with very many neighbours
    is neither gathered nor sorted in one group.
    """
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(
        edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
    )
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    larger = both.filter("other > node").join(least, "node")
    return larger.select(F.col("other").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def _smaller_ones(edges: DataFrame) -> DataFrame:
    """The other half: a vertex and its smaller neighbours link to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, run: RunFolder, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the least node.

    Alternating large-star and small-star contraction: the number of rounds grows
    with the logarithm of the longest path. Every round is a written table, so a
    lost executor costs that round only. Loops and repeated edges are harmless;
    nodes without an edge to another node are not listed.
    """
    pair = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = run.keep(edges.select(*pair).filter("u <> v").distinct(), f"{label}_0")
    state, turn = None, 0
    while True:
        turn += 1
        current = run.keep(_smaller_ones(_towards_least(current)), f"{label}_{turn}")
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
