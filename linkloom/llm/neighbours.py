"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then dealt to one leaf
of each tree. A query walks all trees at once through one priority queue of
branches, nearest split first, until it has visited a number of leaves, and the
vectors in those leaves are ranked by exact inner products. How many leaves are
visited is measured: a few pilot queries are compared with all vectors, and the
least number that finds the wanted share of their neighbours is used. On data
without structure that is a large part of the leaves, whatever the index.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.storage import RunFolder

TREES, SAMPLE, PILOT = 4, 8192, 64
LEAST_LEAVES, MOST_LEAVES, LEAF_ROWS = 64, 1024, 8192
#: Rows of a leaf, and queries, that meet in one task; larger leaves are cut.
SLICE_ROWS, CHUNK_QUERIES = 16_384, 4096
NEIGHBOURS, RECALL, SEED = 20, 0.96, 5


@dataclass(frozen=True)
class Forest:
    """Perfect binary trees: node ``n`` has children ``2n`` and ``2n + 1``, leaves last."""

    planes: np.ndarray  # (trees, leaves, dim); node 0 unused
    cuts: np.ndarray  # (trees, leaves)

    @property
    def leaves(self) -> int:
        return self.planes.shape[1]

    @property
    def cells(self) -> int:
        return self.planes.shape[0] * self.leaves

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The cell, tree times leaves plus leaf, of every vector in every tree."""
        found = np.ones((len(vectors), len(self.planes)), dtype=np.int64)
        for t in range(len(self.planes)):
            node = found[:, t]
            while len(node) and node[0] < self.leaves:
                right = np.einsum("ij,ij->i", vectors, self.planes[t][node]) > self.cuts[t][node]
                node = node * 2 + right
            found[:, t] = node - self.leaves + t * self.leaves
        return found

    def visit(self, query: np.ndarray, most: int, sizes: list[int] | None = None, least: int = 0) -> list[int]:
        """Cells in the order in which the shared queue reaches them.

        ``most`` of them, and on until those of one tree hold ``least`` vectors by ``sizes``.
        """
        margins = self.planes @ query - self.cuts
        queue = [(0.0, t, 1) for t in range(len(self.planes))]
        cells: list[int] = []
        seen = [0] * len(self.planes)
        while queue and (len(cells) < most or max(seen) < least):
            far, t, node = heapq.heappop(queue)
            while node < self.leaves:
                m = margins[t, node]
                near, other = (2 * node + 1, 2 * node) if m > 0 else (2 * node, 2 * node + 1)
                heapq.heappush(queue, (max(far, abs(m)), t, other))
                node = near
            cells.append(node - self.leaves + t * self.leaves)
            seen[t] += sizes[cells[-1]] if sizes else 0
        return cells


def fit_forest(sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """Each node cuts its sample at the median of its projection on a random difference."""
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((trees, leaves, sample.shape[1])), np.zeros((trees, leaves))
    for t in range(trees):
        parts = {1: np.arange(len(sample))}
        for node in range(1, leaves):
            own = parts.pop(node)
            pool = own if len(own) > 1 else np.arange(len(sample))
            a, b = sample[rng.choice(pool, 2)] if len(pool) > 1 else (rng.normal(size=sample.shape[1]), 0)
            plane = np.asarray(a - b, dtype=float)
            norm = np.linalg.norm(plane)
            plane = plane / norm if norm else rng.normal(size=sample.shape[1])
            on = sample[own] @ plane
            cut = float(np.median(on)) if len(own) else 0.0
            planes[t, node], cuts[t, node] = plane, cut
            parts[2 * node], parts[2 * node + 1] = own[on <= cut], own[on > cut]
    return Forest(planes, cuts)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's ``k`` nearest."""
    rough = queries @ vectors.T
    k = min(k, rough.shape[1])
    at = np.argpartition(-rough, k - 1, axis=1)[:, :k] if k < rough.shape[1] else np.tile(np.arange(k), (len(queries), 1))
    q = np.repeat(np.arange(len(queries)), k)
    v = at.ravel()
    # Product by product, so that a pair's score does not depend on its company.
    return q, v, (queries[q] * vectors[v]).sum(axis=1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """``(vec_id, embedding)`` of vectors that take part, and their dimension.

    Null or zero vectors, and those with a null or non-finite component, do not;
    nor do those of another dimension than most have.
    """
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = named.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(finite & F.exists("embedding", lambda x: x != 0))
    dims = sound.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = dims["dim"] if dims else 1
    return sound.filter(F.size("embedding") == dim), dim


def _pilot_cells(reps: DataFrame, pilot: np.ndarray, forest: Forest, dim: int, k: int) -> list[list[list[int]]]:
    """For each pilot query, the cells of each of its true nearest vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch["embedding"], dim)
                q, v, score = _best(pilot, vectors, k)
                cells = forest.assign(vectors)[v]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(score), pa.array(cells.tolist(), pa.list_(pa.int64()))], names=["q", "score", "cells"]
                )

    found = reps.select("embedding").mapInArrow(run, "q long, score double, cells array<long>")
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    rows = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).collect()
    cells: list[list[list[int]]] = [[] for _ in pilot]
    for row in rows:  # at most PILOT times k rows
        cells[row["q"]].append(row["cells"])
    return cells


def measured_visits(reps: DataFrame, pilot: np.ndarray, forest: Forest, dim: int, k: int, recall: float) -> int:
    """The least number of leaves with which the pilot queries reach ``recall``."""
    if not len(pilot):
        return forest.cells
    reached = []
    for query, neighbours in zip(pilot, _pilot_cells(reps, pilot, forest, dim, k)):
        rank = {cell: n + 1 for n, cell in enumerate(forest.visit(query, forest.cells))}
        reached += [min(rank[c] for c in cells) for cells in neighbours]
    reached.sort()
    return reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query row.

    ``is_query`` is a condition on ``vec_id``. Equal vectors are searched once:
    the ``k + 1`` least IDs of each stand for it, which is all that a result can
    hold of them. An empty table gives an empty result.
    """
    run = RunFolder(vectors.sparkSession, "neighbours")
    sound, dim = usable(vectors, vec_id, embedding)
    reps = run.keep(
        sound.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.max(is_query(F.col("vec_id")).cast("int")).alias("asks")), "reps"
    )
    ids = run.keep(sound.select("vec_id", "embedding").distinct().join(reps, "embedding").select("rep", "vec_id"), "ids")
    by_hash = F.xxhash64(F.lit(SEED), "rep")
    sample = reps.orderBy(by_hash, "rep").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    total = reps.count()
    leaves = LEAST_LEAVES
    while leaves < MOST_LEAVES and leaves * LEAF_ROWS < total:
        leaves *= 2
    points = np.array(sample.tolist(), dtype=float).reshape(-1, dim)
    forest = fit_forest(points if len(points) else np.zeros((1, dim)), leaves)
    asked = reps.filter("asks = 1")
    pilot = asked.orderBy(by_hash, "rep").limit(PILOT).select("embedding").toPandas()["embedding"]
    visits = measured_visits(reps, np.array(pilot.tolist(), dtype=float).reshape(-1, dim), forest, dim, k + 1, recall)

    def cells_of(rows: DataFrame, name: str, sizes: list[int] | None = None) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _matrix(batch["embedding"], dim)
                found = [forest.visit(p, visits, sizes, min(k + 1, total)) for p in points] if sizes else forest.assign(points).tolist()
                yield pa.RecordBatch.from_arrays([batch["rep"], batch["embedding"], pa.array(found, pa.list_(pa.int64()))], names=["rep", "embedding", "cells"])

        dealt = rows.select("rep", "embedding").mapInArrow(deal, "rep long, embedding array<double>, cells array<long>")
        return run.keep(dealt, name)

    held, sizes = cells_of(reps, "held"), [0] * forest.cells
    for row in held.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # at most TREES * MOST_LEAVES rows
        sizes[row["cell"]] = row["count"]
    asking = cells_of(asked, "asking", sizes)

    def parts(rows: DataFrame, most: int) -> DataFrame:
        counted = rows.select(F.explode("cells").alias("cell")).groupBy("cell").count()
        return counted.select("cell", F.ceil(F.col("count") / most).cast("int").alias("parts"))

    # At most TREES * MOST_LEAVES rows: how many slices and chunks each cell has.
    plan = parts(held, SLICE_ROWS).withColumnRenamed("parts", "slices").join(
        parts(asking, CHUNK_QUERIES).withColumnRenamed("parts", "chunks"), "cell")
    plan = F.broadcast(run.keep(plan, "plan"))

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows by cell, in one part of their own side and in every part of the other."""
        each = rows.select("rep", "embedding", F.explode("cells").alias("cell")).join(plan, "cell")
        mine = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return each.select("rep", "embedding", "cell", mine.alias(own), every.alias(other))

    key = ["cell", "slices", "chunks"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("asker", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        vectors, reps_of = _matrix(left["embedding"].combine_chunks(), dim), left["rep"].to_numpy()
        askers = right["rep"].to_numpy()
        queries = _matrix(right["embedding"].combine_chunks(), dim)
        out = []
        for begin in range(0, len(queries), 512):
            q, v, score = _best(queries[begin : begin + 512], vectors, k + 1)
            out.append(pa.table([pa.array(askers[begin + q]), pa.array(reps_of[v]), pa.array(score)], schema=schema))
        return pa.concat_tables(out)

    pairs = spread(held, "slices", "chunks").groupBy(*key).cogroup(spread(asking, "chunks", "slices").groupBy(*key)).applyInArrow(
        rank, "asker long, rep long, score double"
    )
    # A vector found through several trees has one rank: its score is the same.
    best = F.dense_rank().over(Window.partitionBy("asker").orderBy(F.desc("score"), "rep"))
    near = pairs.withColumn("n", best).filter(F.col("n") <= k + 1).dropDuplicates(["asker", "n"]).select("asker", "rep", "score")
    order = Window.partitionBy("rep").orderBy("vec_id")
    first_ids = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("rep", "vec_id")
    asking_ids = ids.filter(is_query(F.col("vec_id"))).select(F.col("rep").alias("asker"), F.col("vec_id").alias("query_id"))
    # Per distinct query vector at most (k + 1)^2 rows before the final cut to k + 1.
    merged = near.join(first_ids, "rep").withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")))
    merged = merged.filter(F.col("n") <= k + 1).select("asker", "vec_id", "score")
    found = asking_ids.join(merged, "asker").filter("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose ID is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, lambda vec_id: vec_id % 20 == 0)
