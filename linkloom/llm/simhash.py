"""SimHash near-duplicates, found with BK-trees.

Fingerprints are made in one pass over the texts. Equal ones are joined first, by
a combining aggregate, so that copies, however many, are one fingerprint from
there on. Distinct fingerprints are dealt into shards such that any two within
the radius meet in some shard; each shard builds a BK-tree whose children hang on
the integer Hamming distance to their parent, and searches it along the edges
within the radius only. Links are joined to components.

Shards, not the whole corpus, get a tree: a tree sent to every task would grow
with the corpus, and nothing outside a shard has to be compared with it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import text_key
from linkloom.llm.components import connected_components
from linkloom.operators.storage import RunFolder

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that share a routing key; more are dealt on by further bits.
CROWD = 4096
#: Rows of (query, node) that a search holds at once.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        parts = zip(*(words[k:] for k in range(shingle)))
        hashes = [digest(b" ".join(p), SEED) for p in parts]
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = np.array(hashes[start : start + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str, keys: dict[str, Column], shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``print``, the fingerprint as a signed long, for every row."""
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.col(f"`{text}`").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), shingle) for t in batch["_text"]]
            prints = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, prints], names=[*batch.schema.names[:-1], "print"])

    return rows.mapInArrow(run, f"{schema}, `print` long")


class BKForest:
    """BK-trees over codes, one per group, as arrays that are searched many at a time.

    ``nodes`` are in order of depth. The children of a node lie side by side,
    sorted by their distance to it: that distance is the edge to the child.
    """

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes, self.groups = codes, groups
        order = np.argsort(groups, kind="stable")
        # Items still to be placed, with the node they hang below and their edge.
        parent = np.full(len(codes), -1, dtype=np.int64)
        edge = np.zeros(len(codes), dtype=np.int64)
        self.first, self.last = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        self.kids: np.ndarray = np.zeros(0, dtype=np.int64)
        self.edges: np.ndarray = np.zeros(0, dtype=np.int64)
        kids, edges, placed = [], [], 0
        left, key = order, groups[order]
        at_root = True
        while len(left):
            head = np.ones(len(left), dtype=bool)
            if at_root:
                head[1:] = key[1:] != key[:-1]
            else:
                head[1:] = (parent[left][1:] != parent[left][:-1]) | (edge[left][1:] != edge[left][:-1])
            nodes = left[head]
            if at_root:
                self.roots = nodes
            else:
                above = parent[nodes]
                start = np.ones(len(nodes), dtype=bool)
                start[1:] = above[1:] != above[:-1]
                begin = np.flatnonzero(start)
                self.first[above[begin]] = placed + begin
                self.last[above[begin]] = placed + np.append(begin[1:], len(nodes))
                kids.append(nodes)
                edges.append(edge[nodes])
                placed += len(nodes)
            owner = nodes[np.cumsum(head) - 1][~head]
            left = left[~head]
            parent[left] = owner
            edge[left] = np.bitwise_count(codes[left] ^ codes[owner])
            by = np.lexsort((left, edge[left], owner))
            left, key, at_root = left[by], None, False
        if kids:
            self.kids, self.edges = np.concatenate(kids), np.concatenate(edges)
        self.root_of = dict(zip(groups[self.roots].tolist(), self.roots.tolist())) if len(codes) else {}

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, node) within the radius, following edges d-r to d+r."""
        found_q, found_n = [], []
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            far = np.bitwise_count(queries[q] ^ self.codes[node]).astype(np.int64)
            hit = far <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            count = self.last[node] - self.first[node]
            q, far, start = (np.repeat(x, count) for x in (q, far, self.first[node]))
            if not len(q):
                continue
            base = np.repeat(np.cumsum(count) - count, count)
            slot = start + np.arange(len(q)) - base
            near = np.abs(self.edges[slot] - far) <= radius
            if near.any():
                stack.append((q[near], self.kids[slot[near]]))
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(found_q) if found_q else none, np.concatenate(found_n) if found_n else none)


def forest_links(codes: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within groups as a spanning forest, and each code's number of neighbours.

    Codes of a group must differ. Returned as positions ``(member, root)``.
    """
    forest = BKForest(codes, groups)
    root = np.arange(len(codes))
    degree = np.zeros(len(codes), dtype=np.int64)
    starts = np.array([forest.root_of[g] for g in groups.tolist()], dtype=np.int64)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for begin in range(0, len(codes), 4096):
        block = slice(begin, begin + 4096)
        q, node = forest.search(codes[block], starts[block], radius)
        q += begin
        degree += np.bincount(q, minlength=len(codes)) if len(q) else 0
        for a, b in zip(q[q < node].tolist(), node[q < node].tolist()):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    member = np.flatnonzero(degree > 1)
    return member, np.array([top(x) for x in member.tolist()], dtype=np.int64), degree - 1


# Two codes with at most r differing bits agree on one of r + 1 blocks. A key is
# the list of blocks agreed on so far: (mask of those bits, their values).
def _blocks(mask: int, parts: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    cut = np.array_split(np.array(free), parts)
    return [mask | sum(1 << int(b) for b in c) for c in cut if len(c)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _route(rows: DataFrame, parts_of: dict[int, list[int]]) -> DataFrame:
    """Deal each row of ``rows(print, mask)`` to the blocks below its mask."""
    below = F  # one flat CASE over the masks
    for mask, parts in parts_of.items():
        below = below.when(F.col("mask") == _signed(mask), F.array(*(F.lit(_signed(p)) for p in parts)))
    dealt = rows.select("print", F.explode(below).alias("mask"))
    return dealt.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))


def shards(prints: DataFrame, run: RunFolder, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """``(print, mask, value)``: rows with one ``(mask, value)`` meet in a shard.

    ``prints`` holds distinct fingerprints. A key that more than ``crowd`` of them
    share is dealt on by the blocks of its remaining bits; that ends by itself,
    as 64 bits leave fewer than ``crowd`` fingerprints after a few turns. No key
    is cut off, and every pair within the radius meets at every level.
    """
    open_rows, done, level, masks = prints.select("print", F.lit(0).cast("bigint").alias("mask")), None, 0, [0]
    while True:
        parts_of = {m: _blocks(m, radius + 1) for m in masks}
        dealt = run.keep(_route(open_rows, parts_of), f"dealt_{level}")
        crowded = dealt.groupBy("mask", "value").count().filter(F.col("count") > crowd).select("mask", "value")
        crowded = run.keep(crowded, f"crowded_{level}")
        masks = sorted({p for parts in parts_of.values() for p in parts})
        free = 64 - min(bin(m).count("1") for m in masks)
        if crowded.isEmpty() or 2**free <= crowd:
            return dealt if done is None else done.union(dealt)
        settled = dealt.join(crowded, ["mask", "value"], "left_anti")
        done = settled if done is None else done.union(settled)
        open_rows = dealt.join(crowded, ["mask", "value"], "left_semi").select("print", "mask")
        level += 1


def near_links(prints: DataFrame, run: RunFolder, radius: int = RADIUS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints, a spanning forest per shard."""
    routed = shards(prints, run, radius)
    keyed = routed.select("print", F.xxhash64("mask", "value").alias("shard"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by shard; a batch's last shard may run on in the next.
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(codes: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
            member, root, _ = forest_links(codes.view(np.uint64), shard, radius)
            ours = member != root
            return pa.RecordBatch.from_arrays(
                [pa.array(codes[member[ours]]), pa.array(codes[root[ours]])], names=["u", "v"]
            )

        for batch in batches:
            codes, shard = (batch[n].to_numpy(zero_copy_only=False) for n in ("print", "shard"))
            if not len(shard):
                continue
            held.append((codes, shard))
            if shard[0] == shard[-1] and held[0][1][0] == shard[-1]:
                continue
            codes, shard = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(shard, shard[-1]))
            yield links(codes[:cut], shard[:cut])
            held = [(codes[cut:], shard[cut:])]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    spread = keyed.repartition("shard").sortWithinPartitions("shard", "print")
    return spread.mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, text: str, keys: dict[str, Column], doc: str, run: RunFolder, radius: int = RADIUS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and the component of every fingerprint.

    The first table is ``keys`` and ``print`` for each row; the second
    ``(print, component, copies)`` with the least ``doc`` of the component, which
    is null only where all its documents' are.
    """
    prints = run.keep(fingerprints(docs, text, keys, shingle), "prints")
    distinct = run.keep(prints.groupBy("print").agg(F.min(doc).alias("least"), F.count("*").alias("copies")), "distinct")
    joined = connected_components(near_links(distinct, run, radius), run)
    rooted = distinct.join(joined, F.col("print") == F.col("node"), "left").select(
        "print", "least", "copies", F.coalesce("root", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return prints, run.keep(rooted.join(least, "root").select("print", "component", "copies"), "classes")


def keep_one_per_group(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of fingerprints within the radius: that of the least ``doc``.

    Null texts count as empty ones and form one group with them. Of rows that share
    the least ``doc``, the one with the least text key stays; of wholly repeated
    rows one stays. A group without any ``doc`` keeps one row as well.
    """
    run = RunFolder(docs.sparkSession, "simhash")
    keys = {"doc": F.col(f"`{doc}`"), "key": text_key(F.col(f"`{text}`"))}
    prints, classes = near_duplicates(docs, text, keys, "doc", run, radius, shingle)
    member = prints.join(classes.select("print", "component"), "print")
    # Components are told apart by their least document; those without one by print.
    group = F.struct("component", F.when(F.col("component").isNull(), F.col("print")).alias("print"))
    order = F.struct(F.col("doc").isNull(), "doc", "key")
    best = member.groupBy(group.alias("group")).agg(F.min(order).alias("best"))
    chosen = run.keep(best.select("best.doc", "best.key").distinct(), "chosen")
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *(c.alias(k) for k, c in keys.items()))
    stays = row.join(chosen.select(F.col("doc").alias("d"), F.col("key").alias("k")),
                     F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    return stays.dropDuplicates(["doc", "key"]).select(*(F.col("row").getField(c).alias(c) for c in names))


def op1_simhash_near_dup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    run = RunFolder(spark, "simhash")
    prints, classes = near_duplicates(docs, "text", {"doc_id": F.col("doc_id")}, "doc_id", run)
    return prints.join(classes, "print").select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
