"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Documents longer than
the longest are cut into pieces. Pieces are placed longest first into the open
bin, of whatever length, that they leave the least room in; if none fits, a bin of
the length that costs least per token opens. At the end every bin shrinks to the
cheapest length that holds its contents.

Pieces are dealt evenly into blocks of bounded size, and a block is packed by one
task. A block ends with a few bins that are not full, so larger blocks waste less;
at the default size that is below a thousandth.
"""

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import word_list
from linkloom.operators.storage import RunFolder

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin: its tokens, its attention (quadratic, equal to the tokens at this
#: length), and a fixed part.
ATTENTION_AT, FIXED_COST = 16_384, 64
BLOCK_PIECES = 50_000


def bin_costs(lengths: Sequence[int], fixed: int = FIXED_COST) -> dict[int, float]:
    return {n: n + n * n / ATTENTION_AT + fixed for n in sorted(lengths)}


def best_fit(pieces: Sequence[int], costs: dict[int, float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the length of each bin.

    Open bins lie in stacks by the room that is left; a bit per stack finds the
    least sufficient room in one step. Pieces must fit the longest length.
    """
    longest = max(costs)
    opened = {n: min((c / length, -length, length) for length, c in costs.items() if length >= n)[2] for n in set(pieces)}
    stacks: list[list[int]] = [[] for _ in range(longest + 1)]
    open_rooms = 0
    used: list[int] = []
    bins, offsets = [0] * len(pieces), [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i], i)):
        n = pieces[i]
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            b, room = len(used), opened[n]
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            if not stacks[room - n]:
                open_rooms |= 1 << (room - n)
            stacks[room - n].append(b)
    ordered = sorted(costs.items(), key=lambda x: (x[1], x[0]))
    lengths = [next(length for length, _ in ordered if length >= u) for u in used]
    return bins, offsets, lengths


def cut(tokens: Column, longest: int) -> Column:
    """``(start, tokens)`` of the pieces of a document; none without tokens."""
    starts = F.sequence(F.lit(0).cast("long"), tokens - 1, F.lit(longest).cast("long"))
    return F.when(tokens > 0, F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.least(tokens - s, F.lit(longest).cast("long")).alias("tokens"))))


def pack(items: DataFrame, lengths: Sequence[int] = LENGTHS, fixed: int = FIXED_COST, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``(doc, piece_start, tokens, block, bin, bin_length, bin_offset)`` for every piece of ``items(doc, tokens)``.

    ``(block, bin)`` names a sequence, ``bin_offset`` the place in it. Items
    without tokens have no piece. Repeated and null ``doc`` are items of their own;
    ``items`` should be a stored table, whose row places deal the pieces evenly
    however many of them agree.
    """
    costs = bin_costs(lengths, fixed)
    pieces = items.select(
        "doc", F.monotonically_increasing_id().alias("place"), F.explode(cut(F.col("tokens").cast("long"), max(costs))).alias("piece")
    )
    total = items.agg(F.sum(F.ceil(F.col("tokens") / max(costs)))).first()[0] or 0
    blocks = max(1, -(-total // block_pieces))
    dealt = pieces.select(
        F.pmod(F.xxhash64("place", "piece.start"), F.lit(blocks)).cast("int").alias("block"),
        "doc", "piece.start", "piece.tokens", "place",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by block; one block is held at a time.
        def packed(block: pa.Table) -> pa.RecordBatch:
            bins, offsets, size = best_fit(block["tokens"].to_pylist(), costs)
            columns = [block["doc"], block["start"], block["tokens"], block["block"], pa.array(bins, pa.int64()),
                       pa.array([size[b] for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
            table = pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)
            return table.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            block = batch["block"].to_pylist()
            while at < len(block):
                end = at + 1
                while end < len(block) and block[end] == block[at]:
                    end += 1
                if held and held[0]["block"][0].as_py() != block[at]:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from packed(pa.Table.from_batches(held))

    names = ["doc", "piece_start", "tokens", "block", "bin", "bin_length", "bin_offset"]
    kind = items.schema["doc"].dataType.simpleString()
    placed = dealt.repartition("block").sortWithinPartitions("block", F.desc("tokens"), "doc", "start", "place")
    return placed.mapInArrow(run, f"doc {kind}, piece_start long, tokens long, block int, bin long, bin_length long, bin_offset long")


def document_items(docs: DataFrame) -> DataFrame:
    """``(doc, tokens)``; tokens are words."""
    return docs.select(F.col("doc_id").alias("doc"), F.size(word_list(F.col("text"))).cast("long").alias("tokens"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Where every piece of every document lies: sequence, its length, place in it, words of the document."""
    run = RunFolder(docs.sparkSession, "packing")
    placed = pack(run.keep(document_items(docs), "items"))
    return placed.withColumnRenamed("doc", "doc_id")


def sequences(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """``(block, bin, bin_length, text)``: the words of each sequence in order, joined by blanks.

    Documents must have distinct IDs; texts move once, cut to their pieces.
    """
    words = docs.select("doc_id", word_list(F.col("text")).alias("words"))
    piece = F.array_join(F.slice("words", F.col("piece_start").cast("int") + 1, F.col("tokens").cast("int")), " ")
    cut_out = placed.join(words, "doc_id").select("block", "bin", "bin_length", F.struct("bin_offset", piece.alias("text")).alias("piece"))
    gathered = cut_out.groupBy("block", "bin", "bin_length").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return gathered.select("block", "bin", "bin_length", F.array_join("pieces.text", " ").alias("text"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
