"""Shortest-pack-first packing of tokenised documents over their length histogram.

Documents become token IDs and an end mark, and are cut at the capacity. How many
pieces there are of each length is all that the plan needs, at most one row per
length: lengths are placed longest first, each into the packs with most room, as
many equal packs at a time as there are, and new packs open where none has room.
A pattern is a way to fill a pack and the number of packs filled that way. The
pieces of each length are then numbered across the table, and a piece's number
leads to its pattern, its pack and its place there.
"""

import os
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.storage import RunFolder

CAPACITY = 2048
END_MARK = 1
#: Words whose IDs a task remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 48
#: Characters of a text that are split into words at once.
SLICE = 1 << 20
ROWS_OUT = 20_000

# Marks between a letter and a blank are a unit of their own, unless there is an apostrophe among them.
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-zß-öø-ÿ].)[!-&(-/:-@\[-`{-~]*+(?![^ \n])")


@dataclass(frozen=True)
class Pattern:
    """``packs`` packs filled alike, with ``(length, how many)`` in order."""

    packs: int
    parts: tuple[tuple[int, int], ...]

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.parts)


def shortest_pack_first(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold ``histogram[length]`` pieces of every length, none beyond the capacity.

    A length splits at most one pattern in two, so there are few patterns, however many pieces.
    """
    open_packs: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def leave(pattern: Pattern) -> None:
        room = capacity - pattern.used
        if not room:
            done.append(pattern)
        elif room in open_packs:
            open_packs[room].append(pattern)
        else:
            open_packs[room] = [pattern]
            insort(rooms, room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = capacity // length
                if left >= each:
                    leave(Pattern(left // each, ((length, each),)))
                if left % each:
                    leave(Pattern(1, ((length, left % each),)))
                break
            room = rooms[-1]
            pattern = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            n = min(left, pattern.packs)
            if n < pattern.packs:
                leave(Pattern(pattern.packs - n, pattern.parts))
            *before, last = pattern.parts
            more = (*before, (length, last[1] + 1)) if last[0] == length else (*pattern.parts, (length, 1))
            leave(Pattern(n, more))
            left -= n
    return done + [p for room in rooms for p in open_packs[room]]


class Tokens:
    """Token IDs of texts, as little-endian unsigned 32-bit integers.

    The vocabulary splits at blanks before anything else, so words are encoded
    alone and their IDs are remembered. Unknown words of letters go through it as
    one text; each is one unit, told apart by its last token.
    """

    def __init__(self, vocabulary: str | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        own = vocabulary is None
        if own:
            import public_tokenizers

            vocabulary = public_tokenizers.path("word_bpe_49k.json")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self._tokenizer = Tokenizer.from_file(vocabulary)
        # The same model for words that this vocabulary neither changes nor takes apart.
        self._plain = Tokenizer(self._tokenizer.model) if own else None
        if own:
            by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self._plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_bytes])
        tokens = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends_unit = np.zeros(max(tokens.values()) + 1, bool)
        self._ends_unit[[i for token, i in tokens.items() if token.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [words_of(text) for text in texts]
        found = [list(map(self._known.get, w)) for w in words]
        new = {w for ws, ids in zip(words, found) if None in ids for w, i in zip(ws, ids) if i is None}
        if len(self._known) + len(new) > REMEMBERED:
            self._known, new = {}, set().union(*words)
        if new:
            self._learn(list(new))
            found = [map(self._known.__getitem__, w) if None in ids else ids for w, ids in zip(words, found)]
        joined = [b"".join(ids) for ids in found]
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del self._known[w]
        return joined

    def _learn(self, words: list[str]) -> None:
        plain, letters, rest = [], [], []
        for w in words:
            if not w.isalpha():
                rest.append(w)
            elif self._plain is not None and max(w) <= "\xff" and w == w.lower():
                plain.append(w)
            else:
                letters.append(w)
        self._known.update(zip(plain, self._encode_letters(plain, self._plain)))
        self._known.update(zip(letters, self._encode_letters(letters)))
        self._known.update(zip(rest, self._encode(rest)))

    def _encode(self, texts: list[str], tokenizer=None) -> list[bytes]:
        encoded = (tokenizer or self._tokenizer).encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _encode_letters(self, words: list[str], tokenizer=None) -> list[bytes]:
        whole = self._encode([" ".join(words)], tokenizer)[0]
        ends = 4 * (np.flatnonzero(self._ends_unit[np.frombuffer(whole, "<u4")]) + 1)
        if len(ends) != len(words):
            return self._encode(words)
        return [whole[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def words_of(text: str) -> list[str]:
    """Parts of a text that the vocabulary takes apart anyway: words, and marks at the end of a word.

    Latin letters are lower-cased, as the vocabulary does, so that fewer words
    are different. A text that may hold one of its special tokens is left as it is.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            text = _MARKS.sub(" \\g<0>", text.lower())
    return text.replace("\n", " ").replace("\t", " ").split(" ")


@cache
def tokens_of(vocabulary: str | None) -> Tokens:
    """One per Python worker, so that its words are still known in the next task."""
    return Tokens(vocabulary)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at blanks."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def ids_in_order(texts: Iterable[str], tokens: Tokens, size: int = SLICE) -> Iterator[tuple[int, bytes]]:
    """``(place, IDs)`` of texts in order; short texts go together, a long one comes in several parts."""
    held: list[tuple[int, str]] = []
    length = 0
    for i, text in enumerate(texts):
        for part in slices(text, size):
            held.append((i, part))
            length += len(part)
            if length >= size:
                yield from zip([j for j, _ in held], tokens([t for _, t in held]))
                held, length = [], 0
    yield from zip([j for j, _ in held], tokens([t for _, t in held]))


def cut_documents(texts: Iterable[str], tokens: Tokens, capacity: int, end_mark: int) -> Iterator[list[tuple[int, int, int]]]:
    """``(start, length, crc32)`` of each document's pieces: whole capacities, then what is left."""
    whole, end = 4 * capacity, np.array([end_mark], "<u4").tobytes()
    texts = list(texts)
    parts = groupby(ids_in_order(texts, tokens), key=lambda x: x[0])
    following = next(parts, None)
    for i in range(len(texts)):
        pieces: list[tuple[int, int, int]] = []
        held = b""
        if following is not None and following[0] == i:
            for _, ids in following[1]:
                held += ids
                full = len(held) // whole * whole
                for at in range(0, full, whole):
                    pieces.append((len(pieces) * capacity, capacity, crc32(held[at:at + whole])))
                held = held[full:]
            following = next(parts, None)
        held += end
        pieces.append((len(pieces) * capacity, len(held) // 4, crc32(held)))
        yield pieces


def cut_pieces(docs: DataFrame, capacity: int, vocabulary: str | None, end_mark: int) -> DataFrame:
    """Pieces of ``docs(doc, text)`` with the block that made them and their number among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, numbers, block = tokens_of(vocabulary), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            places: list[int] = []
            rows: list[tuple[int, ...]] = []

            def out() -> pa.RecordBatch:
                of_piece = np.array(rows, np.int64).reshape(-1, 5)
                columns = [batch["doc"].take(pa.array(places, pa.int64())), *(pa.array(of_piece[:, c]) for c in range(5))]
                columns.append(pa.array(np.full(len(rows), block, np.int64)))
                return pa.RecordBatch.from_arrays(columns, names=names)

            texts = (text.as_py() or "" for text in batch["text"])
            for i, pieces in enumerate(cut_documents(texts, tokens, capacity, end_mark)):
                doc_tokens = sum(length for _, length, _ in pieces)
                for start, length, crc in pieces:
                    places.append(i)
                    rows.append((start, length, crc, doc_tokens, numbers[length]))
                    numbers[length] += 1
                if len(rows) >= ROWS_OUT:
                    yield out()
                    places, rows = [], []
            if rows:
                yield out()

    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "number", "block"]
    kind = docs.schema["doc"].dataType.simpleString()
    numbers = ", ".join(f"{n} long" for n in names[1:])
    return docs.select("doc", "text").mapInArrow(run, f"doc {kind}, {numbers}")


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows ``(length, rank, each, sequence, offset)`` by length and rank.

    From ``rank`` on, ``each`` pieces of the length lie side by side from ``offset``
    in ``sequence``, the next ones in the next sequence, and so on.
    """
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for length, each in pattern.parts:
            rows.append((length, rank[length], each, sequence, offset))
            rank[length] += each * pattern.packs
            offset += each * length
        sequence += pattern.packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """``pieces`` with ``length`` and ``rank``, and the sequence and the place that their rank leads to.

    The slots grow with the lengths there are, not with the pieces: a pattern
    has at most 63 different lengths, as these add up to 2,048 at most.
    """
    table = slots(patterns)
    first = np.searchsorted(table[:, 0], np.arange(table[:, 0].max() + 2)) if len(table) else np.zeros(2, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                own = table[first[n]:first[n + 1]]
                slot = own[np.searchsorted(own[:, 1], rank[here], side="right") - 1]
                nth = rank[here] - slot[:, 1]
                sequence[here] = slot[:, 3] + nth // slot[:, 2]
                offset[here] = slot[:, 4] + nth % slot[:, 2] * n
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    kept = [f for f in pieces.schema.fields if f.name != "rank"]
    names = [f.name for f in kept] + ["sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pieces.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_by_histogram(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", capacity: int = CAPACITY,
    vocabulary: str | None = None, end_mark: int = END_MARK,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece of every document.

    Null texts count as empty; an empty text is its end mark. Repeated and null IDs
    are documents of their own, and which of several equal lengths goes where is left
    to the order of the table's files. An empty table has no rows.
    """
    run = RunFolder(docs.sparkSession, "histogram_packing")
    named = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = run.keep(cut_pieces(named, capacity, vocabulary, end_mark), "pieces")
    sizes = run.keep(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "block"]).select(
        F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("number")).alias("rank")
    )
    return place(ranked, shortest_pack_first(histogram, capacity))


def op12_shortest_pack_first(spark, sf_dir: str) -> DataFrame:
    """The sequence and the place of every piece of every document."""
    return pack_by_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
