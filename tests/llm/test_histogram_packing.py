"""Shortest-pack-first packing against whole encodings and one-by-one placement."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm.histogram_packing import (
    Tokens, cut_documents, ids_in_order, pack_by_histogram, shortest_pack_first, slices, slots, tokens_of, words_of,
)

SCHEMA = "doc_id long, text string, length string, `rank` int, block int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Used room of the packs when each piece, longest first, goes to the emptiest pack that holds it."""
    packs = []
    for length in sorted(lengths, reverse=True):
        room = [capacity - used for used in packs]
        best = max(range(len(packs)), key=room.__getitem__, default=None)
        if best is None or room[best] < length:
            packs.append(length)
        else:
            packs[best] += length
    return sorted(packs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_patterns_are_those_of_single_placement(lengths, capacity):
    histogram = Counter(lengths)
    patterns = shortest_pack_first(histogram, capacity)
    held = Counter()
    for p in patterns:
        for length, n in p.parts:
            held[length] += n * p.packs
    assert held == histogram
    assert sorted(p.used for p in patterns for _ in range(p.packs)) == one_by_one(lengths, capacity)


def test_many_equal_pieces_need_few_patterns():
    histogram = {n: 10**9 + n for n in (2048, 1500, 700, 512, 100, 3, 1)}
    patterns = shortest_pack_first(histogram)
    assert len(patterns) < 60 and len(slots(patterns)) < 200
    assert sum(p.used * p.packs for p in patterns) == sum(n * k for n, k in histogram.items())


TEXTS = [
    "", " ", "a", "Don't we'll 'S it's", "ÉLAN élan, İstanbul Straße ΣΑΣ ς", "ét e ́ x", "a\x1cb a\x85b a b c\x0bd",
    "<|endoftext|> a<|startoftext|>b <|endoftext|>", "123 4a5 x²y Ⅷ", "...!? \"ok.\" (no), yes.; a. b, .", "漢字かな 가 한글",
    "tab\there\nline\r\nend", "word. word, Word! word? word: word;", ",", "a" * 200, "x" * 60 + ".", "\x00\x01 a\x00b", "🙂 a🙂b.",
]


def test_ids_are_those_of_whole_texts(tokenizer):
    draw = random.Random(2)
    pieces = [w for t in TEXTS for w in t.split(" ")] + ["La", "la", "pa."]
    texts = TEXTS + ["".join(draw.choice(pieces) + draw.choice([" ", "\n", "", "  "]) for _ in range(40)) for _ in range(150)]
    expected = [whole(tokenizer, t) for t in texts]
    for tokens in (Tokens(), Tokens()):
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in tokens(texts)] == expected
        for size in (1, 7, 100):
            got = defaultdict(bytes)
            for i, ids in ids_in_order(texts, tokens, size):
                got[i] += ids
            assert [np.frombuffer(got[i], "<u4").tolist() for i in range(len(texts))] == expected


def test_marks_after_words_are_units_of_their_own(tokenizer):
    assert words_of("Pour*** été$$$\nthe.") == ["pour", "***", "été", "$$$", "the", "."]
    assert words_of("it's. a'. b.'s c*d") == ["it's", ".", "a'.", "b.'s", "c*d"]
    draw, tokens = random.Random(5), Tokens()
    ends = [*"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~", "***", ".'s", "'s", "'.", "é", "ª", "µ", "4", "\x85", " ", "\t", "\n", ""]
    for _ in range(200):
        text = "".join(draw.choice(["the", "Été", "à", "ÿx", "ß"]) + draw.choice(ends) + draw.choice(ends) + draw.choice(ends) for _ in range(20))
        assert np.frombuffer(tokens([text])[0], "<u4").tolist() == whole(tokenizer, text)


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr("linkloom.llm.histogram_packing.REMEMBERED", 5)
    tokens = Tokens()
    for text in TEXTS * 2:
        assert np.frombuffer(tokens([text])[0], "<u4").tolist() == whole(tokenizer, text)


def test_slices_lose_nothing():
    text = "ab  cd e" * 50
    assert "".join(slices(text, 3)) == text and list(slices("", 3)) == []


def test_documents_are_cut_at_the_capacity():
    tokens = tokens_of(None)
    got = list(cut_documents(["a " * 7, "", "b b b"], tokens, 4, 1))
    assert [[(s, n) for s, n, _ in d] for d in got] == [[(0, 4), (4, 4)], [(0, 1)], [(0, 4)]]


def check(rows, docs, tokenizer, capacity):
    """Every ID in one piece, sequences without holes or overlaps, checksums of the ids."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    expected, got = Counter(), Counter()
    for doc, text in docs:
        ids = np.array(whole(tokenizer, text or "") + [1], "<u4")
        for at in range(0, len(ids), capacity):
            part = ids[at:at + capacity]
            expected[doc, len(ids), at, len(part), crc32(part.tobytes())] += 1
    for (doc, n), held in pieces.items():
        got.update((doc, n, *p) for p in held)
    assert got == expected
    return [sum(n for _, n in held) for held in sequences.values()]


def test_odd_rows(spark, tokenizer):
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choices(["la", "pa.", "Éenai", "x1"], k=draw.randint(0, 60)))) for i in range(300)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, "lost"), (None, None), (400, ""), (401, None), (402, "lang " * 3000)]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], SCHEMA).repartition(6)
    packed = pack_by_histogram(df, capacity=64)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    used = check(packed.collect(), docs, tokenizer, 64)
    lengths = [min(64, n - at) for _, t in docs for n in [len(whole(tokenizer, t or "")) + 1] for at in range(0, n, 64)]
    assert sorted(used) == one_by_one(lengths, 64)


def test_no_documents(spark):
    assert pack_by_histogram(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents_leave_little_padding(spark, tokenizer):
    from linkloom.llm.histogram_packing import op12_shortest_pack_first

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    used = check(op12_shortest_pack_first(spark, folder).collect(), docs, tokenizer, 2048)
    padding = sum(2048 - n for n in used if n & (n - 1))
    assert padding <= 0.02 * sum(used)
