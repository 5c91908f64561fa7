"""Conversation repair against exhaustive search, and block by block against whole."""

import hashlib
import random
import re
from binascii import crc32
from collections import defaultdict
from itertools import groupby

import pytest

from linkloom.llm.conversations import Facts, repair, repair_blocks, repair_damaged, repaired, marked

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int, `block` int"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
WRITTEN = {"u": "user", "a": "assistant"}


def exhaustive(turns, most=14):
    """Every edit of ``turns(initial, bound to go, truncated)`` up to a cost; the least (cost, audit, kept roles)."""
    best = None
    waiting = [(0, "", 0, "")]
    while waiting:
        cost, audit, i, roles = waiting.pop()
        if cost > most or (best and (cost > best[0])) or not re.match(r"s?(ua)*u?\Z", roles):
            continue
        if i == len(turns) and GRAMMAR.match(roles):
            best = min(best or (cost, audit, roles), (cost, audit, roles))
        for r in "ua":
            waiting.append((cost + 2, audit + "I", i, roles + r))
        if i < len(turns):
            initial, bound, cut = turns[i]
            waiting.append((cost + 3, audit + "D", i + 1, roles))
            if not bound:
                waiting.append((cost + cut, audit + "K", i + 1, roles + (initial or "?")))
                for r in "ua":
                    waiting.append((cost + 2 + cut, audit + "R", i + 1, roles + r))
    return best


def letters(turns):
    return "".join("d" if b else ((i if i in "sua" and i else "o").upper() if c else (i if i in "sua" and i else "o")) for i, b, c in turns)


def model(rows):
    """Results for rows ``(conv, turn, role, text)``, by definition and exhaustive search."""
    blank = " \t\n\x0b\x0c\r"
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = found[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}\x00{r[1]}\x00{r[2]}".encode()).digest()))
        known = [t for t, *_ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            fault = "blank" if not text.strip(blank) else "duplicate" if (role, text) in seen else None
            if fault is None and text.rstrip(blank)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, roles = exhaustive(turns, most=3 * len(turns) + 1)
        body, source, nth = [], iter(kept), 0
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(source)
            if edit != "D":
                body.append(f"{role if edit == 'K' else WRITTEN[roles[nth]]}:{text}")
                nth += 1
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest())
    return out


def test_cheapest_repair():
    draw = random.Random(1)
    for _ in range(250):
        turns = [(draw.choice(["s", "u", "u", "a", "a", "t", ""]), draw.random() < 0.15, draw.random() < 0.2) for _ in range(draw.randint(0, 5))]
        cost, audit, _ = exhaustive(turns, most=3 * len(turns) + 1)
        assert repair(letters(turns)) == (cost, audit), turns


def test_blocks_give_the_whole_repair():
    draw = random.Random(2)
    for _ in range(120):
        turns = "".join(draw.choices("suaUAod", k=draw.randint(0, 60)))
        cuts = sorted(draw.choices(range(len(turns) + 1), k=draw.randint(0, 6)))
        blocks = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        cost, chosen = repair_blocks(blocks)
        assert (cost, "".join(e for _, e in chosen)) == repair(turns)
        texts = [[("system" if t in "sS" else "user" if t in "uU" else "assistant" if t in "aA" else "other", str(i)) for i, t in enumerate(b) if t != "d"] for b in blocks]
        whole = list(repaired(marked(repair(turns)[1], turns), 0, [t for b in texts for t in b]))
        assert whole == [x for (state, e), b, t in zip(chosen, blocks, texts) for x in repaired(marked(e, b), state, t)]


def test_facts_add_up():
    draw = random.Random(3)
    for _ in range(100):
        turns = sorted(draw.choices(range(9), k=draw.randint(0, 12)))
        rows = [(None if draw.random() < 0.2 and not i else t, draw.choice("suat"), draw.randint(1, 3)) for i, t in enumerate(turns)]
        whole, parts = Facts(), [Facts(), Facts(), Facts()]
        at = sorted(draw.choices(range(len(rows) + 1), k=2))
        for i, row in enumerate(rows):
            whole.add(*row)
            parts[(i >= at[0]) + (i >= at[1])].add(*row)
        assert parts[0].join(parts[1]).join(parts[2]) == whole


@pytest.fixture(scope="module")
def odd_rows():
    draw = random.Random(4)
    texts = ["Yes.", "No!", "so", "", " \n", None, "Why? ", "trailing.\t", "\x1f", "é"]
    rows = []
    for conv in [*range(130), None]:
        for turn in draw.sample(range(12), draw.randint(1, 5)):
            rows.append((conv, draw.choice([turn, turn, turn, None]), draw.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "agent"]), draw.choice(texts)))
    rows += rows[:15]
    rows.append((5000, 1, "user", "word " * 50_000 + "."))
    rows += [(6000, None, None, None)]
    dropped = [c for c in range(7000, 7400) if crc32(f"{c}:3".encode()) % 20 == 0]
    return rows + [(c, 3, "user", "gone.") for c in dropped]


@pytest.mark.parametrize("block_turns", [1024, 2])
def test_odd_rows(spark, odd_rows, block_turns):
    rows = [(*r, "x", 1, 2) for r in odd_rows]
    got = repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(5), block_turns=block_turns)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in got.collect()]
    expected = model(odd_rows)
    assert len(got) == len(expected)
    assert {r[0]: r[1:] for r in got} == expected
    gone = [v for c, v in expected.items() if c and c >= 7000]
    assert gone and set(gone) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_over_many_partitions(spark):
    """A third of all rows are one conversation, another third one and the same turn."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(3000)]
    rows += [(2, 7, "user", "again.")] * 3000
    rows += [(i, 0, "user", "hello.") for i in range(10, 3010)]
    got = repair_damaged(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(7), block_turns=100)
    got = {r["conv_id"]: r for r in got.collect()}
    assert len(got) == 3002
    kinds = {i: crc32(f"1:{i}".encode()) % 20 for i in range(3000)}
    letter = []
    body = []
    for i in range(3000):
        role, text = rows[i][2], rows[i][3]
        kind = kinds[i]
        if kind == 0:
            continue
        text, role = "" if kind == 1 else text.replace(".", "") if kind == 2 else text, "user" if kind == 4 else role
        initial = role[0].upper() if kind == 2 else role[0]
        letter += ["d"] if kind == 1 else [initial, "d"] if kind == 3 else [initial]
        body += [] if kind == 1 else [(role, text)]
    cost, audit = repair("".join(letter))
    assert (got[1]["cost"], got[1]["audit"]) == (cost, audit)
    text = b"\n".join(repaired(marked(audit, "".join(letter)), 0, body))
    assert got[1]["repaired_sha256"] == hashlib.sha256(text).hexdigest()
    times = {0: 0, 3: 6000}.get(crc32(b"2:7") % 20, 3000)
    assert got[2]["duplicate"] + got[2]["blank"] == max(0, times - 1) and len(got[2]["audit"]) >= times


def test_no_conversations(spark):
    assert repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
