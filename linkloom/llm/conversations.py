"""Conversation repair by generalised LR parsing of the turns' roles.

A well-formed conversation is empty, or an optional system turn followed by pairs of a
user's and an assistant's turn. Its grammar has eight LR states. A damaged
conversation is parsed with edits: a turn is kept, gets another role or is
deleted, and missing turns are inserted, each at a cost. All ways go through one
graph-structured stack; where two of them end in the same state they go on alike, so
only the one of least (cost, audit) stays. Equal costs over the same turns
never have one audit begin with the other, so the order of two ways cannot change later.

Turns are sorted across the cluster by conversation and turn, so that a conversation of any
length is spread over partitions, and parsed in blocks. A block that is a whole
conversation is finished where it lies. The others are parsed from every state they
can start in, which needs no texts; the cheapest way through a conversation's
blocks is then chosen block by block, and texts are hashed in order, a block at a time.
"""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import BLANKS, columns_as
from linkloom.operators.storage import RunFolder

#: Costs of edits; a truncated turn that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns in a block.
BLOCK_TURNS = 1024
#: Bytes of text at which a block ends, and turns of a conversation whose repair is remembered.
BLOCK_BYTES, SHORT_TURNS, ROWS_OUT = 4 << 20, 24, 2_000
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

# LR table of: C -> empty | P | s P;  P -> u a | P u a. States 5 and 7 are reduced at once:
# the rule leaves the stack shorter by its length, and P leads on from the state below.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}
AFTER_PAIRS = {0: 3, 1: 4}
ACCEPTING = (0, 3, 4)
#: The role's initial before each state between two turns, and a stack that leads there.
STATE_ROLE = {0: "", 1: "s", 2: "u", 3: "a", 4: "a", 6: "u"}
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 1, 4), 6: (0, 3, 6)}

# A turn as one letter: its role's initial (s, u, a, or o for another), in upper case if it is
# truncated; d if it has to be deleted.
DELETED = "d"


@dataclass(frozen=True, slots=True)
class Node:
    """Top of a stack: its state, what lies below, and the least way that led here."""

    state: int
    below: "Node | None"
    cost: int
    audit: str


def shift(top: Node, symbol: str, cost: int, edit: str) -> Node | None:
    """The stack after a turn of role ``symbol``, reduced; None where the grammar has no such turn."""
    state = SHIFT.get((top.state, symbol))
    if state is None:
        return None
    cost, audit = top.cost + cost, top.audit + edit
    if state not in REDUCE:
        return Node(state, top, cost, audit)
    # The turn itself is one symbol of the rule and is not on the stack yet.
    base = top
    for _ in range(REDUCE[state] - 1):
        base = base.below
    return Node(AFTER_PAIRS[base.state], base, cost, audit)


def merge(tops: dict[int, Node], node: Node | None) -> bool:
    """Keep the least of two stacks with equal tops; whether ``node`` is it."""
    if node is None:
        return False
    held = tops.get(node.state)
    if held is not None and (held.cost, held.audit) <= (node.cost, node.audit):
        return False
    tops[node.state] = node
    return True


def insertions(tops: dict[int, Node]) -> dict[int, Node]:
    """The stacks after any number of inserted turns, cheapest first."""
    waiting = sorted(tops.values(), key=lambda n: (n.cost, n.audit))
    while waiting:
        top = waiting.pop(0)
        if tops[top.state] is not top:
            continue
        for symbol in ROLES:
            node = shift(top, symbol, INSERT, "I")
            if merge(tops, node):
                waiting.append(node)
        waiting.sort(key=lambda n: (n.cost, n.audit))
    return tops


def step(tops: dict[int, Node], turn: str) -> dict[int, Node]:
    """The stacks after a turn and its edits, before insertions."""
    after: dict[int, Node] = {}
    stays = turn != DELETED
    extra = TRUNCATED if turn.isupper() else 0
    for top in tops.values():
        merge(after, Node(top.state, top.below, top.cost + DELETE, top.audit + "D"))
        if stays:
            merge(after, shift(top, turn.lower(), extra, "K"))
            for symbol in ROLES:
                merge(after, shift(top, symbol, REROLE + extra, "R"))
    return after


def ways(turns: str, start: int) -> dict[int, tuple[int, str]]:
    """``(cost, audit)`` of the least way from state ``start`` to each state that ``turns`` can end in."""
    node = None
    for state in STACKS[start]:
        node = Node(state, node, 0, "")
    tops = insertions({start: node})
    for turn in turns:
        tops = insertions(step(tops, turn))
    return {state: (top.cost, top.audit) for state, top in tops.items()}


def repair(turns: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation."""
    return _repair_short(turns) if len(turns) <= SHORT_TURNS else _least(ways(turns, 0))[1]


def _least(found: dict[int, tuple[int, str]]) -> tuple[int, tuple[int, str]]:
    way, state = min((found[state], state) for state in ACCEPTING if state in found)
    return state, way


@lru_cache(maxsize=50_000)
def _repair_short(turns: str) -> tuple[int, str]:
    return _least(ways(turns, 0))[1]


def repair_blocks(blocks: list[str]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest repair of the blocks' turns in a row, and the state before and the edits of each block."""
    found: dict[int, tuple[int, str]] = {0: (0, "")}
    links: list[dict[int, tuple[int, str]]] = []
    for turns in blocks:
        after: dict[int, tuple[int, str]] = {}
        link: dict[int, tuple[int, str]] = {}
        for start, (cost, audit) in found.items():
            for state, (more, edits) in ways(turns, start).items():
                held = after.get(state)
                if held is None or cost + more < held[0] or (cost + more == held[0] and audit + edits < held[1]):
                    after[state], link[state] = (cost + more, audit + edits), (start, edits)
        found = after
        links.append(link)
    state, (cost, _) = _least(found)
    chosen = []
    for link in reversed(links):
        chosen.append(link[state])
        state = link[state][0]
    return cost, chosen[::-1]


def repaired(edits: str, before: int, turns: Iterable[tuple[str, str]]) -> Iterator[bytes]:
    """``role:text`` of each turn that the edits leave, from the state before them; ``turns`` are those not bound to go."""
    last, turns = STATE_ROLE[before], iter(turns)
    for edit in edits:
        if edit == "d":
            continue
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if last == "u" else "u"]
        last = role[:1]
        yield f"{role}:{text}".encode()


def marked(edits: str, turns: str) -> str:
    """The edits with those of turns that are bound to go in lower case, as their texts are not kept."""
    letter = iter(turns)
    return "".join("d" if e != "I" and next(letter) == DELETED else e for e in edits)


@dataclass(slots=True)
class Facts:
    """What is counted in a row of turns, so that it can be added to what comes before."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    numbers: int = 0

    def add(self, turn: int | None, initial: str, times: int) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += times - 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.numbers += 1

    def join(self, other: "Facts") -> "Facts":
        if other.first is None:
            return self
        if self.first is None:
            return other
        known = [f for f in (self, other) if f.low is not None]
        return Facts(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in LEGAL), self.first, other.last,
            known[0].low if known else None, known[-1].high if known else None,
            self.numbers + other.numbers - (len(known) == 2 and self.high == other.low),
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.numbers


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, times)``: the rows after damage; ``times`` is 0 for a dropped one, 2 for a repeated one."""
    blank = F.lit(" ")
    conv, turn = F.col("conv"), F.col("turn")
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), blank), F.coalesce(turn.cast("string"), blank))
    kind = F.crc32(key) % 20
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    return conversations.select(
        "conv", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns without their texts, equal ones counted, and the first occurrence of every role and text."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    keyed = rows.select(
        "conv", "turn", "role", "text", "times",
        F.unhex(F.md5(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"))).alias("content"),
        initial.alias("initial"),
        F.when(last == "", "b").when(last.isin(".", "!", "?"), "w").otherwise("t").alias("state"),
    )
    counted = keyed.groupBy("conv", "turn", "initial", "state", "content").agg(F.sum("times").alias("times"))
    firsts = keyed.filter("times > 0 AND state <> 'b'").groupBy("conv", "content").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")).alias("first")
    ).select("conv", F.col("first.turn").alias("turn"), "content", F.col("first.role").alias("role"), F.col("first.text").alias("text"))
    return counted, firsts


def _in_order(rows: DataFrame) -> DataFrame:
    """All turns by conversation, turn and content, the text of a first occurrence ahead of the turns that have it.

    Sorting by ranges spreads a conversation of very many turns over partitions;
    equal turns are one row.
    """
    counted, firsts = _facts(rows)
    none = F.lit(None).cast("string")
    columns = ("conv", "turn", "content", "times", "initial", "state", "role", "text")
    texts = firsts.withColumns({"times": F.lit(-1).cast("long"), "initial": none, "state": none}).select(*columns)
    both = texts.union(counted.withColumns({"role": none, "text": none}).select(*columns))
    keys = ("conv", "turn", "content")
    return both.repartitionByRange(*keys).sortWithinPartitions(*keys, "times")


_FACTS = [f.name for f in fields(Facts)]
_FACT_TYPES = {"first": "string", "last": "string"}
_RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _result(facts: Facts, cost: int) -> dict[str, int]:
    return {"gaps": facts.gaps, "blank": facts.blank, "duplicate": facts.duplicate, "truncated": facts.truncated, "illegal": facts.illegal, "cost": cost}


def _blocks(ordered: DataFrame, block_turns: int) -> DataFrame:
    """Whole conversations with their result, and blocks of the others with their turns.

    The first and the last conversation of a partition may go on in the next ones.
    """
    kind = ordered.schema["conv"].dataType.simpleString()
    schema = ", ".join([
        f"conv {kind}, whole boolean, part int, block int", *(f"{n} {_FACT_TYPES.get(n, 'long')}" for n in _FACTS),
        "gaps long, cost long, audit string, sha string, turns string, roles array<string>, texts array<string>",
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, target = TaskContext.get().partitionId(), 0, None
        rows: list[dict] = []
        size_out = 0
        conv, begun, ahead = None, 0, None
        facts, letters, roles, texts, size = Facts(), [], [], [], 0

        def close(ends_here: bool) -> None:
            nonlocal facts, letters, roles, texts, size, block, size_out
            turns = "".join(letters)
            row = {"conv": conv, "whole": ends_here, "part": part, "block": block} | {n: getattr(facts, n) for n in _FACTS}
            if ends_here:
                cost, audit = repair(turns)
                kept = b"\n".join(repaired(marked(audit, turns), 0, zip(roles, texts)))
                row |= _result(facts, cost) | {"audit": audit, "sha": hashlib.sha256(kept).hexdigest()}
            else:
                row |= {"turns": turns, "roles": roles, "texts": texts}
                size_out += size
            rows.append(row)
            block += 1
            facts, letters, roles, texts, size = Facts(), [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows, size_out
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in target]
            rows, size_out = [], 0
            return pa.RecordBatch.from_arrays(columns, schema=target)

        cut = False
        for batch in batches:
            target = target or _arrow_schema(schema, batch.schema.field("conv").type)
            for here, turn, content, times, initial, state, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if begun == 0 or here != conv:
                    if begun:
                        close(begun > 1 and not cut)
                    conv, ahead, cut = here, None, False
                    begun += 1
                    if len(rows) >= ROWS_OUT or size_out >= BLOCK_BYTES:
                        yield out()
                if times < 0:
                    ahead = (turn, content, role, text)
                    continue
                if not times:
                    continue
                facts.add(turn, initial, times)
                first = ahead is not None and ahead[:2] == (turn, content)
                if state == "b":
                    facts.blank += times
                else:
                    facts.duplicate += times - first
                    facts.truncated += first and state == "t"
                if first:
                    letter = initial if initial in ("s", "u", "a") else "o"
                    letters.append(letter.upper() if state == "t" else letter)
                    roles.append(ahead[2])
                    texts.append(ahead[3])
                    size += len(ahead[3])
                    times -= 1
                while True:
                    room = max(0, block_turns - len(letters))
                    letters.extend(DELETED * min(room, times))
                    times -= min(room, times)
                    if len(letters) >= block_turns or size >= BLOCK_BYTES:
                        # The block's facts hold all turns of this row; what is left of it only adds letters.
                        cut = True
                        close(False)
                        if size_out >= BLOCK_BYTES:
                            yield out()
                    if not times:
                        break
        if begun:
            close(False)
        if rows:
            yield out()

    return ordered.mapInArrow(run, schema)


def _arrow_schema(schema: str, conv: pa.DataType) -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    named = [column.split() for column in schema.split(", ")]
    return pa.schema([(name, conv if name == "conv" else kinds[kind]) for name, kind in named])


def _choose(blocks: DataFrame) -> DataFrame:
    """For conversations in several blocks, a row of results (``nth`` -1) and one per block with its edits.

    A conversation's blocks meet without their texts: a letter per turn, as in the audit that they give.
    """
    kind = blocks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, nth long, part int, block int, before int, edits string, " + ", ".join(f"{n} long" for n in _RESULTS) + ", audit string"

    def run(table: pa.Table) -> pa.Table:
        target = _arrow_schema(schema, table.schema.field("conv").type)
        found = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        facts = Facts()
        for r in found:
            facts = facts.join(Facts(*(r[n] for n in _FACTS)))
        cost, chosen = repair_blocks([r["turns"] for r in found])
        rows = [{"conv": found[0]["conv"], "nth": -1, "audit": "".join(edits for _, edits in chosen)} | _result(facts, cost)]
        rows += [
            {"conv": r["conv"], "nth": i, "part": r["part"], "block": r["block"], "before": before, "edits": marked(edits, r["turns"])}
            for i, (r, (before, edits)) in enumerate(zip(found, chosen))
        ]
        return pa.Table.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in target], schema=target)

    return blocks.groupBy("conv").applyInArrow(run, schema)


def _hash_in_order(rows: DataFrame) -> DataFrame:
    """Results with the hash of the repaired texts; a conversation's row of results comes first, then its blocks."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, " + ", ".join(f"{n} long" for n in _RESULTS) + ", audit string, sha string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, result, digest, empty = None, None, None, True

        def out() -> pa.RecordBatch:
            row = result | {"sha": digest.hexdigest()}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in target], schema=target)

        for batch in batches:
            target = target or _arrow_schema(schema, batch.schema.field("conv").type)
            for at in range(batch.num_rows):
                row = {n: c[at].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                if row["nth"] < 0:
                    if result is not None:
                        yield out()
                    result, digest, empty = {n: row.get(n) for n in target.names}, hashlib.sha256(), True
                    continue
                for turn in repaired(row["edits"], row["before"], zip(row["roles"], row["texts"])):
                    digest.update(turn if empty else b"\n" + turn)
                    empty = False
        if result is not None:
            yield out()

    return rows.mapInArrow(run, schema)


def repair_damaged(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """Faults, cheapest edits and repaired text's hash of every conversation after damage.

    Null roles and texts are one blank, null turns come first, and turns of equal
    number are ordered by a hash of role and text. Wholly repeated rows are damaged
    alike; all but the first are duplicates. Null conversation IDs form one
    conversation. A conversation without any turn left has zeros, an empty audit and
    the hash of the empty string; an empty table has no rows.
    """
    run = RunFolder(conversations.sparkSession, "conversations")
    rows = damaged(columns_as(conversations, conv=conv, turn=turn, role=role, text=text))
    blocks = run.keep(_blocks(_in_order(rows), block_turns), "blocks")
    results = ("conv", *_RESULTS, "audit", "sha")
    parts = blocks.filter("NOT whole")
    chosen = run.keep(_choose(parts.drop("roles", "texts")), "chosen")
    texts = parts.select("part", "block", "roles", "texts")
    pieces = chosen.join(texts, ["part", "block"], "left").repartition("conv").sortWithinPartitions("conv", "nth")
    done = blocks.filter("whole").select(*results).union(_hash_in_order(pieces).select(*results))
    return done.select(F.col("conv").alias("conv_id"), *_RESULTS, "audit", F.col("sha").alias("repaired_sha256"))


def _sql() -> str:
    """The same in SQL: states that go on alike are one (e: nothing yet, s, u, p: pairs), a way is its cost in six digits and its audit."""

    def more(way: str, cost: str, edit: str) -> str:
        return f"printf('%06d', CAST({way}[1:6] AS INTEGER) + {cost}) || {way}[7:] || '{edit}'"

    def least(*ways: str) -> str:
        return f"least({', '.join(ways)})"

    extra = "CASE WHEN truncated THEN 1 ELSE 0 END"
    stays = f"CASE WHEN NOT bound AND initial = '{{}}' THEN {{}} END"
    rerole = "CASE WHEN NOT bound THEN {} END"
    to_user, to_reroled = [], []
    for state in "esp":
        to_user.append(stays.format("u", more(state, extra, "K")))
        to_reroled.append(rerole.format(more(state, f"2 + {extra}", "R")))
    steps = {
        "e": more("e", "3", "D"),
        "s": least(more("s", "3", "D"), stays.format("s", more("e", extra, "K"))),
        "u": least(more("u", "3", "D"), *to_user, *to_reroled),
        "p": least(more("p", "3", "D"), stays.format("a", more("u", extra, "K")), rerole.format(more("u", f"2 + {extra}", "R"))),
    }
    stepped = ", ".join(f"{way} AS {state}1" for state, way in steps.items())
    users = least("u1", *(more(f"{state}1", "2", "I") for state in "esp"))
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || text), copy) AS i FROM damaged
), judged AS (
  SELECT *, role[1:1] AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeats,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) NOT IN ('.', '!', '?') AS cut,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), turns AS (
  SELECT conv_id, turn, role, text, i, initial, before, blank, NOT blank AND repeats AS duplicate,
         NOT blank AND NOT repeats AND cut AS truncated, blank OR repeats AS bound
  FROM judged
), convs AS (
  SELECT c.conv_id, row_number() OVER () AS conv, n FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN (SELECT conv_id, max(i) AS n FROM turns GROUP BY conv_id) t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
), listed AS (
  SELECT conv, t.* FROM turns t JOIN convs c ON c.conv_id IS NOT DISTINCT FROM t.conv_id
), walk(conv, i, e, s, u, p) AS (
  SELECT conv, 0::BIGINT, '000000', NULL::VARCHAR, '000002I', '000004II' FROM convs
  UNION ALL
  SELECT conv, i, e1, s1, u2, least(p1, {more("u2", "2", "I")}) FROM (
    SELECT *, {users} AS u2 FROM (
      SELECT w.conv, l.i, {stepped} FROM walk w JOIN listed l ON l.conv = w.conv AND l.i = w.i + 1)))
, chosen AS (
  SELECT c.conv, c.conv_id, least(w.e, w.p) AS way FROM walk w JOIN convs c ON c.conv = w.conv AND w.i = coalesce(c.n, 0)
), edits AS (
  SELECT conv, k, way[6 + k:6 + k] AS edit, k - length(replace(way[7:6 + k], 'I', '')) AS inserted
  FROM (SELECT conv, way, unnest(range(1, length(way) - 5)) AS k FROM chosen)
), placed AS (
  SELECT e.conv, e.k, e.edit, l.role, l.text, row_number() OVER (PARTITION BY e.conv ORDER BY e.k) AS j
  FROM edits e LEFT JOIN listed l ON l.conv = e.conv AND e.edit <> 'I' AND l.i = e.k - e.inserted WHERE e.edit <> 'D'
), led AS (
  SELECT *, CASE WHEN first_value(edit) OVER w = 'K' AND first_value(role[1:1]) OVER w = 's' THEN 1 ELSE 0 END AS led
  FROM placed WINDOW w AS (PARTITION BY conv ORDER BY j)
), written AS (
  SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                          || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS body
  FROM led GROUP BY conv
), faults AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM listed GROUP BY conv
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       CAST(c.way[1:6] AS BIGINT) AS cost, c.way[7:] AS audit, sha256(coalesce(w.body, '')) AS repaired_sha256
FROM chosen c LEFT JOIN faults f ON f.conv = c.conv LEFT JOIN written w ON w.conv = c.conv
"""


CONVERSATION_SQL = _sql()


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
