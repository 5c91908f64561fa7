"""Names, paths, tags, collision suffixes and relative links."""

import posixpath
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from linkloom.functions import naming
from linkloom.operators import paths


UNSAFE = set('<>:"/\\|?*') | {chr(c) for c in range(32)}


def names(seed=11, n=300):
    """Names of every kind: long and multi-byte first, then random mixtures."""
    rng = random.Random(seed)
    made = ["é" * 200, "日本" * 100, "a" * 254 + "é", "x" * 5000, "", " ", "...", "\x00", "a/" * 200]
    alphabet = "aB9 ._-" + "".join(sorted(UNSAFE)) + "éß日😀"
    return made + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def safe_bytes(name):
    """A plain model: one character after another."""
    out = ""
    for c in name:
        c = "_" if c in UNSAFE else c
        if c in " ." and out.endswith(c):
            continue
        out += c
    return (out.strip(" ._") or "untitled").encode()[:255]


def as_bytes(value):
    return F.hex(value.cast("binary"))


def test_safe_names_follow_the_model(evaluate):
    got = evaluate(as_bytes(naming.safe_name(F.col("a"))), names())
    assert [bytes.fromhex(g) for g in got] == [safe_bytes(n) for n in names()]


def test_safe_names_are_safe_segments(evaluate):
    for made in (bytes.fromhex(g) for g in evaluate(as_bytes(naming.safe_name(F.col("a"))), names(12))):
        text = made.decode("utf-8", "replace")
        assert 0 < len(made) <= 255 and not set(text) & UNSAFE and text not in (".", "..")


def test_short_safe_names_stay_as_they_are(evaluate):
    once = [b.decode() for b in map(safe_bytes, names(13)) if len(b) < 200]
    assert evaluate(naming.safe_name(F.col("a")), once) == once


def test_slugs_are_plain_and_stable(evaluate):
    titles = names(14)
    made = evaluate(naming.slug(F.col("a")), titles)
    for title, got in zip(titles, made):
        assert re.fullmatch("[a-z0-9]+(-[a-z0-9]+)*", got)
        kept = [c for c in title.rpartition(".")[0 if "." in title else 2].lower() if c in string.ascii_lowercase + string.digits]
        assert got == "unnamed" or got.replace("-", "") == "".join(kept)
    assert evaluate(naming.slug(F.col("a")), made) == made


@pytest.mark.parametrize(
    "base, frags, title, expected",
    [
        ("/out", ("a", "b", "c", "", ""), "My Page", "/out/a/b/c/my-page.md"),
        ("/out", ("", "", "", "", ""), "My Page", "/out/my-page.md"),
        ("./out/", ("a", "", "b", "", ""), "My Page", "out/a/b/my-page.md"),
        ("/out/../o", ("x/y", "<>", "..", "", ""), "a:b", "/o/x_y/untitled/untitled/ab.md"),
        (".", ("a", "", "", "", ""), "t", "a/t.md"),
        ("", ("a", "", "", "", ""), "t", "a/t.md"),
        ("/", ("a", "", "", "", ""), "t", "/a/t.md"),
        ("../up", ("", "", "", "", ""), "t", "../up/t.md"),
    ],
)
def test_output_path(evaluate, base, frags, title, expected):
    columns = ("t", *naming.FRAGMENT_COLUMNS)
    path = naming.output_path(
        base,
        naming.directories(*(F.col(c) for c in naming.FRAGMENT_COLUMNS)),
        naming.file_name(F.col("t")),
    )
    assert evaluate(path, [(title, *frags)], columns) == [expected]


def test_relative_paths_reach_their_targets(spark):
    """From the source's directory the path leads to the target, by the shortest way."""
    rng = random.Random(15)
    draw = lambda: [rng.choice("pqr") for _ in range(rng.randrange(6))]
    rows = [(draw(), draw(), f"f{i}.md") for i in range(300)]
    pairs = spark.createDataFrame(rows, "source_dirs array<string>, target_dirs array<string>, target_file string")
    for row in paths.relative_paths(pairs).collect():
        source, target = "/".join(["", *row.source_dirs]), "/".join(["", *row.target_dirs, row.target_file])
        assert posixpath.normpath(f"{source}/{row.relative_path}") == target
        assert row.relative_path == posixpath.relpath(target, source or "/")


def test_tags_are_trimmed_and_never_empty(evaluate):
    rng = random.Random(16)
    rows = ["".join(rng.choice("ab,; \t") for _ in range(rng.randrange(20))) for _ in range(200)]
    expected = [[t.strip() for t in row.split(";") if t.strip()] for row in rows]
    assert evaluate(naming.tag_list(F.col("a")), rows) == expected


def test_fragments_without_empty_ones(evaluate):
    columns = naming.FRAGMENT_COLUMNS
    value = naming.fragments(*(F.col(c) for c in columns))
    assert evaluate(value, [("a", "", "b/c", "", "d")], columns) == [["a", "b/c", "d"]]


def numbered(rows):
    """Suffixes given one row after the other."""
    seen, out = {}, {}
    for position, path in sorted(rows):
        n = seen.get(path, 0)
        seen[path] = n + 1
        stem, dot, ext = path.rpartition(".")
        out[position] = path if n == 0 else f"{stem}_{n}{dot}{ext}"
    return out


def test_unique_paths_over_block_limits(spark, monkeypatch):
    monkeypatch.setattr(paths, "POSITIONS_PER_BLOCK", 7)
    rows = [(i * 3 % 400, "w/unnamed.md" if i % 3 else f"w/{i % 5}.md") for i in range(400)]
    plan = spark.createDataFrame(rows, "rec_pos long, path string")
    got = {r.rec_pos: r.path for r in paths.unique_paths(plan).collect()}
    assert got == numbered(rows)
    assert len(set(got.values())) == len(got)


def test_unique_paths_spread_a_hot_path(spark):
    """No window group may be larger than a block, whatever a path's share."""
    plan = spark.range(0, 200_000).selectExpr("id * 5 AS rec_pos", "'w/unnamed.md' AS path")
    unique = paths.unique_paths(plan)
    assert unique.select("path").distinct().count() == 200_000
    last = unique.filter("rec_pos = 999995").first()
    assert last.path == "w/unnamed_199999.md"


def test_presets_come_first(spark):
    """Paths taken already are earlier rows of the plan."""
    plan = spark.createDataFrame(
        [(i, "o/f.md") for i in range(4)] + [(4, "o/g.md")],
        "rec_pos long, path string",
    )
    got = [r.path for r in paths.unique_paths(plan).orderBy("rec_pos").collect()]
    assert got == ["o/f.md", "o/f_1.md", "o/f_2.md", "o/f_3.md", "o/g.md"]
