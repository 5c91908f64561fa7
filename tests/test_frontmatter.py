"""Front matter: parsing, rendering, rebuilding, quoting, hashes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from linkloom.functions import frontmatter as fm


def parse(spark, *contents):
    df = spark.createDataFrame(list(enumerate(contents)), "n int, content string")
    return fm.parse_front_matter(df).orderBy("n").collect()


def test_parse_values_and_body(spark):
    row = parse(
        spark,
        '---\ntitle: "A: b"\n  key :  v : w  \nno colon\n\n:\nquoted: ""x""\n---\n\nBody\n---\nmore',
    )[0]
    assert row.parse_error is None
    assert row.front_matter == {"title": "A: b", "key": "v : w", "": "", "quoted": "x"}
    assert row.body == "\nBody\n---\nmore"


def test_last_line_of_a_key_wins(spark):
    row = parse(spark, "---\na: 1\nb: 2\na: 3\na: 0\n---\n")[0]
    assert row.front_matter == {"a": "0", "b": "2"}
    assert row.body == ""


@pytest.mark.parametrize(
    "content, error",
    [
        ("plain text", "failed to parse frontmatter: no frontmatter found"),
        ("", "failed to parse frontmatter: no frontmatter found"),
        (" ---\na: 1\n---\n", "failed to parse frontmatter: no frontmatter found"),
        ("---\na: 1\n\nBody", "failed to parse frontmatter: frontmatter not closed"),
        ("---\na: 1\n---", "failed to parse frontmatter: frontmatter not closed"),
        ("---\n---\n", "failed to parse frontmatter: frontmatter not closed"),
        (None, "failed to read file"),
    ],
)
def test_parse_errors(spark, content, error):
    row = parse(spark, content)[0]
    assert (row.parse_error, row.front_matter, row.body) == (error, None, None)


def test_parse_many_lines(spark):
    lines = "".join(f"k{i % 5000}: {i}\n" for i in range(20_000))
    row = parse(spark, f"---\n{lines}---\nx")[0]
    assert row.front_matter == {f"k{i}": str(15_000 + i) for i in range(5000)}


@pytest.mark.parametrize(
    "value, expected",
    [
        ("plain", "plain"),
        ("-dash", '"-dash"'),
        ("in-side", "in-side"),
        ("a: b", '"a: b"'),
        ('say "x"', '"say \\"x\\""'),
        ("it's", '"it\'s"'),
        ("[x]", '"[x]"'),
        ("{x}", '"{x}"'),
        ("100%", '"100%"'),
        ("back\\slash", "back\\slash"),
        ("", ""),
    ],
)
def test_quoting(evaluate, value, expected):
    assert evaluate(fm.yaml_value(F.col("a")), [value]) == [expected]


def test_render(evaluate):
    header = fm.render_front_matter(
        F.col("t"), F.col("l"), F.col("r"), F.lit("h"), F.split("g", ",")
    )
    rows = [("T: x", "https://e.org", "2024-01-01T00:00:00Z", "a,b")]
    assert evaluate(header, rows, ("t", "l", "r", "g")) == [
        '---\ndescription: "T: x"\neditor: markdown\ngdrive-link: "https://e.org"\n'
        'hash-gdrive: "2024-01-01T00:00:00Z"\nhash-content: h\npublished: true\n'
        'tags: a, b\ntitle: "T: x"\n---\n'
    ]


def test_render_without_tags(evaluate):
    header = fm.render_front_matter(
        F.col("a"), F.lit("l"), F.lit("stub"), F.lit("h"), F.array().cast("array<string>")
    )
    assert evaluate(header, ["t"]) == [
        "---\ndescription: t\neditor: markdown\ngdrive-link: l\nhash-gdrive: stub\n"
        "hash-content: h\npublished: true\ntitle: t\n---\n"
    ]


def test_rebuild_orders_quotes_and_drops_unknown_keys(spark):
    df = spark.createDataFrame(
        [({"title": "T", "extra": "lost", "tags": "a: b", "published": "true"},)],
        "m map<string,string>",
    )
    built = fm.rebuild_front_matter(F.col("m"), {"hash-content": F.lit("h#1")})
    assert df.select(built.alias("out")).first().out == (
        '---\nhash-content: "h#1"\npublished: true\ntags: "a: b"\ntitle: T\n---\n'
    )


def test_escaped_quotes_do_not_round_trip(spark):
    """Escapes are written but never read back, and outer quotes all go."""
    df = spark.createDataFrame([({"title": 'say "hi"'},)], "m map<string,string>")
    text = df.select(fm.rebuild_front_matter(F.col("m")).alias("out")).first().out
    assert text == '---\ntitle: "say \\"hi\\""\n---\n'
    assert parse(spark, text)[0].front_matter == {"title": 'say \\"hi\\'}


@pytest.mark.parametrize("text", ["", "abc", "naïve ☃\n"])
def test_content_hash(evaluate, text):
    expected = hashlib.sha256(text.encode()).hexdigest()
    assert evaluate(fm.content_hash(F.col("a")), [text]) == [expected]
