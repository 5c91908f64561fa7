"""How often line dedup moves texts, and which rows it reads lines from."""

import re

import pytest

from linkloom.llm import line_dedup
from linkloom.operators.storage import RunFolder

NAMES = ("Ann", "Bob", "Cid", "Dora", "Eve", "Finn")


@pytest.fixture
def large(spark):
    """Plans as they are when no table is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_move_to_their_keys_once(spark, large, monkeypatch):
    """Near-equal texts and the lines of templates are read from one table, whose texts have moved to it."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moving, keep = [], RunFolder.keep

    def kept(run, df, table):
        blocks = df._jdf.queryExecution().explainString(mode).split("\n\n")
        moving.extend([table] * sum("Exchange\n" in b and bool(re.search(r"\btext#", b)) for b in blocks))
        return keep(run, df, table)

    monkeypatch.setattr(RunFolder, "keep", kept)
    texts = [f"own{n} words of text {n}\nThis page was written by {a} for the daily paper" for n, a in enumerate(NAMES)]
    changed, _ = line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.text.count("\n") for r in changed.collect()} == {0}
    # Sets of candidates are made of the open texts only.
    assert moving == ["open_texts", "star_sets"]


def test_lines_of_rows_without_an_id_and_of_repeated_rows_are_read(spark):
    letters = ("ab", "cd", "ef", "gh", "ij", "kl")
    own = [" ".join(f"own{x}{y}" for y in "abcdefgh"[: 6 + n % 3]) for n, x in enumerate(letters)]
    texts = [f"{o}\nThis page was written by {a} for the daily paper" for o, a in zip(own, NAMES)]
    rows = [(None, t) for t in texts[:3]] + [(5, t) for t in texts[3:]] + [(5, texts[3]), (None, texts[0]), (7, texts[0]), (None, None), (8, "")]
    changed, _ = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = [(d, t and t.split("\n")[0]) for d, t in rows]
    assert sorted(map(str, ((r.doc_id, r.text) for r in changed.collect()))) == sorted(map(str, wanted))


def test_blank_lines_are_left_out(spark):
    text = "one two three four five\n\n \n\t \x0b\f\r\n  7 up \n\u00a0"
    keyed = line_dedup.line_keys(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "text", "doc_id", 4, 5)
    assert sorted((r.doc, r.place, r.n) for r in keyed.collect()) == [(1, 0, 5), (1, 4, 2), (1, 5, 1)]
