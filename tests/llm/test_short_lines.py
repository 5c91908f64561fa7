"""Short lines are dropped where the very same line recurs often; longer ones by their template."""

from linkloom.llm import line_dedup


def test_short_lines_recur_exactly(spark):
    own = [f"{w} has a line of its own on {w} alone" for w in ("salt", "tin", "rain", "oak", "iron", "moss")]
    texts = [f"{c}\n\nAll  rights reserved.\nPage {n}" for n, c in enumerate(own)]
    texts[0] += "\nOn the way"
    texts[1] += "\nOn the way"
    changed, _ = line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.text for r in changed.orderBy("doc_id").collect()] == [
        f"{c}\n\nPage {n}" + ("\nOn the way" if n < 2 else "") for n, c in enumerate(own)]


def remaining(spark, lines):
    """Lines that are left of pages with a long line of their own and one of ``lines`` each."""
    letters = lambda n: chr(97 + n // 26) + chr(97 + n % 26)
    own = [" ".join(f"own{letters(n)}{letters(k)}" for k in range(9 + n % 3)) for n in range(len(lines))]
    pages = [(n, f"{a}\n{b}") for n, (a, b) in enumerate(zip(own, lines))]
    changed, _ = line_dedup.drop_recurring_lines(spark.createDataFrame(pages, "doc_id long, text string"))
    rows = [r.text.split("\n") for r in changed.orderBy("doc_id").collect()]
    assert [r[0] for r in rows] == own
    return [r[1] if len(r) > 1 else None for r in rows]


def test_rare_variants_of_a_frequent_line_go_with_it(spark):
    names = ["News"] * 10 + ["Sport", "Music"]
    assert remaining(spark, [f"Posted by admin in the category {c}" for c in names]) == [None] * 12


def test_a_leaf_has_several_templates(spark):
    one = [f"This page was written by {n} for the daily paper" for n in ("Ann", "Bob", "Cid")]
    two = [f"This page was written in {n} after the long war" for n in ("Rome", "Bonn", "Oslo")]
    alone = ["This page was written with much love and little care"]
    assert remaining(spark, one + two + alone) == [None] * 6 + alone


def test_unlike_lines_of_a_leaf_stay(spark):
    lines = [f"We went to the {a} {b} {c} {d}" for a, b, c, d in ("abcd", "efgh", "ijkl", "mnop", "aqrs", "tbuv")]
    assert remaining(spark, lines) == lines
