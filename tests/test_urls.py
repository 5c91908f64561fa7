"""File IDs, canonical links, link extraction and repair of broken URLs."""

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators.links import document_links, extract_links, with_file_id

DOCS, DRIVE = "https://docs.google.com", "https://drive.google.com"
LONG = "A1b2C3d4E5f6G7h8I9j0K1l2M3"

FILE_IDS = [
    # the forms of URL there are
    (f"{DOCS}/document/d/doc-one_1/edit", "doc-one_1"),
    (f"{DOCS}/spreadsheets/d/sheet2/edit#gid=0", "sheet2"),
    (f"{DOCS}/presentation/d/deck3", "deck3"),
    (f"{DOCS}/forms/d/e/form4/viewform", "form4"),
    (f"{DRIVE}/file/d/file5/view?usp=sharing", "file5"),
    (f"{DRIVE}/drive/folders/fold6", "fold6"),
    (f"{DRIVE}/drive/u/0/folders/fold7?resourcekey=k", "fold7"),
    # query parameter, first one counts, decoded
    (f"{DRIVE}/open?id=q8&x=1", "q8"),
    (f"{DRIVE}/open?x=1&id=q9#frag", "q9"),
    (f"{DRIVE}/open?id=a%2Db+c", "a-b c"),
    (f"{DRIVE}/open?id=&id=second", None),
    (f"{DRIVE}/open?id=bad;pair&id=good", "good"),
    (f"{DRIVE}/open?uid=no", None),
    # a path segment beats the query, the query beats a bare ID
    (f"{DOCS}/document/d/path10/edit?id=q10", "path10"),
    (f"{DRIVE}/{LONG}?id=q11", "q11"),
    (f"{DRIVE}/{LONG}/x", LONG),
    (f"{DRIVE}/short/x", None),
    # segments: empty, last, nested
    (f"{DOCS}/document/d/", ""),
    (f"{DOCS}/document/d", None),
    (f"{DOCS}/forms/d/e", "e"),
    (f"{DOCS}/forms/d/e/", ""),
    (f"{DRIVE}/d/folders/x", "folders"),
    # percent escapes in the path
    (f"{DOCS}/document/d/a%2Db/edit", "a-b"),
    (f"{DOCS}/document/d/a+b%2Fc/edit", "a+b"),
    (f"{DOCS}/document/d/a%zz/edit", None),
    (f"{DOCS}/document/d/ok/edit#bad%", None),
    # hosts: contained is enough, user and port are not the host
    (f"https://drive.google.com.evil.test/file/d/x12/view", "x12"),
    (f"//docs.google.com/document/d/x13", "x13"),
    (f"https://me@docs.google.com:443/document/d/x14", "x14"),
    (f"https://docs.google.com@evil.test/document/d/x15", None),
    (f"https://docs.google.com:port/document/d/x16", None),
    (f"https://evil.test/docs.google.com/document/d/x17", None),
    ("docs.google.com/document/d/x18/edit", None),
    ("mailto:docs.google.com/d/x19", None),
    # not usable at all
    ("https://example.org/document/d/x20", None),
    ("plain words", None),
    ("", None),
    (None, None),
    (f"{DOCS}/document/d/x21\n/edit", None),
    (f" {DOCS}/document/d/x22", None),
    (f'{DOCS}/document/d/x23/edit "a title"', "x23"),
]


def test_file_id(spark):
    df = spark.createDataFrame(FILE_IDS, "url string, expected string")
    for row in with_file_id(df, "url").collect():
        assert row.file_id == row.expected, row.url


@pytest.mark.parametrize(
    "mime, link",
    [
        ("application/vnd.google-apps.document", f"{DOCS}/document/d/F/edit"),
        ("application/vnd.google-apps.spreadsheet", f"{DOCS}/spreadsheets/d/F/edit"),
        ("application/vnd.google-apps.presentation", f"{DOCS}/presentation/d/F/edit"),
        ("application/vnd.google-apps.form", f"{DOCS}/forms/d/e/F/viewform"),
        ("application/vnd.google-apps.drawing", f"{DOCS}/drawings/d/F/edit"),
        ("application/vnd.google-apps.folder", f"{DRIVE}/drive/folders/F"),
        ("application/pdf", f"{DRIVE}/file/d/F/view"),
        ("image/png", f"{DRIVE}/file/d/F/view"),
        ("video/webm", f"{DRIVE}/file/d/F/view"),
        ("application/zip", f"{DRIVE}/file/d/F/view"),
        ("", f"{DRIVE}/file/d/F/view"),
    ],
)
def test_canonical_link(evaluate, mime, link):
    assert evaluate(urls.canonical_link(F.lit("F"), F.col("a")), [mime]) == [link]


REPAIRS = [
    ("no address here\nat all", "no address here\nat all"),
    (f"{DOCS}/document/d/one/edit", f"{DOCS}/document/d/one/edit"),
    (f"{DOCS}/document/d/on\ne/edit", f"{DOCS}/document/d/one/edit"),
    (f"{DRIVE}/file/d/tw \t\n   o/view", f"{DRIVE}/file/d/two/view"),
    (f"**{DOCS}/d/th**\n**ree/edit** end", f"**{DOCS}/d/three/edit end"),
    (f"a {DOCS}/d/1 b {DRIVE}/d/2 c", f"a {DOCS}/d/1 b {DRIVE}/d/2 c"),
    # three parts: only the first break is joined
    (f"{DOCS}/d/a\nb\nc", f"{DOCS}/d/ab\nc"),
    # a URL at a line end swallows the next paragraph's first word
    (f"[t]({DOCS}/d/x)\n\nNext one", f"[t]({DOCS}/d/x)Next one"),
    # nothing to join with
    (f"{DOCS}/d/x\n\n", f"{DOCS}/d/x\n\n"),
    # escapes
    (rf"{DOCS}/d/a\_b\*c\-d\[e\]f", f"{DOCS}/d/a_b*c-d[e]f"),
    (rf"x\_y {DOCS}/d/a\_b x\_y", rf"x\_y {DOCS}/d/a_b x\_y"),
    (rf"{DOCS}/d/a\.b\_c\\_d", rf"{DOCS}/d/a\.b_c\_d"),
    # joined first, unescaped after; the second part ends at a marker
    (rf"{DOCS}/d/a\-" + "\n" + r"b\_c", rf"{DOCS}/d/a-b\c"),
]


def test_repair_urls(evaluate):
    got = evaluate(urls.repair_urls(F.col("a")), [a for a, _ in REPAIRS])
    for (text, expected), value in zip(REPAIRS, got):
        assert value == expected, text


def plain_repair(text: str) -> str:
    """The two steps as first written, with backtracking and a callback."""
    ws = r"\t\n\f\r "
    head = r"https://(?:drive\.google\.com|docs\.google\.com)/"
    text = re.sub(
        rf"({head}[^{ws}*_]+)[*_]*[{ws}]*\n[{ws}]*[*_]*([^{ws}*_]+)[*_]*", r"\1\2", text
    )
    return re.sub(
        rf"{head}[^{ws}]*", lambda m: re.sub(r"\\([_*\-\[\]])", r"\1", m[0]), text
    )


PIECES = st.sampled_from(
    [f"{DOCS}/", f"{DRIVE}/", "a", "Z", "\\", "_", "*", "-", "[", "]", "(", ")"]
    + [" ", "\n", "\t", "\r", "\\_", "\\*", "https://", "\x0b", "é"]
)


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=60, max_size=60))
def test_repair_agrees_with_plain_form(evaluate, texts):
    assert evaluate(urls.repair_urls(F.col("a")), texts) == [
        plain_repair(t) for t in texts
    ]


def test_repair_survives_long_runs(evaluate):
    long = f"{DOCS}/d/a" + " " * 50_000 + "\n" * 50_000 + "*" * 50_000
    slashes = f"{DOCS}/d/" + "\\" * 200_000
    joined = f"{DOCS}/d/a" + "*" * 50_000 + "\n" * 50_000 + "b"
    got = evaluate(urls.repair_urls(F.col("a")), [long, slashes, joined])
    assert got == [long, slashes, f"{DOCS}/d/ab"]


def test_extract_links_keeps_urls_as_written(spark):
    text = (
        f"see [one]({DOCS}/document/d/one/edit) <{DRIVE}/file/d/two> {DOCS}/none "
        f"{DOCS}/document/d/me/edit \"{DOCS}/document/d/one/edit\" {DOCS}/document/d/one/edit"
    )
    contents = spark.createDataFrame(
        [("me", text), ("quiet", "nothing")], "file_id string, markdown string"
    )
    rows = extract_links(contents).orderBy("pos").collect()
    assert [(r.src, r.pos, r.url, r.dst) for r in rows] == [
        ("me", 0, f"{DOCS}/document/d/one/edit", "one"),
        ("me", 1, f"{DRIVE}/file/d/two>", "two>"),
        ("me", 4, f'{DOCS}/document/d/one/edit"', "one"),
        ("me", 5, f"{DOCS}/document/d/one/edit", "one"),
    ]


def test_only_readable_documents_are_searched(spark):
    link = f"{DOCS}/document/d/target/edit"
    files = [
        ("doc", "application/vnd.google-apps.document", 200),
        ("sheet", "application/vnd.google-apps.spreadsheet", 200),
        ("pdf", "application/pdf", 200),
        ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", 200),
        ("folder", "application/vnd.google-apps.folder", 200),
        ("image", "image/png", 200),
        ("secret", "application/vnd.google-apps.document", 403),
    ]
    contents = spark.createDataFrame(
        [(f[0], link) for f in files] + [("unknown", link)],
        "file_id string, markdown string",
    )
    metadata = spark.createDataFrame(
        files, "file_id string, mime_type string, http_status int"
    )
    found = {r.src for r in document_links(contents, metadata).collect()}
    assert found == {"doc", "sheet", "pdf", "docx"}


def test_open_brackets_cost_no_more_than_other_text(evaluate):
    """Matching is linear: a million brackets that never close, then a link."""
    text = "[" * 1_000_000 + "x](https://docs.google.com/document/d/abc/edit)"
    broken = "[" * 1_000_000
    start = time.time()
    got = evaluate(F.size(urls.markdown_link_urls(F.col("a"))), [text, broken])
    assert got == [1, 0] and time.time() - start < 30
