"""The stored link graph: updates, crawls without texts, broken-off updates."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom import discover
from linkloom.operators.edge_index import EdgeIndex
from linkloom.operators.links import document_links
from linkloom.operators.storage import Commits

DOC = "application/vnd.google-apps.document"
FILES = (
    "file_id string, name string, mime_type string, parent_id string, "
    "modified_time string, trashed boolean, http_status int"
)


def url(name):
    return f"https://docs.google.com/document/d/{name}/edit"


def snapshot(spark, docs):
    """``docs``: name -> (revision, status, names linked to)."""
    files = [(n, n, DOC, None, revision, False, status) for n, (revision, status, _) in docs.items()]
    texts = [(n, " ".join(map(url, linked))) for n, (_, _, linked) in docs.items()]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(texts, "file_id string, markdown string")


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def unreadable(spark):
    failing = F.raise_error(F.lit("a text was read")).cast("string")
    return spark.range(3).select(F.format_string("d%s", "id").alias("file_id"), failing.alias("markdown"))


def test_changed_documents_replace_their_own_edges(spark, tmp_path):
    index = EdgeIndex(spark, str(tmp_path), documents_per_bucket=4)
    rng = random.Random(6)
    names = [f"n{i}" for i in range(30)]
    docs = {n: ("1", 200, rng.sample(names, 3)) for n in names}
    versions = []
    for _ in range(3):
        files, contents = snapshot(spark, docs)
        versions.append(index.update(files, contents))
        assert rows(index.edges().select("src", "pos", "url", "dst")) == rows(document_links(contents, files))
        for n in rng.sample(sorted(docs), 6):
            docs[n] = (f"{docs[n][0]}+", 200, rng.sample(names, 2))
        docs.pop(sorted(docs)[0])
        docs[sorted(docs)[1]] = (*docs[sorted(docs)[1]][:1], 403, ["n2"])
        docs[f"new{len(versions)}"] = (None, 200, ["n3", "n4"])
    assert versions == [1, 2, 3]
    # An unchanged revision keeps its edges, whatever the text is now.
    files, contents = snapshot(spark, docs)
    index.update(files, contents)
    before = rows(index.edges())
    index.update(files, contents.withColumn("markdown", F.lit(url("elsewhere"))))
    assert rows(index.edges()) == before
    index.close()


def test_only_changed_texts_are_read(spark, tmp_path):
    index = EdgeIndex(spark, str(tmp_path))
    docs = {"a": ("1", 200, ["b"]), "b": ("1", 200, ["c"]), "c": ("1", 200, [])}
    files, contents = snapshot(spark, docs)
    assert index.update(files, contents) == 1
    assert index.update(files, unreadable(spark)) == 1
    files, contents = snapshot(spark, docs | {"b": ("2", 200, ["a"])})
    assert index.update(files, contents.filter("file_id = 'b'")) == 2
    assert rows(index.edges().select("src", "dst")) == {("a", "b"), ("b", "a")}
    assert rows(index.sources()) == {("a", "1"), ("b", "2"), ("c", "1")}


def test_crawls_with_an_index_read_no_text(spark, tmp_path):
    names = [f"n{i}" for i in range(12)]
    docs = {a: ("1", 200, [b]) for a, b in zip(names, names[1:] + names[:1])}
    files, contents = snapshot(spark, docs)
    EdgeIndex(spark, str(tmp_path)).update(files, contents)
    index = EdgeIndex(spark, str(tmp_path))  # as another session finds it
    for seed, depth in (("n0", 3), ("n7", 5)):
        seeds = spark.createDataFrame([(0, url(seed))], "seed_pos long, url string")
        plain = discover(seeds, files, contents, max_depth=depth)
        for given in (None, unreadable(spark)):
            found = discover(seeds, files, given, max_depth=depth, index=index)
            assert {tuple(map(str, r)) for r in found.collect()} == {tuple(map(str, r)) for r in plain.collect()}
    index.close()


def test_edges_stay_in_their_buckets(spark, tmp_path):
    docs = {f"n{i}": ("1", 200, ["n1"]) for i in range(40)}
    index = EdgeIndex(spark, str(tmp_path), documents_per_bucket=15)
    index.update(*snapshot(spark, docs))
    frontier = spark.createDataFrame([("n2", 0)], "src string, seed_pos long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.edges().join(frontier, "src")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    index.close()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 3 out of 3" in plan


def test_an_update_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    index = EdgeIndex(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no edge index"):
        index.edges()
    index.update(*snapshot(spark, {"a": ("1", 200, ["b"])}))

    def broken(*_, **__):
        raise OSError("broken off")

    with monkeypatch.context() as patch:
        patch.setattr(Commits, "commit", broken)
        with pytest.raises(OSError):
            index.update(*snapshot(spark, {"a": ("2", 200, ["c"])}))
    assert rows(index.edges().select("src", "dst")) == {("a", "b")}
    assert index.update(*snapshot(spark, {"a": ("2", 200, ["c"])})) == 2
    assert rows(index.edges().select("src", "dst")) == {("a", "c")}
    index.close()


def test_no_documents(spark, tmp_path):
    index = EdgeIndex(spark, str(tmp_path))
    files, contents = snapshot(spark, {"a": ("1", 200, ["b"])})
    assert index.update(files.limit(0), contents.limit(0)) == 1
    assert rows(index.edges()) == set()
    assert index.update(files, contents) == 2 and len(rows(index.edges())) == 1
    assert index.update(files.limit(0), unreadable(spark)) == 3 and rows(index.edges()) == set()
    index.close()
