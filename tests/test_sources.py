"""CSV inputs, the discovery report and Markdown trees."""

import csv
import os

import pytest
from pyspark.errors import AnalysisException

from linkloom.operators import storage
from linkloom.sources import csv_files, markdown_tree, snapshots


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def seeds(spark, path):
    rows = csv_files.read_seeds(spark, path).orderBy("seed_pos").collect()
    return [r.url for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("url\nu1\nu2\n", ["u1", "u2"]),
        ("link\nu1\nu2", ["u1", "u2"]),
        ("URL\nu1\n\nu2\n", ["u1", "u2"]),
        ("name,Link,url\nn1,l1,u1\nn2,l2,u2\n", ["l1", "l2"]),
        ('url,note\n"u1","a, ""b""\nc"\n  u2  ,x\n,empty\n', ["u1", "u2"]),
        ("url\n", []),
    ],
)
def test_seeds(spark, tmp_path, text, expected):
    assert seeds(spark, write(tmp_path / "s.csv", text)) == expected


def test_seeds_need_a_column(spark, tmp_path):
    with pytest.raises(ValueError, match="no 'url' or 'link' column"):
        csv_files.read_seeds(spark, write(tmp_path / "s.csv", "name,value\na,b\n"))


def inventory(spark, path):
    df = csv_files.read_inventory(spark, path)
    return [tuple(r)[1:] for r in df.orderBy("rec_pos").collect()]


def test_inventory(spark, tmp_path):
    path = write(
        tmp_path / "i.csv",
        "Link,TITLE,tags,frag1,frag2,frag3,frag4,frag5,note\n"
        "l1,T 1,a;b,x,y,,,,n\n"
        'l2," T, 2 ",,,,,,,\n'
        "l3,,no title,,,,,,\n"
        ",No link,,,,,,,\n",
    )
    assert inventory(spark, path) == [
        ("l1", "T 1", "a;b", "x", "y", "", "", ""),
        ("l2", "T, 2", "", "", "", "", "", ""),
    ]


def test_missing_optional_columns_are_empty(spark, tmp_path):
    path = write(tmp_path / "i.csv", "link,title,frag1\nl1,T1,x\n")
    assert inventory(spark, path) == [("l1", "T1", "", "x", "", "", "", "")]


def test_last_duplicate_column_counts(spark, tmp_path):
    path = write(tmp_path / "i.csv", "link,title,Title\nl1,old,new\n")
    assert inventory(spark, path)[0][:2] == ("l1", "new")


def test_inventory_needs_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="'title'"):
        csv_files.read_inventory(spark, write(tmp_path / "i.csv", "link,tags\nl,t\n"))


@pytest.fixture
def many_splits(spark):
    """Small files are read in several parts, the larger files first."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("multi_line", [True, False])
def test_folders_go_by_header_and_order_of_each_file(spark, tmp_path, many_splits, multi_line):
    folder = tmp_path / "in ventory"
    folder.mkdir()
    expected = []
    layouts = [("link", "title", "frag1"), ("Title", "tags", "LINK"), ("link", "title", "frag1"), ("frag1", "title", "link", "title")]
    for n, (names, size) in enumerate(zip(layouts, (3, 40, 1, 25))):
        lines = [",".join(names)]
        for i in range(size):
            row = {"link": f"u{n}-{i}", "title": f"T{n}-{i}", "tags": f"g{i}", "frag1": f"f{n}"}
            lines.append(",".join(row[name.lower()] for name in names))
            expected.append((row["link"], row["title"], row["tags"] if "tags" in names else "", row["frag1"] if "frag1" in names else ""))
        write(folder / f"{n}.csv", "\n".join(lines) + "\n")
    write(folder / "9.csv", "")
    read = csv_files.read_inventory(spark, str(folder), multi_line).orderBy("rec_pos").collect()
    assert [(r.link, r.title, r.tags, r.frag1) for r in read] == expected
    assert [r.rec_pos for r in read] == list(range(len(expected)))
    urls = csv_files.read_seeds(spark, f"{folder}/*.csv", multi_line).orderBy("seed_pos").collect()
    assert [(r.seed_pos, r.url) for r in urls] == [(i, e[0]) for i, e in enumerate(expected)]


def test_every_file_of_a_folder_needs_the_columns(spark, tmp_path):
    write(tmp_path / "a.csv", "link,title\nl,t\n")
    write(tmp_path / "b.csv", "link,name\nl,t\n")
    with pytest.raises(ValueError, match="'title' not found in .*b.csv"):
        csv_files.read_inventory(spark, str(tmp_path))
    assert csv_files.read_seeds(spark, str(tmp_path)).count() == 2


def test_rejected_rows_name_their_file(spark, tmp_path):
    write(tmp_path / "a.csv", "link,title\nl,t,x\n")
    write(tmp_path / "b.csv", "link,title,tags\nl,t,x\nl,t\n")
    bad = csv_files.rejected_rows(spark, str(tmp_path)).collect()
    assert sorted((r.row, r.file[-5:]) for r in bad) == [("l,t", "b.csv"), ("l,t,x", "a.csv")]


@pytest.mark.parametrize("multi_line", [True, False])
def test_rows_of_another_width_are_rejected(spark, tmp_path, multi_line):
    path = write(tmp_path / "i.csv", "link,title\nl1,T1\nshort\nl2,T2,extra\nl3,T3\n")
    good = csv_files.read_inventory(spark, path, multi_line).orderBy("rec_pos").collect()
    assert [r.link for r in good] == ["l1", "l3"]
    bad = csv_files.rejected_rows(spark, path, multi_line).collect()
    assert sorted(r.row for r in bad) == ["l2,T2,extra", "short"]


def test_files_split_when_no_field_holds_a_line_break(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    with open(path, "w") as out:
        out.write("link,title\nu,t\n")
    for multi_line in (True, False):
        assert csv_files.read_inventory(spark, path, multi_line=multi_line).count() == 1


def test_discovery_report(spark, tmp_path):
    rows = [
        ("b", 'l "q", 2', " lead", "deleted", 1, 0, [0]),
        ("a", "l1", "T1", "available", 0, 0, []),
        (None, "bad", "INVALID_URL", "invalid", 0, 3, []),
    ]
    df = spark.createDataFrame(
        rows,
        "file_id string, link string, title string, status string, depth int, seed_pos long, trail array<int>",
    )
    out = tmp_path / "report"
    csv_files.write_discovery(df, str(out))
    parts = sorted(p for p in out.iterdir() if p.name.startswith("part-"))
    read = [row for p in parts for row in csv.reader(p.open(newline=""))]
    body = [row for row in read if row != ["link", "title", "status"]]
    assert body == [
        ["l1", "T1", ""],
        ['l "q", 2', " lead", "deleted"],
        ["bad", "INVALID_URL", "invalid"],
    ]
    assert '""' not in parts[0].read_text().splitlines()[1]


def test_report_reads_back_as_seeds(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", "l1", "T", "available", 0, 0, [])],
        "file_id string, link string, title string, status string, depth int, seed_pos long, trail array<int>",
    )
    csv_files.write_discovery(df, str(tmp_path / "r"))
    assert seeds(spark, str(tmp_path / "r")) == ["l1"]


def test_markdown_tree_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(
        [
            ("a.md", "---\ntitle: é\n---\n\nx"),
            ("deep/er/b c.md", "two\r\nlines"),
            ("error.md", None),
        ],
        "path string, content string",
    )
    (tmp_path / "notes.txt").write_text("not markdown")
    for directory in (str(tmp_path), f"file://{tmp_path}"):
        told = markdown_tree.write_markdown_tree(docs, directory).collect()
        assert sorted((r.path, r.error) for r in told) == [("a.md", None), ("deep/er/b c.md", None)]
    read = markdown_tree.read_markdown_tree(spark, str(tmp_path)).collect()
    assert {r.path: r.content for r in read} == {
        f"{tmp_path}/a.md": "---\ntitle: é\n---\n\nx",
        f"{tmp_path}/deep/er/b c.md": "two\r\nlines",
    }
    assert not list(tmp_path.rglob("*.part"))


def test_trees_lie_where_spark_looks_for_them(spark, tmp_path):
    """Folders in Hadoop's form of a URI and on a mount that only Spark knows."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.trees.link./here", f"file://{tmp_path}")
    for n, root in enumerate((f"file:{tmp_path}", "viewfs://trees/here")):
        assert storage.located(spark, f"{root}/in {n}").replace("///", "/") == f"file:{tmp_path}/in%20{n}"
        docs = documents(spark, **{"a b": f"{n}"})
        assert [r.error for r in markdown_tree.write_markdown_tree(docs, f"{root}/plain {n}").collect()] == [None]
        assert (tmp_path / f"plain {n}/wiki/a b.md").read_text() == f"{n}"
        tree = markdown_tree.MarkdownTree(spark, f"{root}/tree {n}")
        tree.publish(docs)
        assert shown(tree) == {"a b": f"{n}"}


def files_the_driver_knows(df):
    return [f for f in df.inputFiles() if f.endswith(".md")]


def test_plain_trees_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    names = [f"{n % 7}/{n % 3}/{n}.md" for n in range(200)] + ["top.md", "deep/a/b/c/d/e.md", "new\nline.md", "p%20 [q].md"]
    hidden = ["_a.md", ".b.md", "_sub/x.md", ".h/x.md", "x._COPYING_/e.md", "note.txt", "UP.MD"]
    seen = ["_x=1.md", "_s=b/x.md", "_metadata/a.md"]
    docs = spark.createDataFrame([(n, n) for n in names + hidden + seen] + [("empty.md", "")], "path string, content string")
    root = tmp_path / "tree"
    assert markdown_tree.write_markdown_tree(docs, str(root)).filter("error IS NOT NULL").count() == 0
    (root / "broken.md").symlink_to(tmp_path / "nowhere")
    for step in ("BATCH_NAMES", "BATCH_BYTES", "FILES_PER_TASK", "FOLDERS_PER_TASK"):  # batches and tasks of a few
        monkeypatch.setattr(markdown_tree, step, 5)
    read = markdown_tree.read_markdown_tree(spark, f"file://{root}/")
    assert files_the_driver_knows(read) == []
    assert sorted(tuple(r) for r in read.collect()) == sorted((f"{root}/{n}", n) for n in names + seen)
    some = markdown_tree.read_markdown_tree(spark, f"{root}/{{top.md,deep*,deep/a}}")
    assert sorted(r.content for r in some.collect()) == ["deep/a/b/c/d/e.md", "top.md"]
    assert [r.content for r in markdown_tree.read_markdown_tree(spark, f"{root}/_sub").collect()] == ["_sub/x.md"]
    (tmp_path / "nothing").mkdir()
    assert markdown_tree.read_markdown_tree(spark, str(tmp_path / "nothing")).collect() == []
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        markdown_tree.read_markdown_tree(spark, str(tmp_path / "none"))


def test_a_file_gone_since_it_was_listed_ends_the_run(spark, tmp_path):
    markdown_tree.write_markdown_tree(documents(spark, a="1", b="2"), str(tmp_path))
    read = markdown_tree.read_markdown_tree(spark, str(tmp_path))
    (tmp_path / "wiki/a.md").unlink()
    with pytest.raises(Exception, match="a.md"):
        read.collect()


def test_versions_are_read_by_the_names_in_the_manifest(spark, tmp_path):
    tree = markdown_tree.MarkdownTree(spark, f"file://{tmp_path}")
    tree.publish(documents(spark, **{f"{n % 7}/{n}": f"old {n}" for n in range(200)}, empty="", **{"_hidden": "x", "/twice": "x"}))
    tree.publish(documents(spark, **{f"{n % 7}/{n}": f"new {n}" for n in range(0, 200, 2)}))
    (tmp_path / "files/stray").mkdir()
    (tmp_path / "files/stray/x.md").write_text("in no version")
    next((tmp_path / "files").glob("v2_*/wiki/0/0.md")).unlink()
    assert files_the_driver_knows(tree.read()) == []
    assert shown(tree) == {f"{n % 7}/{n}": f"{'old' if n % 2 else 'new'} {n}" for n in range(1, 200)}


def test_documents_without_a_name_are_errors_of_their_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, "lost"), ("wiki/a.md", "kept"), (None, None)], "path string, content string")
    failed = [(None, "failed to write file: it has no name")]
    told = markdown_tree.write_markdown_tree(docs, str(tmp_path / "plain")).collect()
    assert [tuple(r) for r in told if r.error] == failed and [r.path for r in told if not r.error] == ["wiki/a.md"]
    tree = markdown_tree.MarkdownTree(spark, str(tmp_path / "tree"))
    assert [tuple(r) for r in tree.publish(docs).collect() if r.error] == failed
    assert shown(tree) == {"a": "kept"}
    tree.publish(docs, whole=True)
    assert shown(tree) == {"a": "kept"}


def test_names_that_cannot_be_written_are_errors_of_their_rows(spark, tmp_path):
    cut = "é".encode()[:1]
    names = [b"x" * 252 + b".md", "é".encode() * 126 + b".md", b"y" * 256 + b".md", b"a/" + cut + b"/z.md", b"file", b"file/in.md"]
    (tmp_path / "file").write_text("in the way")
    docs = spark.createDataFrame([(n, "text") for n in names], "name binary, content string").selectExpr(
        "CAST(name AS STRING) AS file_path", "content", "'updated' AS status"
    )
    told = markdown_tree.write_markdown_tree(docs, str(tmp_path))
    failed = told.filter("error IS NOT NULL").selectExpr("CAST(path AS BINARY) AS name").collect()
    assert sorted(bytes(r.name) for r in failed) == [b"file/in.md", names[2]]
    written = {os.path.relpath(os.path.join(d, f), os.fsencode(tmp_path)) for d, _, fs in os.walk(os.fsencode(tmp_path)) for f in fs}
    assert written == {names[0], names[1], names[3], b"file"}


def documents(spark, **texts):
    rows = [(f"wiki/{name}.md", text) for name, text in texts.items()]
    return spark.createDataFrame(rows, "path string, content string")


def shown(tree):
    rows = [tuple(r) for r in tree.read().collect()]
    assert len(rows) == len(set(rows))
    return {path.removeprefix("wiki/").removesuffix(".md"): text for path, text in rows}


def test_a_tree_is_published_by_versions(spark, tmp_path):
    tree = markdown_tree.MarkdownTree(spark, str(tmp_path))
    assert shown(tree) == {}
    tree.publish(documents(spark, **{"a": "1", "b": "1", "sub/c d": "é"}))
    tree.publish(documents(spark, a="2", n=None, new="3"))
    again = markdown_tree.MarkdownTree(spark, str(tmp_path))
    assert shown(again) == {"a": "2", "b": "1", "sub/c d": "é", "new": "3"}
    files = {r.path: r.file.split("_")[0] for r in again.manifest().collect()}
    assert files == {"wiki/a.md": "v2", "wiki/b.md": "v1", "wiki/sub/c d.md": "v1", "wiki/new.md": "v2"}
    again.publish(documents(spark, b="4", new="4"), whole=True)
    assert shown(again) == {"b": "4", "new": "4"}


@pytest.mark.parametrize("step", ["commit", "files"])
def test_a_run_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    tree = markdown_tree.MarkdownTree(spark, str(tmp_path))
    tree.publish(documents(spark, a="old", b="old"))

    def broken(*_, **__):
        raise OSError("broken off")

    with monkeypatch.context() as patch:
        if step == "commit":
            patch.setattr(storage.Commits, "commit", broken)
        else:
            patch.setattr(markdown_tree, "write_markdown_tree", broken)
        with pytest.raises(OSError):
            tree.publish(documents(spark, a="new", b="new", c="new"))
    assert shown(tree) == {"a": "old", "b": "old"}
    tree.publish(documents(spark, a="newer"))
    assert shown(tree) == {"a": "newer", "b": "old"}


def test_a_file_that_cannot_be_written_keeps_its_old_text(spark, tmp_path):
    tree = markdown_tree.MarkdownTree(spark, str(tmp_path))
    tree.publish(documents(spark, a="old", **{"x/y": "old"}))
    told = tree.publish(documents(spark, a="new", **{"x" * 260: "new"}), whole=True).collect()
    assert [r.error is None for r in sorted(told)] == [True, False]
    assert shown(tree) == {"a": "new"}
    told = tree.publish(spark.createDataFrame([("wiki/a.md", "newer"), ("wiki/a.md/in.md", "new")], "path string, content string"))
    assert sum(r.error is None for r in told.collect()) == 1


def test_document_table(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a.md", "x", 1), ("b.md", None, 2)], "path string, content string, n int"
    )
    markdown_tree.write_document_table(docs, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("a.md", "x")]


def test_parents_and_presence_are_read_by_their_schemas(spark, tmp_path):
    spark.createDataFrame([(1, "b", "a")], "n int, parent string, child string").write.parquet(str(tmp_path / "parents"))
    parents = snapshots.scan_parents(spark, str(tmp_path / "parents"))
    assert [tuple(r) for r in parents.collect()] == [("a", "b")]
    texts = spark.createDataFrame([("f", "x"), ("g", None)], snapshots.CONTENTS_SCHEMA)
    landed, presence = snapshots.land_contents(texts, str(tmp_path / "landed"))
    assert sorted(tuple(r) for r in landed.collect()) == [("f", "x"), ("g", None)]
    assert [tuple(r) for r in presence.collect()] == [("f", 1)]


def test_snapshots_prune_columns(spark, tmp_path):
    spark.createDataFrame(
        [("f", "N", "m", "p", "t", False, 200)], snapshots.FILES_SCHEMA
    ).write.parquet(str(tmp_path / "files"))
    spark.createDataFrame([("f", "text")], snapshots.CONTENTS_SCHEMA).write.parquet(
        str(tmp_path / "contents")
    )
    files = snapshots.scan_files(spark, str(tmp_path / "files"))
    texts = snapshots.scan_contents(spark, str(tmp_path / "contents"))
    plan = files.join(texts, "file_id").select("name").filter("http_status = 200")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "markdown" not in text and "parent_id" not in text
    assert "EqualTo(http_status,200)" in text
