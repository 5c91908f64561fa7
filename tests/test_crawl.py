"""Link closure, folder closure and the discovery pipeline."""

import importlib
import random

import pytest

from linkloom import discover
from linkloom.operators import crawl, storage
from linkloom.operators.links import with_file_id
from linkloom.operators.metadata import attach_metadata, classify_access

discover_plan = importlib.import_module("linkloom.plans.discover")

DOC = "application/vnd.google-apps.document"
FOLDER = "application/vnd.google-apps.folder"
FILES = (
    "file_id string, name string, mime_type string, parent_id string, "
    "modified_time string, trashed boolean, http_status int"
)


def url(file_id):
    return f"https://docs.google.com/document/d/{file_id}/edit"


def file(file_id, mime=DOC, parent=None, trashed=False, status=200):
    return (file_id, f"Name {file_id}", mime, parent, "t", trashed, status)


def tables(spark, seeds, files, texts):
    return (
        spark.createDataFrame(list(enumerate(seeds)), "seed_pos long, url string"),
        spark.createDataFrame(files, FILES),
        spark.createDataFrame(list(texts.items()), "file_id string, markdown string"),
    )


def rows(df):
    return {
        (r.file_id, r.link, r.title, r.status, r.depth, r.seed_pos) for r in df.collect()
    }


def ids(df):
    return {r.file_id for r in df.collect()}


def test_statuses_and_titles(spark):
    refs = spark.createDataFrame(
        [("a", "u1"), ("b", "u2"), ("c", "u3"), ("d", "u4"), ("e", "u5"), (None, "bad")],
        "file_id string, link string",
    )
    codes = [("a", 200), ("b", 404), ("c", 403), ("d", 400), ("e", 500)]
    files = spark.createDataFrame([file(i, status=s) for i, s in codes], FILES)
    more = refs.unionByName(
        spark.createDataFrame([("gone", "u6")], "file_id string, link string")
    )
    known = classify_access(attach_metadata(more, files))
    assert {(r.link, r.title, r.status) for r in known.collect()} == {
        ("u1", "Name a", "available"),
        ("u2", "b", "deleted"),
        ("u3", "c", "permission_denied"),
        ("u4", "d", "invalid"),
        ("u5", "e", "error"),
        ("u6", "gone", "deleted"),
        ("bad", "INVALID_URL", "invalid"),
    }


def test_links_are_followed_to_the_depth(spark):
    chain = [f"n{i}" for i in range(9)]
    texts = {a: f"go {url(b)} on" for a, b in zip(chain, chain[1:])}
    seeds, files, contents = tables(spark, [url("n0")], [file(n) for n in chain], texts)
    seeds = with_file_id(seeds, "url")
    edges = crawl.crawl_edges(storage.RunFolder(spark, "edges"), files, contents)
    for depth, reached in ((0, 1), (1, 2), (3, 4), (20, 9)):
        run = storage.RunFolder(spark, "test")
        found = crawl.link_closure(run, seeds, edges, depth)
        assert {(r.file_id, r.depth) for r in found.collect()} == {
            (n, i) for i, n in enumerate(chain[:reached])
        }


def test_default_depth_is_five(spark):
    texts = {f"n{i}": url(f"n{i + 1}") for i in range(9)}
    files = [file(f"n{i}") for i in range(9)]
    assert len(ids(discover(*tables(spark, [url("n0")], files, texts)))) == 6


def test_seeds_keep_their_urls_and_come_once(spark):
    other = "https://drive.google.com/file/d/a/view"
    texts = {"a": f"{url('b')}?x", "b": url("a")}
    found = discover(
        *tables(
            spark,
            [other, "nonsense", url("a"), url("b") + "#b", "nonsense"],
            [file("a"), file("b")],
            texts,
        )
    )
    assert sorted(rows(found), key=lambda r: r[5]) == [
        ("a", other, "Name a", "available", 0, 0),
        (None, "nonsense", "INVALID_URL", "invalid", 0, 1),
        ("b", url("b") + "#b", "Name b", "available", 0, 3),
        (None, "nonsense", "INVALID_URL", "invalid", 0, 4),
    ]


def test_first_reference_gives_the_link(spark):
    texts = {
        "s0": f"{url('x')}?from=s0&n=1 {url('x')}?from=s0&n=2",
        "s1": f"{url('x')}?from=s1 {url('y')}",
        "y": f"{url('x')}?from=y",
    }
    files = [file(n) for n in ("s0", "s1", "x", "y")]
    found = rows(discover(*tables(spark, [url("s1"), url("s0")], files, texts)))
    assert ("x", url("x") + "?from=s1", "Name x", "available", 1, 0) in found


def test_failed_files_are_reported_and_not_expanded(spark):
    texts = {"a": f"{url('secret')} {url('absent')}", "secret": url("hidden")}
    files = [file("a"), file("secret", status=403), file("hidden")]
    found = rows(discover(*tables(spark, [url("a")], files, texts)))
    assert {(r[0], r[2], r[3]) for r in found} == {
        ("a", "Name a", "available"),
        ("secret", "secret", "permission_denied"),
        ("absent", "absent", "deleted"),
    }


def folder_tree():
    return [
        file("top", FOLDER),
        file("sub", FOLDER, "top"),
        file("deep", FOLDER, "sub"),
        file("bin", FOLDER, "top", trashed=True),
        file("loop", FOLDER, "loop"),
        file("f1", DOC, "top"),
        file("f2", "image/png", "sub"),
        file("f3", DOC, "deep", status=403),
        file("f4", DOC, "deep", trashed=True),
        file("f5", DOC, "bin"),
        file("f6", DOC, "loop"),
        file("outside", DOC, "elsewhere"),
    ]


def test_folders_are_listed_to_the_end(spark):
    seed = "https://drive.google.com/drive/folders/top"
    found = rows(discover(*tables(spark, [seed], folder_tree(), {"f1": url("outside")})))
    assert found == {
        ("f1", url("f1"), "Name f1", "available", 0, 0),
        ("f2", "https://drive.google.com/file/d/f2/view", "Name f2", "available", 0, 0),
        ("f3", url("f3"), "Name f3", "available", 0, 0),
    }


def test_folders_that_cannot_be_read_are_not_entered(spark):
    seed = "https://drive.google.com/drive/folders/top"
    files = [file("top", FOLDER), file("shut", FOLDER, "top", status=403), file("below", FOLDER, "shut")]
    files += [file("a", DOC, "top"), file("b", DOC, "shut"), file("c", DOC, "below")]
    assert ids(discover(*tables(spark, [seed], files, {"a": "x"}))) == {"a"}


def test_no_text_is_read_at_depth_0(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("texts were read")

    monkeypatch.setattr(discover_plan, "crawl_edges", unwanted)
    data = tables(spark, [url("a")], [file("a"), file("b")], {"a": url("b")})
    for through in (False, True):
        assert ids(discover(*data, max_depth=0, crawl_folder_children=through)) == {"a"}


def test_place_comes_from_one_reference(spark):
    """A link of an early seed and a nearer folder of a later one."""
    seeds = [url("s"), "https://drive.google.com/drive/folders/top"]
    files = [file("s"), file("top", FOLDER), file("f", DOC, "top")]
    found = rows(discover(*tables(spark, seeds, files, {"s": url("f")})))
    assert ("f", url("f"), "Name f", "available", 0, 1) in found


def test_folder_cycles_end(spark):
    run = storage.RunFolder(spark, "test")
    files = [file("x", FOLDER, "y"), file("y", FOLDER, "x"), file("d", DOC, "y")]
    roots = spark.createDataFrame([("x", 3, 1)], "file_id string, depth int, seed_pos long")
    found = crawl.folder_closure(run, roots, spark.createDataFrame(files, FILES))
    assert [(r.file_id, r.depth, r.seed_pos) for r in found.collect()] == [("d", 3, 1)]


def test_nested_roots_give_the_least_place(spark):
    """A far root with a lesser place beats a near one."""
    run = storage.RunFolder(spark, "test")
    files = [file("r", FOLDER)]
    files += [file(f"k{i}", FOLDER, f"k{i - 1}" if i else "r") for i in range(6)]
    files += [file(f"d{i}", DOC, f"k{i}") for i in range(6)]
    roots = spark.createDataFrame(
        [("r", 1, 5), ("k2", 2, 0), ("k4", 0, 9)],
        "file_id string, depth int, seed_pos long",
    )
    found = crawl.folder_closure(run, roots, spark.createDataFrame(files, FILES))
    got = {r.file_id: (r.depth, r.seed_pos) for r in found.collect()}
    assert got == {f"d{i}": (1, 5) if i < 4 else (0, 9) for i in range(6)}


def test_linked_folder_and_file_found_both_ways(spark):
    texts = {
        "s": f"https://drive.google.com/drive/folders/top {url('m')}",
        "m": url("f1") + "?via=m",
    }
    files = folder_tree() + [file("s"), file("m")]
    found = rows(discover(*tables(spark, [url("s")], files, texts)))
    # the link's row, at the folder's lesser depth
    assert ("f1", url("f1") + "?via=m", "Name f1", "available", 1, 0) in found
    assert {r[0] for r in found} == {"s", "m", "f1", "f2", "f3"}


def test_folder_children_are_crawled_on_request(spark):
    seed = "https://drive.google.com/drive/folders/top"
    texts = {"f1": url("outside"), "outside": url("far"), "far": url("farther")}
    files = folder_tree() + [file("far"), file("farther")]
    data = tables(spark, [seed], files, texts)
    plain = ids(discover(*data, max_depth=2))
    crawled = discover(*data, max_depth=2, crawl_folder_children=True)
    depths = {r.file_id: r.depth for r in crawled.collect()}
    assert plain == {"f1", "f2", "f3"}
    assert depths == {"f1": 0, "f2": 0, "f3": 0, "outside": 1, "far": 2}


def brute_force(seeds, edges, depth):
    best = {s: 0 for s in seeds}
    frontier = set(seeds)
    for level in range(1, depth + 1):
        frontier = {b for a, b in edges if a in frontier} - best.keys()
        best.update((n, level) for n in frontier)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_against_brute_force(spark, seed):
    """A dense graph with one node that everything links to."""
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(120)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(200)}
    edges |= {(n, "n0") for n in nodes}
    edges = {(a, b) for a, b in edges if a != b}
    texts = {n: " ".join(url(b) for a, b in sorted(edges) if a == n) for n in nodes}
    seeds = rng.sample(nodes[1:], 3)
    found = discover(
        *tables(spark, [url(s) for s in seeds], [file(n) for n in nodes], texts),
        max_depth=3,
    )
    assert {r.file_id: r.depth for r in found.collect()} == brute_force(seeds, edges, 3)


def test_edges_are_not_shuffled_per_round(spark):
    run = storage.RunFolder(spark, "test")
    nodes = [f"n{i}" for i in range(40)]
    files = spark.createDataFrame([file(n) for n in nodes], FILES)
    contents = spark.createDataFrame(
        [(n, url("n1")) for n in nodes], "file_id string, markdown string"
    )
    edges = crawl.crawl_edges(run, files, contents, documents_per_bucket=15)
    frontier = spark.createDataFrame([("n2", 0)], "file_id string, seed_pos long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = edges.join(frontier.withColumnRenamed("file_id", "src"), "src")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    run.forget_bucketed("edges")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SelectedBucketsCount: 3 out of 3" in plan


def test_presentation_order(spark):
    texts = {"b": url("c")}
    data = tables(spark, [url("b"), url("a")], [file(n) for n in "abc"], texts)
    ordered = crawl.order_discovered(discover(*data)).collect()
    assert [r.file_id for r in ordered] == ["b", "c", "a"]


def below(roots, edges, folders, shut):
    """Least place of each folder and file under the roots, by walking every path."""
    children = {}
    for child, parent in edges:
        children.setdefault(parent, set()).add(child)
    best = {}
    for root, place in roots:
        waiting, entered = [root], {root}
        while waiting:
            folder = waiting.pop()
            for child in children.get(folder, ()):
                if child not in folders:
                    best[child] = min(best.get(child, place), place)
                elif child not in shut and child not in entered:
                    entered.add(child)
                    waiting.append(child)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_files_in_several_folders_against_brute_force(spark, seed):
    """Random folder graphs with cycles, unreadable folders and files in many places."""
    rng = random.Random(seed)
    folders = [f"k{i}" for i in range(50)]
    docs = [f"d{i}" for i in range(60)]
    shut = set(rng.sample(folders, 5))
    several = 0.3 if seed % 2 else 0.05
    edges = set()
    for i, name in enumerate(folders):
        for _ in range(2 if rng.random() < several else 1):
            above = rng.randrange(max(0, i - 4), i + 1) if rng.random() < 0.9 else rng.randrange(50)
            edges.add((name, folders[above]))
    for name in docs:
        edges |= {(name, rng.choice(folders)) for _ in range(rng.choice([1, 1, 2, 3]))}
    edges |= {("k9", "k9"), ("d0", "absent")}
    roots = [(n, (rng.randrange(3), rng.randrange(9))) for n in rng.sample(folders, 6)] + [("absent", (2, 9))]
    files = [file(n, FOLDER, status=403 if n in shut else 200) for n in folders] + [file(n) for n in docs]
    found = crawl.folder_closure(
        storage.RunFolder(spark, "test"),
        spark.createDataFrame([(n, *p) for n, p in roots], "file_id string, depth int, seed_pos long"),
        spark.createDataFrame(files, FILES),
        parents=spark.createDataFrame(sorted(edges) + sorted(edges)[:5], "child string, parent string"),
    ).collect()
    got = {r.file_id: (r.depth, r.seed_pos) for r in found}
    assert len(got) == len(found)
    assert got == below(roots, edges, set(folders), shut)


def test_file_in_two_folders_has_the_least_place_of_both(spark):
    files = [file("a", FOLDER), file("b", FOLDER), file("f")]
    seeds = ["https://drive.google.com/drive/folders/a", "https://drive.google.com/drive/folders/b"]
    parents = spark.createDataFrame([("f", "b"), ("f", "a")], "child string, parent string")
    found = discover(*tables(spark, seeds, files, {"x": ""}), parents=parents)
    assert [(r.file_id, r.seed_pos) for r in found.collect()] == [("f", 0)]


def test_long_chains_of_folders_take_few_rounds(spark):
    files = [file(f"k{i}", FOLDER, f"k{i - 1}" if i else None) for i in range(500)]
    files += [file("last", DOC, "k499"), file("middle", DOC, "k250")]
    kept = []

    class Counting(storage.RunFolder):
        def keep(self, df, table):
            kept.append(table)
            return super().keep(df, table)

    roots = spark.createDataFrame([("k0", 1, 4), ("k300", 0, 9)], "file_id string, depth int, seed_pos long")
    found = crawl.folder_closure(Counting(spark, "test"), roots, spark.createDataFrame(files, FILES), "x")
    assert {(r.file_id, r.depth, r.seed_pos) for r in found.collect()} == {("last", 0, 9), ("middle", 1, 4)}
    rounds = [t for t in kept if t.removeprefix("x_").isdigit()]
    assert len(rounds) <= 12, kept


def test_report_follows_seeds_depths_parents_and_places(spark):
    """b and a are linked from s in this order; so c (of b) comes before h and g (of a)."""
    texts = {"s": f"{url('b')} {url('a')}", "b": url("c"), "a": f"{url('h')} {url('g')} {url('c')}", "t": url("z")}
    top = "https://drive.google.com/drive/folders/top"
    files = [file(n) for n in "stabchgz"] + [file("top", FOLDER), file("y", DOC, "top"), file("x", DOC, "top")]
    found = discover(*tables(spark, [url("t"), "nonsense", url("s"), top], files, texts))
    ordered = crawl.order_discovered(found).collect()
    assert [r.file_id for r in ordered] == ["t", "z", None, "s", "b", "a", "c", "h", "g", "x", "y"]
    assert [r.position for r in ordered] == list(range(11)) and "trail" not in ordered[0].asDict()


def test_rows_are_numbered_across_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("(id * 7919) % 1000 AS x").orderBy("x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = storage.numbered(storage.RunFolder(spark, "test"), rows, "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.x, r.n) for r in got) == [(i, i) for i in range(1000)]
    assert storage.numbered(storage.RunFolder(spark, "test"), rows.filter("x < 0"), "n").collect() == []


def test_seed_ids_come_from_urls(spark):
    seeds = spark.createDataFrame([(4, url("a")), (2, url("a")), (1, "x")], "seed_pos long, url string")
    refs = crawl.seed_references(with_file_id(seeds, "url")).collect()
    assert [(r.file_id, r.seed_pos) for r in refs] == [("a", 2)]
