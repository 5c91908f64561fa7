"""The document graph: links followed to a depth, folders to their end.

Both closures work on small rows (IDs, depth, position), one written table per
round. Texts are read once, to build the edge table, and metadata is
joined once, at the end: an edge exists only where its source may be expanded,
so the rounds need neither.

What a file was found by has a rank: its seed, its depth, and its ``trail``, the
places of the links that led to it from the seed. A trail is its parent's with
one more place, so trails compare as the parents' ranks do, then by place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.fixed_values import FOLDER
from linkloom.functions.urls import canonical_link
from linkloom.operators.links import document_links
from linkloom.operators.metadata import (
    attach_metadata,
    classify_access,
    live_children,
    readable_folder,
)
from linkloom.operators.storage import RunFolder, numbered

DOCUMENTS_PER_BUCKET = 20_000
#: What a file's place is made of; the least one counts.
PLACE = ("depth", "seed_pos", "trail")


def first_reach(references: DataFrame, order: list[str], kept: list[str]) -> DataFrame:
    """One row per ``file_id``: its first reference, which also gives the link.

    Combines before its shuffle, so a file that everything links to is no
    larger a group than any other.
    """
    first = F.min(F.struct(*order, *kept)).alias("first")
    return references.groupBy("file_id").agg(first).select("file_id", "first.*")


def drop_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen.select("file_id"), "file_id", "left_anti")


def seed_references(seeds: DataFrame) -> DataFrame:
    """``(file_id, seed_pos, link)``; the first seed of a file gives its link."""
    named = seeds.filter(F.col("file_id").isNotNull())
    return first_reach(
        named.select("file_id", "seed_pos", F.col("url").alias("link")),
        ["seed_pos"],
        ["link"],
    )


def no_trail() -> Column:
    return F.array().cast("array<int>")


def _reach(df: DataFrame, depth: int) -> DataFrame:
    trail = F.col("trail") if "trail" in df.columns else no_trail().alias("trail")
    return df.select("file_id", "link", F.lit(depth).alias("depth"), "seed_pos", trail)


def _from_links(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """First reference to every file the frontier links to.

    References are ordered by seed, then by the parent's trail, then by place in the
    parent. Files of one folder share its trail; their IDs decide.
    """
    parents = frontier.select(F.col("file_id").alias("src"), "seed_pos", F.col("trail").alias("before"))
    found = edges.join(parents, "src").select(
        F.col("dst").alias("file_id"), "seed_pos", "before", "src", "pos", F.col("url").alias("link")
    )
    first = first_reach(found, ["seed_pos", "before", "src", "pos"], ["link"])
    return first.withColumn("trail", F.concat("before", F.array(F.col("pos").cast("int"))))


def link_closure(
    run: RunFolder, seeds: DataFrame, edges: DataFrame, max_depth: int
) -> DataFrame:
    """Files reachable over at most ``max_depth`` links, at their least depth.

    ``edges`` is bucketed by source: a small frontier is broadcast to it (by
    its known file size), a large one is shuffled to the buckets, and the edges
    themselves never move. Failed files count as reached, like any other.
    """
    frontier = run.keep(_reach(seed_references(seeds), 0), "reached_0")
    reached = frontier
    for depth in range(1, max_depth + 1):
        new = drop_seen(_from_links(frontier, edges), reached)
        frontier = run.keep(_reach(new, depth), f"reached_{depth}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def parent_edges(files: DataFrame) -> DataFrame:
    """``(child, parent)`` of files that lie in one folder each."""
    return files.filter("parent_id IS NOT NULL").select(
        F.col("file_id").alias("child"), F.col("parent_id").alias("parent")
    )


def folder_tree(run: RunFolder, files: DataFrame, parents: DataFrame | None = None, label: str = "tree") -> DataFrame:
    """``(child, parent, single)``: the folders that folders are entered through, kept as a table.

    Children are folders that are not in the trash and can be read; ``single`` says
    that a child has one parent only.
    """
    entered = live_children(files).filter(readable_folder()).select(F.col("file_id").alias("child"))
    edges = parent_edges(files) if parents is None else parents.select("child", "parent")
    edges = run.keep(
        edges.filter("child <> parent").join(entered, "child", "left_semi").distinct(),
        f"{label}_edges",
    )
    counted = edges.groupBy("child").agg(F.count("*").alias("n"))
    return run.keep(edges.join(counted, "child").select("child", "parent", (F.col("n") == 1).alias("single")), label)


def folder_places(run: RunFolder, roots: DataFrame, tree: DataFrame, label: str = "folders") -> DataFrame:
    """``(folder, place)``: the least place of the roots above each folder, itself included.

    Folders with one parent are closed by pointer jumping: each looks at an ancestor,
    takes the least place seen on the way, and then looks as far again as
    that ancestor does, so a chain of 500 folders takes ten rounds. Folders with several parents
    and those without any end the chains. Between those ends places are
    passed on while some of them improves, one round per nested folder with
    several parents. Cycles end: their places cannot improve for ever.
    """
    place = F.struct(*(c for c in PLACE if c in roots.columns))
    own = run.keep(roots.groupBy(F.col("file_id").alias("folder")).agg(F.min(place).alias("place")), f"{label}_roots")
    if own.isEmpty():
        return own
    chains = tree.filter("single").select(F.col("child").alias("folder"), F.col("parent").alias("ahead"))
    up = run.keep(chains.join(own, "folder", "left").withColumns({"open": F.lit(True), "better": F.lit(True)}), f"{label}_0")
    still_open, rounds = None, 0
    while True:
        rounds += 1
        there = up.select(F.col("folder").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("place").alias("_place"), F.lit(True).alias("_there"))
        looked = up.filter("open").join(there, "ahead", "left")
        better = F.col("_place").isNotNull() & (F.col("place").isNull() | (F.col("_place") < F.col("place")))
        looked = looked.select(
            "folder", F.coalesce("_ahead", "ahead").alias("ahead"), F.when(better, F.col("_place")).otherwise(F.col("place")).alias("place"),
            F.col("_there").isNotNull().alias("open"), better.alias("better"),
        )
        up = run.keep(up.filter("NOT open").unionByName(looked), f"{label}_{rounds}")
        n_open, n_better = up.filter("open").agg(F.count("*"), F.count_if("better")).first()
        if not n_open or (n_open == still_open and not n_better):
            break
        still_open = n_open

    # The ends of chains: folders with several parents, and roots at the top of all.
    several = tree.filter("NOT single").select(F.col("child").alias("folder"), "parent")
    through = up.select(F.col("folder").alias("parent"), "ahead", "place")
    links = run.keep(
        several.join(through, "parent", "left").select("folder", F.coalesce("ahead", "parent").alias("above"), "place"),
        f"{label}_links",
    )
    best = run.keep(
        links.select("folder", "place").filter("place IS NOT NULL").unionByName(own).groupBy("folder").agg(F.min("place").alias("place")),
        f"{label}_best_0",
    )
    frontier, rounds = best, 0
    between = links.select("folder", "above")
    while not links.isEmpty():
        rounds += 1
        passed = between.join(frontier.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(F.min("place").alias("place"))
        known = best.withColumnRenamed("place", "known")
        better = F.col("known").isNull() | (F.col("place") < F.col("known"))
        frontier = run.keep(passed.join(known, "folder", "left").filter(better).drop("known"), f"{label}_frontier_{rounds}")
        if frontier.isEmpty():
            break
        best = run.keep(best.unionByName(frontier).groupBy("folder").agg(F.min("place").alias("place")), f"{label}_best_{rounds}")

    ends = best.select(F.col("folder").alias("ahead"), F.col("place").alias("_place"))
    in_chains = up.join(ends, "ahead", "left").select("folder", F.least("place", "_place").alias("place"))
    return run.keep(
        in_chains.filter("place IS NOT NULL").unionByName(best).groupBy("folder").agg(F.min("place").alias("place")), f"{label}_places"
    )


def folder_closure(
    run: RunFolder,
    roots: DataFrame,
    files: DataFrame,
    label: str = "folders",
    parents: DataFrame | None = None,
    tree: DataFrame | None = None,
) -> DataFrame:
    """All files below the root folders, at any nesting; no trash, no folders.

    ``roots`` has ``file_id, depth, seed_pos`` and perhaps ``trail``; each file gets
    the least of the roots above it. Folders are closed on their own (``folder_places``)
    and the files joined once, to the finished set. ``parents`` gives
    ``(child, parent)`` where files or folders lie in several folders; then a file
    has the least place of all of them. ``tree`` is a ``folder_tree`` made before. A folder
    that cannot be read is not entered.
    """
    if tree is None:
        tree = folder_tree(run, files, parents, f"{label}_tree")
    places = folder_places(run, roots, tree, label)
    shown = live_children(files).filter(F.coalesce(F.col("mime_type") != FOLDER, F.lit(True)))
    if parents is None:
        below = shown.join(places.withColumnRenamed("folder", "parent_id"), "parent_id")
    else:
        within = parents.select("child", "parent").join(places.withColumnRenamed("folder", "parent"), "parent")
        least = within.groupBy(F.col("child").alias("file_id")).agg(F.min("place").alias("place"))
        below = shown.join(least, "file_id")
    return below.select("file_id", "name", "mime_type", "place.*")


def _least(columns=PLACE) -> Column:
    return F.min(F.struct(*columns)).alias("place")


def crawl_edges(
    run: RunFolder, files: DataFrame, contents: DataFrame, documents_per_bucket: int = DOCUMENTS_PER_BUCKET
) -> DataFrame:
    """The link graph, kept bucketed by source document.

    There are as many buckets as shuffle partitions, or fewer when there are
    few documents (their number comes from file footers).
    """
    partitions = int(run.spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(partitions, 1 + contents.count() // documents_per_bucket)
    edges = document_links(contents, files, buckets)
    return run.keep_bucketed(edges, "edges", "src", buckets)


def crawl_links_only(
    run: RunFolder,
    seeds: DataFrame,
    files: DataFrame,
    edges: DataFrame | None,
    max_depth: int,
    parents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Link closure, then one folder closure over the folders it reached."""
    linked = link_closure(run, seeds, edges, max_depth)
    roots = reached_folders(linked, files)
    return linked, folder_closure(run, roots, files, parents=parents)


def crawl_through_folders(
    run: RunFolder,
    seeds: DataFrame,
    files: DataFrame,
    edges: DataFrame | None,
    max_depth: int,
    parents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``crawl_links_only``, but files found in folders are expanded too.

    A file in a folder is expanded at the folder's depth. Being listed never
    keeps a link from being recorded, so a file found both ways has its link.
    The tree of folders is the same for every depth and made once.
    """
    linked = frontier = run.keep(_reach(seed_references(seeds), 0), "reached_0")
    tree = folder_tree(run, files, parents)
    listed = expanded = None
    for depth in range(max_depth + 1):
        roots = reached_folders(frontier, files)
        below = folder_closure(run, roots, files, f"folders_{depth}", parents, tree)
        in_folders = run.keep(below, f"listed_{depth}")
        new_listed = in_folders if listed is None else drop_seen(in_folders, listed)
        listed = in_folders if listed is None else listed.unionByName(new_listed)
        if depth == max_depth:
            break
        place = ("file_id", "seed_pos", "trail")
        either = frontier.select(*place).unionByName(new_listed.select(*place))
        sources = first_reach(either, ["seed_pos", "trail"], [])
        if expanded is not None:
            sources = drop_seen(sources, expanded)
        sources = run.keep(sources, f"sources_{depth}")
        if sources.isEmpty():
            break
        expanded = sources if expanded is None else expanded.unionByName(sources)
        new = drop_seen(_from_links(sources, edges), linked)
        frontier = run.keep(_reach(new, depth + 1), f"reached_{depth + 1}")
        linked = linked.unionByName(frontier)
    return linked, listed


def reached_folders(linked: DataFrame, files: DataFrame) -> DataFrame:
    folders = files.filter(readable_folder()).select("file_id")
    place = [c for c in PLACE if c in linked.columns]
    return linked.join(folders, "file_id", "left_semi").select("file_id", *place)


def union_records(
    seeds: DataFrame, linked: DataFrame, listed: DataFrame, files: DataFrame
) -> DataFrame:
    """All discovered files, one row each, and every unusable seed.

    A file found by link and by folder keeps the link's row, with the lesser
    place of the two. Folders give no row of their own.
    """
    columns = ("file_id", "link", "title", "status", *PLACE)
    metadata = files.select("file_id", "name", "mime_type", "http_status")
    by_link = (
        classify_access(attach_metadata(linked, metadata))
        .filter(~readable_folder())
        .select(*columns, F.lit(0).alias("_tier"))
    )
    by_folder = listed.select(
        "file_id",
        canonical_link(F.col("file_id"), F.col("mime_type")).alias("link"),
        F.col("name").alias("title"),
        F.lit("available").alias("status"),
        *PLACE,
        F.lit(1).alias("_tier"),
    )
    row = F.struct("_tier", "link", "title", "status")
    found = (
        by_link.unionByName(by_folder)
        .groupBy("file_id")
        .agg(F.min(row).alias("row"), _least())
        .select("file_id", "row.link", "row.title", "row.status", "place.*")
    )
    unusable = seeds.filter(F.col("file_id").isNull()).select(
        "file_id", F.col("url").alias("link"), F.lit(0).alias("depth"), "seed_pos", no_trail().alias("trail")
    )
    invalid = classify_access(
        unusable.withColumns(
            {"name": F.lit(""), "http_status": F.lit(None).cast("int")}
        )
    )
    return found.unionByName(invalid.select(*columns))


def in_report_order(discovered: DataFrame) -> DataFrame:
    """Seeds in file order, each followed by what it led to, by depth.

    Within a depth, files come as their parents do, then by place in the parent;
    files of a folder stand at the folder's place, by ID.
    """
    return discovered.orderBy("seed_pos", "depth", "trail", F.col("file_id").asc_nulls_first(), "link")


def order_discovered(discovered: DataFrame) -> DataFrame:
    """The report's rows in order, with their ``position`` from 0 in place of the trail."""
    run = RunFolder(discovered.sparkSession, "report")
    return numbered(run, in_report_order(discovered), "position").drop("trail").orderBy("position")
