"""Every operator as a query over one directory of test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.fixtures import Fixtures
from linkloom.functions.frontmatter import parse_front_matter
from linkloom.functions.naming import tag_list
from linkloom.functions.urls import canonical_link, repair_urls
from linkloom.operators import crawl, inventory, links, metadata, paths, publish
from linkloom.operators import rewrite, summaries
from linkloom.operators.edge_index import EdgeIndex
from linkloom.operators.changes import order_files
from linkloom.operators.storage import RunFolder, numbered
from linkloom.plans.convert import convert, file_facts, plan_conversion
from linkloom.plans.discover import discover
from linkloom.plans.sync import sync
from linkloom.sources.csv_files import read_inventory, read_seeds, write_discovery
from linkloom.sources.markdown_tree import MarkdownTree, read_markdown_tree, write_markdown_tree

BASE = "./wiki/../wiki"


def seed_ids(fx: Fixtures) -> DataFrame:
    listed = fx.inventory.select(F.col("rec_pos").alias("seed_pos"), F.col("link").alias("url"))
    return links.with_file_id(fx.seeds.unionByName(listed), "url")


def canonical_links(fx: Fixtures) -> DataFrame:
    link = canonical_link(F.col("file_id"), F.col("mime_type"))
    return fx.files.select("file_id", "mime_type", link.alias("link"))


def repaired_text(fx: Fixtures) -> DataFrame:
    return fx.contents.select("file_id", repair_urls(F.col("markdown")).alias("text"))


def link_edges(fx: Fixtures) -> DataFrame:
    return links.document_links(fx.contents, fx.files)


def link_counts(fx: Fixtures) -> DataFrame:
    """How often each file is linked to, most linked first."""
    return (
        link_edges(fx)
        .groupBy("dst")
        .agg(F.count("*").alias("links"), F.min("pos").alias("first_pos"))
        .orderBy(F.desc("links"), "dst")
    )


def access_status(fx: Fixtures) -> DataFrame:
    refs = links.with_file_id(fx.seeds, "url").select("file_id", F.col("url").alias("link"))
    targets = links.extract_links(fx.contents).select(
        F.col("dst").alias("file_id"), F.col("url").alias("link")
    )
    known = metadata.attach_metadata(refs.unionByName(targets), fx.files)
    return metadata.classify_access(known).select("file_id", "link", "title", "status")


def _routed(fx: Fixtures) -> DataFrame:
    records = links.with_file_id(fx.inventory)
    facts = file_facts(fx.files, fx.contents, records, fx.presence)
    return publish.require_content(
        publish.route_documents(metadata.attach_metadata(records, facts))
    )


def document_routes(fx: Fixtures) -> DataFrame:
    return publish.document_kind(_routed(fx)).select("rec_pos", "route", "kind", "error")


def tag_counts(fx: Fixtures) -> DataFrame:
    tags = fx.inventory.select(F.explode(tag_list(F.col("tags"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("records"))


def _planned(fx: Fixtures) -> DataFrame:
    return paths.plan_paths(inventory.with_placement(fx.inventory), BASE)


def output_paths(fx: Fixtures) -> DataFrame:
    return _planned(fx).select("rec_pos", "path")


def unique_paths(fx: Fixtures) -> DataFrame:
    planned = _planned(fx).select("rec_pos", "path")
    return paths.unique_paths(RunFolder(fx.spark, "paths").keep(planned, "planned"))


def _kept_index(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    run = RunFolder(fx.spark, "index")
    index = run.keep(inventory.link_index(fx.inventory), "index")
    return index, run.keep(inventory.url_overrides(index), "overrides")


def link_index(fx: Fixtures) -> DataFrame:
    return inventory.link_index(fx.inventory).select(
        "key", "rec_pos", "link", "title", "record_id"
    )


def resolved_links(fx: Fixtures) -> DataFrame:
    found = inventory.resolve_targets(
        rewrite.markdown_links(fx.contents), *_kept_index(fx), fields=("rec_pos",)
    )
    return found.select("file_id", "pos", "url", "dst", F.col("target.rec_pos").alias("rec_pos"))


def relative_paths(fx: Fixtures) -> DataFrame:
    index, overrides = _kept_index(fx)
    sources = index.select(F.col("key").alias("file_id"), F.col("dirs").alias("source_dirs"))
    found = inventory.resolve_targets(
        rewrite.markdown_links(fx.contents), index, overrides, fields=("dirs", "file_name")
    )
    pairs = (
        found.filter(F.col("target").isNotNull())
        .select(
            "file_id",
            "pos",
            F.col("target.dirs").alias("target_dirs"),
            F.col("target.file_name").alias("target_file"),
        )
        .join(sources, "file_id")
    )
    return paths.relative_paths(pairs).select("file_id", "pos", "relative_path")


def rewritten_docs(fx: Fixtures) -> DataFrame:
    index, overrides = _kept_index(fx)
    sources = index.select(F.col("key").alias("file_id"), "dirs")
    targets = rewrite.link_targets(rewrite.markdown_links(fx.contents), index, overrides)
    docs = (
        sources.join(targets, "file_id", "left")
        .join(fx.contents.select("file_id", "markdown"), "file_id")
    )
    return rewrite.rewritten_text(docs).select("file_id", "text")


def conversion_plan(fx: Fixtures) -> DataFrame:
    plan = plan_conversion(fx.inventory, fx.files, None, BASE, fx.presence)
    return plan.select("rec_pos", "route", "error", "path")


def _converted(fx: Fixtures) -> DataFrame:
    return convert(fx.inventory, fx.files, fx.contents, BASE, presence=fx.presence)


def published_docs(fx: Fixtures) -> DataFrame:
    return _converted(fx).select("rec_pos", "route", "error", "path", "content")


def published_unrepaired(fx: Fixtures) -> DataFrame:
    docs = convert(fx.inventory, fx.files, fx.contents, BASE, repair=False)
    return docs.select("rec_pos", "route", "error", "path", "content")


def published_unique_links(fx: Fixtures) -> DataFrame:
    docs = convert(fx.inventory, fx.files, fx.contents, BASE, link_to_unique=True)
    return docs.select("rec_pos", "route", "error", "path", "content")


def convert_summary(fx: Fixtures) -> DataFrame:
    return summaries.convert_summary(_converted(fx))


def folder_closure(fx: Fixtures, parents: DataFrame | None = None) -> DataFrame:
    run = RunFolder(fx.spark, "folder_closure")
    seeds = crawl.seed_references(links.with_file_id(fx.seeds, "url"))
    roots = crawl.reached_folders(seeds.withColumn("depth", F.lit(0)), fx.files)
    found = crawl.folder_closure(run, roots, fx.files, parents=parents)
    return found.select("file_id", "name", "depth", "seed_pos")


def folder_closure_shared(fx: Fixtures) -> DataFrame:
    """Where documents and folders lie in several folders."""
    return folder_closure(fx, fx.parents)


def link_closure(fx: Fixtures) -> DataFrame:
    run = RunFolder(fx.spark, "link_closure")
    edges = crawl.crawl_edges(run, fx.files, fx.contents)
    seeds = links.with_file_id(fx.seeds, "url")
    reached = crawl.link_closure(run, seeds, edges, 5)
    run.forget_bucketed("edges")
    trail = F.array_join(F.col("trail").cast("array<string>"), ".")
    return reached.withColumn("trail", trail)


def discovered(fx: Fixtures) -> DataFrame:
    return crawl.order_discovered(discover(fx.seeds, fx.files, fx.contents))


def discovered_seeds_only(fx: Fixtures) -> DataFrame:
    return crawl.order_discovered(discover(fx.seeds, fx.files, fx.contents, max_depth=0))


def discovered_through_folders(fx: Fixtures) -> DataFrame:
    found = discover(fx.seeds, fx.files, fx.contents, crawl_folder_children=True)
    return crawl.order_discovered(found)


def discovered_shared(fx: Fixtures) -> DataFrame:
    """Where documents and folders lie in several folders."""
    return crawl.order_discovered(discover(fx.seeds, fx.files, fx.contents, parents=fx.parents))


def discovered_again(fx: Fixtures) -> DataFrame:
    """From a stored index that held an earlier snapshot: other texts, other files."""
    number = F.coalesce(F.substring("file_id", 4, 22).try_cast("long"), F.lit(1))  # folders stay
    rewritten, added = number % 5 == 0, number % 7 == 3
    earlier = fx.files.withColumn("modified_time", F.when(rewritten, "earlier").otherwise(F.col("modified_time")))
    other_links = F.replace("markdown", F.lit("/document/d/doc"), F.lit("/document/d/old"))
    texts = fx.contents.select("file_id", F.when(rewritten, other_links).otherwise(F.col("markdown")).alias("markdown"))
    index = EdgeIndex(fx.spark, RunFolder(fx.spark, "edge_index").path)
    index.update(earlier.filter(~added), texts.filter(~added))
    discover(fx.seeds, earlier, None, max_depth=1, index=index)
    index.update(fx.files, fx.contents)
    return crawl.order_discovered(discover(fx.seeds, fx.files, None, index=index))


def status_counts(fx: Fixtures) -> DataFrame:
    return summaries.discovery_summary(discover(fx.seeds, fx.files, fx.contents))


def front_matter(fx: Fixtures) -> DataFrame:
    return parse_front_matter(fx.md_files).select(
        "path",
        "parse_error",
        F.sha2("body", 256).alias("body_hash"),
        F.explode_outer("front_matter").alias("key", "value"),
    )


def _synced(fx: Fixtures) -> DataFrame:
    return sync(fx.md_files, fx.inventory, fx.files, fx.contents, presence=fx.presence)


def sync_results(fx: Fixtures) -> DataFrame:
    return _synced(fx).drop("content")


def sync_rewritten(fx: Fixtures) -> DataFrame:
    changed = _synced(fx).filter(F.col("status") == "updated")
    return changed.select("file_path", "content")


def _tree(fx: Fixtures) -> MarkdownTree:
    return MarkdownTree(fx.spark, RunFolder(fx.spark, "tree").path)


def published_tree(fx: Fixtures) -> DataFrame:
    """Written as files and read back; file systems refuse names of more than 255 bytes."""
    tree = _tree(fx)
    tree.publish(_converted(fx))
    return tree.read()


def synced_tree(fx: Fixtures) -> DataFrame:
    """The earlier tree as files, brought in step, read back."""
    tree = _tree(fx)
    tree.publish(fx.md_files)
    tree.publish(sync(tree.read(), fx.inventory, fx.files, fx.contents, presence=fx.presence))
    return tree.read()


def plain_tree(fx: Fixtures) -> DataFrame:
    """Written without versions and read back."""
    folder = RunFolder(fx.spark, "plain_tree").path
    write_markdown_tree(fx.md_files, folder)
    files = read_markdown_tree(fx.spark, folder)
    return files.select(F.regexp_extract("path", "wiki/.*", 0).alias("path"), "content")


def reported(fx: Fixtures) -> DataFrame:
    """The discovery report, written as CSV files and read back as seeds."""
    folder = RunFolder(fx.spark, "report").path
    write_discovery(discover(fx.seeds, fx.files, fx.contents), folder)
    return read_seeds(fx.spark, folder)


def listed_inventory(fx: Fixtures) -> DataFrame:
    """The inventory, written as CSV files of two layouts and read back."""
    folder = RunFolder(fx.spark, "inventory").path
    late = F.col("tags").contains("toxic") | (F.col("frag1") == "labelled")
    for name, rows, columns in (
        ("a", fx.inventory.filter(~late), ("link", "title", "tags", "frag1", "frag2", "frag3", "frag4", "frag5")),
        ("b", fx.inventory.filter(late), ("frag3", "Title", "tags", "frag1", "LINK")),
    ):
        sorted_rows = rows.orderBy("rec_pos").select(*(F.col(c.lower()).alias(c) for c in columns))
        sorted_rows.write.options(header=True, quote='"', escape='"', emptyValue="").csv(f"{folder}/{name}")
    return read_inventory(fx.spark, f"{folder}/*")


def ordered_sync(fx: Fixtures) -> DataFrame:
    """Results of sync as they are presented, with their place."""
    run = RunFolder(fx.spark, "ordered")
    return numbered(run, order_files(_synced(fx).select("file_path", "status")), "position")


def sync_summary(fx: Fixtures) -> DataFrame:
    return summaries.sync_summary(_synced(fx))


_QUERIES = (
    seed_ids,
    canonical_links,
    repaired_text,
    link_edges,
    link_counts,
    access_status,
    document_routes,
    tag_counts,
    output_paths,
    unique_paths,
    link_index,
    resolved_links,
    relative_paths,
    rewritten_docs,
    conversion_plan,
    published_docs,
    published_unrepaired,
    published_unique_links,
    convert_summary,
    folder_closure,
    folder_closure_shared,
    link_closure,
    discovered,
    discovered_seeds_only,
    discovered_through_folders,
    discovered_shared,
    discovered_again,
    status_counts,
    front_matter,
    sync_results,
    sync_rewritten,
    sync_summary,
    published_tree,
    synced_tree,
    plain_tree,
    reported,
    listed_inventory,
    ordered_sync,
)


def over_views() -> dict[str, Callable[[Fixtures], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(query):
        return lambda spark, sf_dir: query(Fixtures(spark, sf_dir))

    return {query.__name__: over(query) for query in _QUERIES}
