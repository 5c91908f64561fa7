"""``discover``: seed URLs to an inventory of files and their access status."""

from pyspark.sql import DataFrame

from linkloom.functions.fixed_values import DEFAULT_MAX_DEPTH
from linkloom.operators.crawl import (
    crawl_edges,
    crawl_links_only,
    crawl_through_folders,
    union_records,
)
from linkloom.operators.edge_index import EdgeIndex
from linkloom.operators.links import with_file_id
from linkloom.operators.storage import RunFolder


def discover(
    seeds: DataFrame,
    files: DataFrame,
    contents: DataFrame | None,
    max_depth: int = DEFAULT_MAX_DEPTH,
    crawl_folder_children: bool = False,
    parents: DataFrame | None = None,
    index: EdgeIndex | None = None,
) -> DataFrame:
    """``(file_id, link, title, status, depth, seed_pos, trail)`` of all files found.

    Links in documents are followed up to ``max_depth`` (0 turns that off),
    folders to any nesting. ``parents`` gives ``(child, parent)`` where files lie in
    several folders. With an ``index`` that was updated before, links come from
    there, no text is read and ``contents`` may be left out. Use ``order_discovered``
    to present the rows.
    """
    run = RunFolder(seeds.sparkSession, "discover")
    seeds = with_file_id(seeds, "url")
    crawl = crawl_through_folders if crawl_folder_children else crawl_links_only
    try:
        # At depth 0 no link is followed and no text is read.
        edges = None
        if max_depth > 0:
            edges = crawl_edges(run, files, contents) if index is None else index.edges()
        linked, listed = crawl(run, seeds, files, edges, max_depth, parents)
    finally:
        run.forget_bucketed("edges")
    return union_records(seeds, linked, listed, files)
