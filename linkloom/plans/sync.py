"""``sync``: published Markdown files brought in step with their sources."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.frontmatter import (
    compose_body,
    content_hash,
    final_document,
    rebuild_front_matter,
)
from linkloom.operators.changes import detect_changes, read_headers
from linkloom.operators.inventory import link_index, url_overrides
from linkloom.operators.metadata import attach_metadata
from linkloom.operators.rewrite import (
    link_targets,
    markdown_links,
    rewritten_text,
    texts_of,
)
from linkloom.operators.skew import measure_spread
from linkloom.operators.storage import RunFolder
from linkloom.plans.convert import file_facts

_RESULT = ("file_path", "status", "error", "old_hash", "new_hash", "content_length")


def sync(
    md_files: DataFrame,
    inventory: DataFrame,
    files: DataFrame,
    contents: DataFrame,
    repair: bool = True,
    presence: DataFrame | None = None,
) -> DataFrame:
    """One row per file: what happened to it, and the new ``content`` if changed.

    Files are judged by their front matter and by metadata alone (with ``presence``,
    see ``land_contents``, no text column is searched for nulls); texts are
    fetched for changed files only. Headers and decisions are written to the
    run folder before any text is fetched. Nothing is overwritten here: write the changed
    rows with a sink, to a new version of the tree or over the old files.
    """
    run = RunFolder(md_files.sparkSession, "sync")
    index = run.keep(link_index(inventory), "index")
    overrides = run.keep(url_overrides(index), "overrides")

    records = index.select(F.col("key").alias("file_id"), "rec_pos", "dirs")
    headers = run.keep(
        read_headers(md_files).withColumnRenamed("path", "file_path"), "headers"
    )
    facts = file_facts(files, contents, headers, presence)
    facts = facts.join(records, "file_id", "left")
    spread = measure_spread(run, headers, "file_id")
    known = attach_metadata(headers, facts, spread, row_id="file_path")
    judged = run.keep(detect_changes(known), "judged")

    changed = judged.filter(F.col("status") == "updated")
    texts = texts_of(run, contents.select("file_id", "markdown"), changed)
    links = markdown_links(texts, repair)
    resolved = link_targets(links, index, overrides)
    documents = (
        changed.join(spread.copies(resolved), spread.keys, "left")
        .join(spread.copies(texts), spread.keys)
    )
    updated = _updated(rewritten_text(documents, repair))
    kept = judged.filter(F.col("status") != "updated").withColumns(
        {
            "content": F.lit(None).cast("string"),
            "content_length": F.lit(0).cast("long"),
        }
    )
    columns = (*_RESULT, "content")
    return updated.select(*columns).unionByName(kept.select(*columns))


def _updated(documents: DataFrame) -> DataFrame:
    header = rebuild_front_matter(
        F.col("front_matter"),
        {
            "hash-gdrive": F.col("modified_time"),
            "hash-content": content_hash(F.col("_body")),
        },
    )
    return (
        documents.withColumn("_body", compose_body(F.col("link"), F.col("text")))
        .withColumn("content", final_document(header, F.col("_body")))
        .withColumn("content_length", F.octet_length("content").cast("long"))
    )
