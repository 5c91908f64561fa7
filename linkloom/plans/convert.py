"""``convert``: inventory and document texts to Markdown documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.inventory import link_index, url_overrides, with_placement
from linkloom.operators.metadata import attach_metadata
from linkloom.operators.paths import plan_paths, unique_paths
from linkloom.operators.publish import (
    render_documents,
    render_stubs,
    require_content,
    route_documents,
)
from linkloom.operators.rewrite import (
    link_targets,
    markdown_links,
    rewritten_text,
    texts_of,
)
from linkloom.operators.skew import Spread, measure_spread
from linkloom.operators.storage import RunFolder
from linkloom.sources.snapshots import text_presence

METADATA = ("file_id", "mime_type", "modified_time", "http_status")
_RESULT = ("rec_pos", "link", "title", "file_id", "route", "error", "path", "content")


def file_facts(
    files: DataFrame, contents: DataFrame, wanted: DataFrame, presence: DataFrame | None = None
) -> DataFrame:
    """Metadata of each file, whether its text is there and how many ``texts`` there are.

    Only files with their ID in ``wanted`` are looked at, so that a few records do
    not shuffle the whole snapshot. With ``presence`` (see ``land_contents``) no
    text is read; without it the text column is searched for nulls. A missing
    revision is the empty one.
    """
    ids = wanted.select("file_id").distinct()
    files = files.join(ids, "file_id", "left_semi")
    if presence is None:
        presence = text_presence(contents.join(ids, "file_id", "left_semi"))
    else:
        presence = presence.filter("texts > 0").join(ids, "file_id", "left_semi")
    present = presence.select("file_id", "texts", F.lit(True).alias("has_content"))
    revision = F.coalesce("modified_time", F.lit("")).alias("modified_time")
    known = files.select(*(revision if c == "modified_time" else c for c in METADATA))
    return known.join(present, "file_id", "left")


def _planned(
    run: RunFolder,
    inventory: DataFrame,
    files: DataFrame,
    contents: DataFrame,
    base: str,
    presence: DataFrame | None,
) -> tuple[DataFrame, DataFrame, Spread]:
    records = run.keep(with_placement(inventory), "records")
    named = records.withColumnRenamed("record_id", "file_id")
    spread = measure_spread(run, named, "file_id")
    facts = file_facts(files, contents, named, presence)
    known = attach_metadata(named, facts, spread)
    routed = run.keep(
        plan_paths(require_content(route_documents(known)), base), "routed"
    )
    ok = F.col("route") != "error"
    failed = routed.filter(~ok).withColumn("path", F.lit(None).cast("string"))
    return records, unique_paths(routed.filter(ok)).unionByName(failed), spread


def plan_conversion(
    inventory: DataFrame,
    files: DataFrame,
    contents: DataFrame | None,
    base: str = "./output",
    presence: DataFrame | None = None,
) -> DataFrame:
    """Dry run: route, error and final path of every record, without texts.

    Records that fail take no path. With ``presence`` the texts are not looked at,
    and ``contents`` may be left out.
    """
    run = RunFolder(inventory.sparkSession, "plan")
    return _planned(run, inventory, files, contents, base, presence)[1]


def convert(
    inventory: DataFrame,
    files: DataFrame,
    contents: DataFrame,
    base: str = "./output",
    repair: bool = True,
    link_to_unique: bool = False,
    presence: DataFrame | None = None,
) -> DataFrame:
    """One row per inventory record: its route and the document or the error.

    The plan (no texts) and the link index are written to the run folder first;
    the texts are then scanned for links, and moved once to meet their records.
    ``link_to_unique`` makes links follow the collision suffixes of paths;
    ``presence`` lets planning do without the text column.
    """
    run = RunFolder(inventory.sparkSession, "convert")
    records, plan, spread = _planned(run, inventory, files, contents, base, presence)
    plan = run.keep(plan, "plan")

    if link_to_unique:
        unique_name = F.coalesce(
            F.substring_index("path", "/", -1), F.col("file_name")
        )
        records = plan.withColumnRenamed("file_id", "record_id").withColumn(
            "file_name", unique_name
        )
    index = run.keep(link_index(records), "index")
    overrides = run.keep(url_overrides(index), "overrides")

    with_text = plan.filter(F.col("route").isin("export", "convert"))
    texts = texts_of(run, contents.select("file_id", "markdown"), with_text)
    links = markdown_links(texts, repair)
    resolved = link_targets(links, index, overrides)
    documents = (
        with_text.join(spread.copies(resolved), spread.keys, "left")
        .join(spread.copies(texts), spread.keys)
    )
    published = render_documents(
        rewritten_text(documents, repair), F.col("modified_time")
    )
    stubs = render_stubs(plan.filter(F.col("route").isin("stub_url", "stub_mime")))
    failed = plan.filter(F.col("route") == "error").withColumn(
        "content", F.lit(None).cast("string")
    )
    parts = [part.select(*_RESULT) for part in (published, stubs, failed)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
