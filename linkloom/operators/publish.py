"""Routing of inventory records and rendering of published documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import access
from linkloom.functions.fixed_values import STUB_HASH
from linkloom.functions.frontmatter import (
    compose_body,
    content_hash,
    final_document,
    mime_stub_text,
    render_front_matter,
    url_stub_text,
)
from linkloom.functions.naming import tag_list


def route_documents(records: DataFrame) -> DataFrame:
    """Add ``route`` and ``error``; the first rule that matches decides.

    Routes are ``stub_url``, ``stub_mime``, ``export``, ``convert`` and
    ``error``. Needs ``link``, ``title``, ``file_id`` and the file's metadata.
    """
    link, mime = F.col("link"), F.col("mime_type")
    readable = F.coalesce(F.col("http_status") == 200, F.lit(False))
    route = (
        F.when(F.col("file_id").isNull(), "error")
        .when(access.needs_stub_by_url(link), "stub_url")
        .when(~readable, "error")
        .when(access.needs_stub_by_mime(mime), "stub_mime")
        .when(access.is_workspace(mime), "export")
        .when(access.is_convertible(mime), "convert")
        .otherwise("error")
    )
    error = (
        F.when(F.col("route") != "error", None)
        .when(
            F.col("file_id").isNull(),
            F.concat(F.lit("failed to extract file ID from "), link),
        )
        .when(
            ~readable, F.concat(F.lit("failed to get metadata for "), F.col("file_id"))
        )
        .otherwise(
            F.concat(
                F.lit("unsupported file type "),
                F.coalesce(mime, F.lit("")),
                F.lit(" for "),
                F.col("title"),
            )
        )
    )
    return records.withColumn("route", route).withColumn("error", error)


def require_content(routed: DataFrame) -> DataFrame:
    """Turn documents whose text is not there (``has_content``) into errors."""
    missing = F.col("route").isin("export", "convert") & F.col("has_content").isNull()
    error = F.when(
        F.col("route") == "export",
        F.format_string("failed to export %s as markdown", "title"),
    ).otherwise(F.format_string("failed to convert PDF %s", "title"))
    return routed.withColumns(
        {
            "error": F.when(missing, error).otherwise(F.col("error")),
            "route": F.when(missing, "error").otherwise(F.col("route")),
        }
    )


def document_kind(records: DataFrame) -> DataFrame:
    """Add ``kind``, the label of a stub's document type."""
    return records.withColumn(
        "kind",
        F.when(F.col("route") == "stub_url", access.kind_by_url(F.col("link"))).when(
            F.col("route") == "stub_mime", access.kind_by_mime(F.col("mime_type"))
        ),
    )


def stub_text() -> Column:
    return F.when(
        F.col("route") == "stub_url", url_stub_text(F.col("kind"))
    ).otherwise(mime_stub_text(F.col("kind"), F.col("mime_type")))


def render_documents(records: DataFrame, revision: Column) -> DataFrame:
    """Turn ``text`` into ``content``, a whole document with front matter."""
    body = F.col("_body")
    header = render_front_matter(
        title=F.col("title"),
        link=F.col("link"),
        revision=revision,
        body_hash=content_hash(body),
        tags=tag_list(F.col("tags")),
    )
    return (
        records.withColumn("_body", compose_body(F.col("link"), F.col("text")))
        .withColumn("content", final_document(header, body))
        .drop("_body", "text")
    )


def render_stubs(records: DataFrame) -> DataFrame:
    stubs = document_kind(records).withColumn("text", stub_text()).drop("kind")
    return render_documents(stubs, F.lit(STUB_HASH))
