"""Front matter and body texts of Markdown documents."""

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.fixed_values import (
    FRONT_MATTER_KEYS,
    MIME_STUB_TEXT,
    PREAMBLE,
    QUOTED_VALUE,
    URL_STUB_TEXT,
)
from linkloom.functions.text import trim_space

_FENCE = "---\n"


def content_hash(body: Column) -> Column:
    """SHA-256, in hex, of a body (without front matter)."""
    return F.sha2(body, 256)


def compose_body(link: Column, text: Column) -> Column:
    return F.concat(F.lit(PREAMBLE), link, F.lit("\n\n"), text)


def url_stub_text(kind: Column) -> Column:
    return F.format_string(URL_STUB_TEXT, kind)


def mime_stub_text(kind: Column, mime_type: Column) -> Column:
    return F.format_string(MIME_STUB_TEXT, kind, mime_type)


def yaml_value(value: Column) -> Column:
    """A value, quoted when it holds characters special to YAML."""
    quoted = F.concat(
        F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"')
    )
    return F.when(value.rlike(QUOTED_VALUE), quoted).otherwise(value)


def _block(values: dict[str, Column]) -> Column:
    """Lines for the values that are not null, in the fixed key order."""
    lines = [
        F.concat(F.lit(f"{key}: "), values[key], F.lit("\n"))
        for key in FRONT_MATTER_KEYS
    ]
    return F.concat_ws("", F.lit(_FENCE), *lines, F.lit(_FENCE))


def render_front_matter(
    title: Column, link: Column, revision: Column, body_hash: Column, tags: Column
) -> Column:
    """Front matter of a newly converted document."""
    return _block(
        {
            "description": yaml_value(title),
            "editor": F.lit("markdown"),
            "gdrive-link": yaml_value(link),
            "hash-gdrive": yaml_value(revision),
            "hash-content": body_hash,
            "published": F.lit("true"),
            "tags": F.when(F.size(tags) > 0, F.array_join(tags, ", ")),
            "title": yaml_value(title),
        }
    )


def rebuild_front_matter(
    values: Column, replaced: dict[str, Column] | None = None
) -> Column:
    """Front matter from a map; keys outside the fixed set are lost."""
    replaced = replaced or {}
    return _block(
        {
            key: yaml_value(replaced.get(key, F.try_element_at(values, F.lit(key))))
            for key in FRONT_MATTER_KEYS
        }
    )


def final_document(front_matter: Column, body: Column) -> Column:
    return F.concat(front_matter, F.lit("\n"), body)


def parse_front_matter(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``front_matter`` (a map), ``body`` and ``parse_error``.

    Lines are split at their first colon; the last line of a key wins.
    """
    text = F.col(content)
    end = F.locate("\n---\n", text, 5)
    opened = text.startswith(_FENCE)
    error = (
        F.when(text.isNull(), "failed to read file")
        .when(~opened, "failed to parse frontmatter: no frontmatter found")
        .when(F.col("_end") == 0, "failed to parse frontmatter: frontmatter not closed")
    )
    parsed = F.col("parse_error").isNull()

    def entry(line: Column, position: Column) -> Column:
        halves = F.split(line, ":", 2)
        return F.struct(
            trim_space(F.get(halves, F.lit(0))).alias("key"),
            position.alias("position"),
            F.btrim(trim_space(F.get(halves, F.lit(1))), F.lit('"')).alias("value"),
        )

    block = F.when(parsed, text.substr(F.lit(5), F.col("_end") - 5))
    lines = F.filter(F.split(block, "\n"), lambda line: line.contains(":"))
    # Sorted by key and line number, so that the last line of each key is the
    # one whose successor has another key.
    last_of_key = F.filter(
        F.col("_entries"),
        lambda e, i: ~e["key"].eqNullSafe(F.get(F.col("_entries"), i + 1)["key"]),
    )
    return (
        df.withColumn("_end", end)
        .withColumn("parse_error", error)
        .withColumn("_entries", F.array_sort(F.transform(lines, entry)))
        .withColumn(
            "front_matter",
            F.map_from_entries(
                F.transform(last_of_key, lambda e: F.struct(e["key"], e["value"]))
            ),
        )
        .withColumn(
            "body",
            F.when(parsed, text.substr(F.col("_end") + 5, F.length(text))),
        )
        .drop("_end", "_entries")
    )
