"""Titles, fragments and tags to file names and paths."""

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.fixed_values import (
    EMPTY_NAME,
    EMPTY_SLUG,
    MAX_NAME_BYTES,
    UNSAFE_NAME_CHARS,
)
from linkloom.functions.text import WS, trim_space

FRAGMENT_COLUMNS = ("frag1", "frag2", "frag3", "frag4", "frag5")


def safe_name(name: Column) -> Column:
    """A name that is safe as one path segment."""
    name = F.regexp_replace(name, UNSAFE_NAME_CHARS, "_")
    name = F.regexp_replace(name, f"[{WS}]+", " ")
    name = F.regexp_replace(name, r"\.+", ".")
    name = F.btrim(name, F.lit(" ._"))
    name = F.regexp_replace(name, r"\A\z", EMPTY_NAME)
    return F.substring(name.cast("binary"), 1, MAX_NAME_BYTES).cast("string")


def slug(title: Column) -> Column:
    """Lower-case, hyphenated form of a title, cut at its last dot."""
    title = F.lower(F.regexp_replace(title, r"\.[^.]*+\z", ""))
    title = F.regexp_replace(F.translate(title, " ", "-"), "[^a-z0-9-]+", "")
    title = F.btrim(F.regexp_replace(title, "-{2,}", "-"), F.lit("-"))
    return F.regexp_replace(title, r"\A\z", EMPTY_SLUG)


def file_name(title: Column) -> Column:
    return F.concat(safe_name(slug(title)), F.lit(".md"))


def fragments(*columns: Column) -> Column:
    """Non-empty fragments, in order."""
    return F.array_compact(F.array(*(F.when(c != "", c) for c in columns)))


def directories(*columns: Column) -> Column:
    """Non-empty fragments as safe path segments."""
    return F.array_compact(F.array(*(F.when(c != "", safe_name(c)) for c in columns)))


def tag_list(tags: Column) -> Column:
    """Tags split on ``;``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(tags, ";"), trim_space), lambda t: t != "")


def clean_base(base: str) -> str:
    """Base directory with ``.``, ``..`` and doubled slashes resolved."""
    if not base:
        return ""
    base = posixpath.normpath(base)
    if base.startswith("//"):
        base = base[1:]
    return "" if base == "." else base


def output_path(base: str, dirs: Column, name: Column) -> Column:
    """``base/<directories>/<name>``."""
    base = clean_base(base)
    inner = F.array_join(F.concat(dirs, F.array(name)), "/")
    if not base:
        return inner
    return F.concat(F.lit(base if base.endswith("/") else base + "/"), inner)


def relative_path(source: Column, target: Column, target_file: Column) -> Column:
    """Path to a file from a document's directory.

    ``source`` and ``target`` are arrays of safe segments without file names,
    one per fragment at most. Their shared start is found by comparing segment
    by segment and stopping at the first difference; this runs once per link,
    so it allocates nothing.
    """
    shared = F.lit(len(FRAGMENT_COLUMNS))
    for i in reversed(range(len(FRAGMENT_COLUMNS))):
        same = F.get(source, F.lit(i)) == F.get(target, F.lit(i))
        shared = F.when(same, shared).otherwise(i)
    return F.array_join(
        F.concat(
            F.array_repeat(F.lit(".."), F.size(source) - shared),
            F.slice(target, shared + 1, F.size(target)),
            F.array(target_file),
        ),
        "/",
    )
