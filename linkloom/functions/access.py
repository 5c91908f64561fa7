"""Classification by URL, MIME type and HTTP status."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.fixed_values import (
    ACCESS_STATUS,
    DEFAULT_ACCESS_STATUS,
    DEFAULT_MIME_KIND,
    DEFAULT_URL_KIND,
    DOCX,
    FOLDER,
    MIME_KINDS,
    MIME_PREFIX_KINDS,
    PDF,
    URL_KINDS,
    WORKSPACE_PREFIX,
)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_folder(mime_type: Column) -> Column:
    return mime_type == FOLDER


def is_workspace(mime_type: Column) -> Column:
    return mime_type.startswith(WORKSPACE_PREFIX)


def is_convertible(mime_type: Column) -> Column:
    return mime_type.isin(PDF, DOCX)


def is_link_source(mime_type: Column) -> Column:
    """Types whose text is searched for links."""
    return is_convertible(mime_type) | (
        is_workspace(mime_type) & ~is_folder(mime_type)
    )


def needs_stub_by_url(url: Column) -> Column:
    return _any(url.contains(piece) for piece in URL_KINDS)


def needs_stub_by_mime(mime_type: Column) -> Column:
    by_prefix = _any(mime_type.startswith(p) for p in MIME_PREFIX_KINDS)
    return by_prefix | mime_type.isin(*MIME_KINDS)


def kind_by_url(url: Column) -> Column:
    chain = F
    for piece, kind in URL_KINDS.items():
        chain = chain.when(url.contains(piece), kind)
    return chain.otherwise(DEFAULT_URL_KIND)


def kind_by_mime(mime_type: Column) -> Column:
    chain = F
    for prefix, kind in MIME_PREFIX_KINDS.items():
        chain = chain.when(mime_type.startswith(prefix), kind)
    for exact, kind in MIME_KINDS.items():
        chain = chain.when(mime_type == exact, kind)
    return chain.otherwise(DEFAULT_MIME_KIND)


def access_status(http_status: Column) -> Column:
    """Status of a file; a file without metadata counts as not found."""
    code = F.coalesce(http_status, F.lit(404))
    chain = F
    for value, status in ACCESS_STATUS.items():
        chain = chain.when(code == value, status)
    return chain.otherwise(DEFAULT_ACCESS_STATUS)
